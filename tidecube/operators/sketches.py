"""Profiles that add up: sketches of each month, of which any range of months is made without reading trips again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.operators.cube import SOURCE

#: Registers of distinct counts (2 ** DISTINCT) and size of quantile sketches: errors of about 1.3 % and 1.3 % of rank.
DISTINCT, QUANTILES = 13, 400
MONTH = ["pickup_year", "pickup_month"]


def monthly_sketches(trips: DataFrame, columns: list[str]) -> DataFrame:
    """For each source, month and column: row_count, non_null_count, distinct_sketch (HyperLogLog) and quantile_sketch (KLL, of the
    value as a double). One pass and one shuffle of sketches, not of rows. Empty sketches stand for columns of nulls."""
    aggs = [F.count("*").alias("row_count")]
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT)).alias(f"d_{c}"), F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILES)).alias(f"q_{c}")]
    wide = trips.groupBy(*SOURCE, *MONTH).agg(*aggs)
    row = lambda c: F.struct(F.lit(c).alias("feature_name"), F.col(f"n_{c}").alias("non_null_count"), F.col(f"d_{c}").alias("distinct_sketch"), F.col(f"q_{c}").alias("quantile_sketch"))
    return wide.select(*SOURCE, *MONTH, "row_count", F.inline(F.array(*[row(c) for c in columns])))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of all rows with equal keys as one; the order and grouping in which they are merged do not matter for the
    distinct counts, and for quantiles only within their error."""
    return sketches.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null_count").alias("non_null_count"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILES)).alias("quantile_sketch"),
    )


def profile(sketches: DataFrame, first: str, last: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per source and column over the months from first to last (yyyy-MM): counts, null_pct, approx_distinct_count and quantiles,
    null where there is no value."""
    index = lambda m: int(m[:4]) * 12 + int(m[5:])
    months = sketches.where((F.col("pickup_year") * 12 + F.col("pickup_month")).between(index(first), index(last)))
    all_of = merged(months, *SOURCE, "feature_name")
    quantiles = F.when(F.col("non_null_count") > 0, F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(s)) for s in shares]))
    nulls = F.col("row_count") - F.col("non_null_count")
    return all_of.select(
        *SOURCE, "feature_name", "row_count", "non_null_count", nulls.alias("null_count"), F.coalesce(F.round(F.try_divide(nulls * 100.0, F.col("row_count")), 4), F.lit(0.0)).alias("null_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct_count"), quantiles.alias("quantiles"),
    )
