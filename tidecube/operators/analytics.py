"""Questions to the cube: totals, distributions, shares, tops, holidays."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import serving
from tidecube.operators.schema import rounded


def source_summary(cube: DataFrame) -> DataFrame:
    n = F.col("trip_count")
    return cube.groupBy("source_id").agg(
        F.count("*").alias("row_count"), F.sum(n).alias("trips"), rounded(F.avg(n), 4).alias("avg_trips"), F.min(n).alias("min_trips"), F.max(n).alias("max_trips"),
        F.countDistinct("PULocationID").alias("zones"), F.min("pickup_year").alias("first_year"), F.max("pickup_year").alias("last_year"), F.min("pickup_date").alias("first_date"), F.max("pickup_date").alias("last_date"),
    )


def monthly(cube: DataFrame) -> DataFrame:
    rows = cube.groupBy("source_id", "pickup_year", "pickup_month").agg(F.sum("trip_count").alias("trips"))
    return rows.withColumn("year_month", fn.year_month(F.col("pickup_year"), F.col("pickup_month")))


def distribution(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), rounded(F.avg(c), 4).alias("mean"), rounded(F.stddev(c), 4).alias("stddev"), F.min(c).alias("least"), F.max(c).alias("most"), rounded(F.skewness(c), 4).alias("skewness"))


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Elements of the column at the given shares, one row each: the least with at least that share of the non-null rows at or
    below it. Exact (nulls if there are no values); shares count as the decimals that they are written as."""
    values = df.select(F.col(column).alias("v")).where("v is not null")
    n = values.count()
    ranks = [max(1, math.ceil(Fraction(str(s)) * n)) - 1 for s in shares] if n else []
    known = serving.at_ranks(values, sorted(set(ranks)))
    rows = [(float(s), known[ranks[i]] if n else None) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, f"share double, value {values.schema['v'].dataType.simpleString()}")


def pivoted(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.first(value))


def shares(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum and share of the total in per cent; the total is one row, so joining it costs nothing."""
    sums = df.groupBy(key).agg(F.sum(value).alias("trips"))
    total = sums.agg(F.sum("trips").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(key, "trips", rounded(F.try_divide(F.col("trips") * 100.0, F.col("total")), 2).alias("share_pct"))


def weighted_metrics(by_hour: DataFrame) -> DataFrame:
    """metrics_by_hour of several sources as one: averages weighted by trips."""
    w = lambda c: rounded(F.try_divide(F.sum(F.col(c) * F.col("trip_count")), F.sum("trip_count")), 4).alias(c)
    return by_hour.groupBy("pickup_hour").agg(F.sum("trip_count").alias("trip_count"), w("avg_trip_duration_seconds"), w("avg_trip_miles"), w("avg_speed_mph"))


def daily(cube: DataFrame) -> DataFrame:
    return cube.groupBy("pickup_date", "pickup_year", "pickup_month", "pickup_day_of_week").agg(F.sum("trip_count").alias("trips"))


def holiday_impact(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Trips on each holiday against the mean of other days of its year, month and weekday; the percentage is of the rounded mean."""
    on = days.join(holidays, "pickup_date")
    off = days.join(holidays, "pickup_date", "left_anti").select(F.col("pickup_year").alias("y"), F.col("pickup_month").alias("m"), F.col("pickup_day_of_week").alias("d"), F.col("trips").alias("other"))
    both = on.join(off, (on["pickup_year"] == off["y"]) & (on["pickup_month"] == off["m"]) & (on["pickup_day_of_week"] == off["d"]), "left")
    out = both.groupBy("holiday_name", "pickup_date", "trips").agg(rounded(F.avg("other"), 2).alias("baseline_trips"), F.count("other").alias("baseline_days"))
    return out.withColumn("pct_vs_baseline", rounded(F.try_divide((F.col("trips") - F.col("baseline_trips")) * 100.0, F.col("baseline_trips")), 2))


def holiday_summary(impact: DataFrame) -> DataFrame:
    return impact.groupBy("holiday_name").agg(F.count("*").alias("days"), rounded(F.avg("trips"), 2).alias("avg_trips"), rounded(F.avg("pct_vs_baseline"), 2).alias("avg_pct"))


def band_distribution(cube: DataFrame) -> DataFrame:
    n = F.col("trip_count")
    bands = cube.groupBy(fn.demand_bucket(n).alias("target_bin"), fn.demand_bucket_order(n).alias("bin_order")).agg(F.count("*").alias("row_count"), F.sum(n).alias("trips"))
    total = bands.agg(F.sum("row_count").alias("r"), F.sum("trips").alias("t"))
    return bands.crossJoin(F.broadcast(total)).select("target_bin", "bin_order", rounded(F.col("row_count") * 100.0 / F.col("r"), 2).alias("row_share_pct"), rounded(F.col("trips") * 100.0 / F.col("t"), 2).alias("trip_share_pct"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A sample that the partitioning does not change: rows whose key hashes low."""
    return df.where(hashed(key, seed) < int(fraction * (1 << 32)))


def hashed(key: str, seed: int) -> Column:
    """32 bits of a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def capped_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows: a sample of min(1, most / rows), and of it the first in the order of the hash, so that no rows are
    preferred. Ties of the hash go by key."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.crossJoin(F.broadcast(total)).where(hashed(key, seed) < F.least(F.lit(1.0), F.lit(float(most)) / F.col("total")) * (1 << 32)).drop("total")
    return rows.orderBy(hashed(key, seed), F.col(key)).limit(most)


def balanced_sample(df: DataFrame, column: str, value, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the value and n without, in the order of a hash of key, tagged."""
    order = [hashed(key, seed), F.col(key)]
    a = df.where(F.col(column) == value).orderBy(*order).limit(n).withColumn("sample_group", F.lit("target"))
    b = df.where(F.col(column) != value).orderBy(*order).limit(n).withColumn("sample_group", F.lit("other"))
    return a.unionByName(b)
