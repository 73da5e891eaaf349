"""The serving table of typical demand and the questions that a dashboard asks of it."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators.schema import rounded
from tidecube.sources.layout import rank

KEYS = ["source_id", "source_name", "PULocationID", "pickup_month", "pickup_day_of_week", "pickup_hour"]


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row of exact interpolated quartiles, for tables of a known size: all distinct values meet in one task."""
    return df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))


class Range(NamedTuple):
    """Values from low to high, n rows, with `before` rows below them."""

    low: float
    high: float
    before: int
    n: int


def narrowed(values: DataFrame, ranks: list[int], parts: int, fits: int) -> dict[int, Range]:
    """For each rank (from 0) of the non-null numbers v, none of them NaN, a range that holds it and either is one value or has `fits` rows at most.

    Each pass cuts the ranges that are still too large at approximate quantiles of their own and counts the pieces; a value
    that is a cut is a piece by itself, so hot values end a search, and every pass leaves a smaller range. A pass gives the
    driver a few rows for each rank. Only the rows of those ranges are looked at again.
    """
    v, found = F.col("v"), {}
    whole = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    todo = {Range(whole["low"], whole["high"], 0, whole["n"]): list(ranks)} if whole["n"] else {}
    while todo:
        for r in [r for r in todo if r.low == r.high or r.n <= fits]:
            found |= dict.fromkeys(todo.pop(r), r)
        if not todo:
            break
        large = sorted(todo)
        inside = values.where(reduce(Column.__or__, [v.between(r.low, r.high) for r in large]))
        of = reduce(lambda c, r: F.when(v >= F.lit(r.low), F.lit(r.low)).otherwise(c), large, F.lit(None).cast(values.schema["v"].dataType))
        cuts = inside.groupBy(of.alias("of")).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).collect()
        cuts = sorted({c for row in cuts for c in row["cuts"]} | {r.low for r in large})
        place = rank(v, cuts)
        hit = v.isin(cuts)
        pieces = inside.groupBy(place.alias("place"), (~hit).alias("between")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).orderBy("place", "between").collect()
        smaller: dict[Range, list[int]] = {}
        for r in large:
            before = r.before
            for p in pieces:
                if r.low <= p["low"] <= r.high:
                    held = [k for k in todo[r] if before <= k < before + p["n"]]
                    if held:
                        smaller.setdefault(Range(p["low"], p["high"], before, p["n"]), []).extend(held)
                    before += p["n"]
        todo = smaller
    return found


def at_ranks(values: DataFrame, ranks: list[int], parts: int = 64, fits: int = 10_000) -> dict[int, float]:
    """The non-null number v at each rank (from 0), NaN above all others. Ranges that hold the ranks are narrowed until `fits`
    rows are left, and only those rows are sorted."""
    known: dict = {}
    if values.schema["v"].dataType.typeName() in ("double", "float"):
        values = values.where(~F.isnan("v"))
        n = values.count()
        known = {k: math.nan for k in ranks if k >= n}
    ranges = narrowed(values, [k for k in ranks if k not in known], parts, fits)
    known |= {k: r.low for k, r in ranges.items() if r.low == r.high}
    if rest := {r for r in ranges.values() if r.low < r.high}:
        inside = values.where(reduce(Column.__or__, [F.col("v").between(r.low, r.high) for r in rest]))
        counts = inside.groupBy("v").count().orderBy("v").collect()
        for r in rest:
            at = r.before
            for row in counts:
                if r.low <= row["v"] <= r.high:
                    known |= {k: row["v"] for k in ranges if at <= k < at + row["count"]}
                    at += row["count"]
    return known


def exact_quantiles(df: DataFrame, column: str, shares: list[float], parts: int = 64, fits: int = 10_000) -> DataFrame:
    """quartiles for columns of any number of distinct values and any skew: one row, q, of exact interpolated quantiles (nulls if
    there are no values)."""
    spark, values = df.sparkSession, df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.count()
    places = [(n - 1) * s for s in shares]
    known = at_ranks(values, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}) if n else [], parts, fits)
    between = lambda p, a, b: known[a] if a == b else (b - p) * known[a] + (p - a) * known[b]
    q = [between(p, math.floor(p), math.ceil(p)) if n else None for p in places]
    return spark.createDataFrame([(q,)], "q array<double>")


def banded(df: DataFrame, column: str) -> DataFrame:
    q = F.col("q")
    return df.crossJoin(F.broadcast(quartiles(df, column))).withColumn("demand_level", fn.quartile_band(F.col(column), q[0], q[1], q[2])).drop("q")


def baseline(cube: DataFrame) -> DataFrame:
    """Mean trips of observed hours; is_weekend follows from the weekday."""
    return cube.groupBy(*KEYS).agg(rounded(F.avg("trip_count"), 4).alias("predicted_trip_count"), F.any_value("is_weekend").alias("is_weekend"))


def serving_table(cube: DataFrame, zones: DataFrame) -> DataFrame:
    """baseline with bands and zone names in one plan; unknown zones are named so."""
    rows = banded(baseline(cube), "predicted_trip_count")
    names = zones.select(F.col("location_id").alias("PULocationID"), "borough", "zone")
    return rows.join(names, "PULocationID", "left").fillna("Unknown", ["borough", "zone"])


def zone_slice(table: DataFrame, month: int, day_of_week: int, hour: int, source_id: int | None = None) -> DataFrame:
    """One source's rows of an hour, or all sources summed per zone and banded anew, the largest first."""
    rows = table.where((F.col("pickup_month") == month) & (F.col("pickup_day_of_week") == day_of_week) & (F.col("pickup_hour") == hour))
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id).select("PULocationID", "borough", "zone", "predicted_trip_count", "demand_level")
    else:
        rows = banded(rows.groupBy("PULocationID", "borough", "zone").agg(rounded(F.sum("predicted_trip_count"), 4).alias("predicted_trip_count")), "predicted_trip_count")
    return rows.orderBy(F.desc("predicted_trip_count"), "PULocationID")


def zone_profile(table: DataFrame, zone: int, month: int, day_of_week: int, source_id: int | None = None) -> DataFrame:
    rows = table.where((F.col("PULocationID") == zone) & (F.col("pickup_month") == month) & (F.col("pickup_day_of_week") == day_of_week))
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    return rows.groupBy("pickup_hour").agg(rounded(F.sum("predicted_trip_count"), 4).alias("predicted_trip_count")).orderBy("pickup_hour")


def zone_names(table: DataFrame, zone: int) -> DataFrame:
    return table.where(F.col("PULocationID") == zone).agg(F.any_value("zone").alias("zone"), F.any_value("borough").alias("borough"))


def filter_options(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct().orderBy(column)


def freshness(table: DataFrame) -> DataFrame:
    stamp = F.max("prediction_timestamp") if "prediction_timestamp" in table.columns else F.lit(None).cast("timestamp")
    version = F.max("model_version") if "model_version" in table.columns else F.lit(None).cast("string")
    return table.agg(stamp.alias("last_prediction"), version.alias("model_version"), F.count("*").alias("row_count"))


def kpis(rows: DataFrame) -> DataFrame:
    p = F.col("predicted_trip_count")
    boroughs = rows.groupBy("borough").agg(F.sum(p).alias("trips")).agg(F.max_by("borough", F.struct("trips", "borough")).alias("top_borough"))
    return rows.agg(F.countDistinct("PULocationID").alias("zones"), F.max(p).alias("peak"), rounded(F.avg(p), 4).alias("mean"), rounded(F.sum(p), 4).alias("total")).crossJoin(boroughs)


def peaks(rows: DataFrame, n: int = 10, share: float = 0.85) -> DataFrame:
    """The n largest with their per cent of the largest, and whether they reach share of it."""
    first = rows.orderBy(F.desc("predicted_trip_count"), "PULocationID").limit(n)
    most = F.max("predicted_trip_count").over(Window.partitionBy())
    most = F.when(most == 0, 1.0).otherwise(most)
    return first.select("PULocationID", "predicted_trip_count", rounded(F.col("predicted_trip_count") * 100 / most, 2).alias("pct_of_max"), (F.col("predicted_trip_count") >= share * most).alias("is_peak"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows in equal ranges between least and most, the last one closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))))
    return df.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(k, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("row_count"))


def recommend(cube: DataFrame, weights: dict[str, float] | None = None, n: int = 15) -> DataFrame:
    """Zones scored 0 to 1 on demand, steadiness, trend and yellow share; weights and band limits are this library's choice."""
    weights = weights or {"demand": 0.4, "reliability": 0.25, "growth": 0.2, "source": 0.15}
    total = sum(weights.values())
    yearly = cube.groupBy("PULocationID", "pickup_year").agg(F.avg("trip_count").alias("mean"))
    slope = yearly.groupBy("PULocationID").agg(F.coalesce(F.regr_slope("mean", "pickup_year"), F.lit(0.0)).alias("trend_slope"))
    c = F.col("trip_count")
    zones = cube.groupBy("PULocationID").agg(
        F.avg(c).alias("mean_demand"), F.coalesce(F.try_divide(F.stddev(c), F.avg(c)), F.lit(0.0)).alias("demand_cv"), F.try_divide(F.sum(F.when(F.col("source_id") == 0, c).otherwise(0)), F.sum(c)).alias("yellow_share")
    ).join(slope, "PULocationID")
    every = Window.partitionBy()  # a row for each zone
    scaled = lambda x: F.coalesce(F.try_divide(x - F.min(x).over(every), F.max(x).over(every) - F.min(x).over(every)), F.lit(0.0))
    scores = {"demand": scaled(F.col("mean_demand")), "reliability": 1 - scaled(F.col("demand_cv")), "growth": scaled(F.col("trend_slope")), "source": F.col("yellow_share")}
    zones = zones.withColumns({f"{k}_score": v for k, v in scores.items()})
    zones = zones.withColumn("opportunity_score", sum(F.col(f"{k}_score") * (w / total) for k, w in weights.items()))
    s = F.col("opportunity_score")
    zones = zones.withColumn("band", F.when(s >= 0.7, "top_pick").when(s >= 0.5, "good").when(s >= 0.3, "okay").otherwise("avoid"))
    out = [rounded(F.col(x), 4).alias(x) for x in ("mean_demand", "demand_cv", "trend_slope", "yellow_share", *[f"{k}_score" for k in scores], "opportunity_score")]
    return zones.orderBy(F.desc(F.round(s, 9)), "PULocationID").limit(n).select("PULocationID", *out, "band")
