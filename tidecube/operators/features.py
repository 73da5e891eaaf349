"""From cleaned feeds to standardised trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import cleaning, schema


def with_time_parts(df: DataFrame, pickup: str = "pickup_datetime") -> DataFrame:
    ts = F.col(pickup).cast("timestamp")
    return df.withColumns({
        "pickup_hour_ts": F.date_trunc("hour", ts), "pickup_date": F.to_date(ts), "pickup_year": F.year(ts), "pickup_month": F.month(ts),
        "pickup_hour": F.hour(ts), "pickup_day_of_week": F.dayofweek(ts), "is_weekend": fn.is_weekend(F.dayofweek(ts)),
    })


def with_motion(df: DataFrame, seconds, miles: str) -> DataFrame:
    return df.withColumns({"trip_duration_seconds": seconds, "trip_duration_mins": fn.minutes(seconds), "speed_mph": fn.speed_mph(F.col(miles), seconds)})


def with_source(df: DataFrame, source_id: int, source_name: str) -> DataFrame:
    return df.withColumns({"source_id": F.lit(source_id), "source_name": F.lit(source_name)})


def yellow_trips(raw: DataFrame, years: list[int]) -> DataFrame:
    """Raw yellow rows to standardised trips: schema, fills, cleaning, features."""
    rows = cleaning.cleaned(schema.fill(schema.enforce(raw, schema.YELLOW), schema.YELLOW_FILL), cleaning.yellow_steps(years))
    rows = rows.withColumnsRenamed({"tpep_pickup_datetime": "pickup_datetime", "tpep_dropoff_datetime": "dropoff_datetime", "trip_distance": "trip_miles"})
    rows = with_motion(with_time_parts(rows), fn.duration_seconds(F.col("pickup_datetime"), F.col("dropoff_datetime")), "trip_miles")
    return schema.standardise(with_source(rows, 0, "yellow"))


def hvfhv_trips(raw: DataFrame, years: list[int]) -> DataFrame:
    """Raw hvfhv rows to standardised trips; the duration is the feed's trip_time."""
    rows = cleaning.cleaned(schema.fill(schema.enforce(raw, schema.HVFHV), schema.HVFHV_FILL), cleaning.hvfhv_steps(years))
    rows = with_motion(with_time_parts(rows), F.col("trip_time").cast("double"), "trip_miles")
    return schema.standardise(with_source(rows, 1, "hvfhv"))


def combined(*feeds: DataFrame) -> DataFrame:
    """Feeds one after another, without rows that lack what the cube needs; an error if there is none.
    sources.files.combined_sources reads those that are there."""
    from functools import reduce

    if not feeds:
        raise ValueError("no feeds")
    needed = [c for c in "source_id source_name pickup_hour_ts pickup_date pickup_year pickup_month pickup_hour pickup_day_of_week is_weekend PULocationID DOLocationID".split()]
    return reduce(DataFrame.unionByName, feeds).dropna(subset=needed)


def with_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "payment_type_label": fn.label(F.col("payment_type"), fn.PAYMENT, "Other"), "ratecode_label": fn.label(F.col("RatecodeID"), fn.RATECODE, "Other"),
        "vendor_label": fn.label(F.col("VendorID"), fn.VENDOR, "Unknown"), "day_name": fn.label(F.col("pickup_day_of_week"), fn.DAYS, "Unknown"),
    })
