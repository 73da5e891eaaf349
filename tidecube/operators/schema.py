"""Canonical schemas and how a table is brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the two trip feeds, of standardised trips and of the demand table.
YELLOW = "VendorID long, tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, passenger_count double, trip_distance double, RatecodeID double, store_and_fwd_flag string, PULocationID long, DOLocationID long, payment_type long, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, total_amount double, congestion_surcharge double, airport_fee double"
HVFHV = "hvfhs_license_num string, dispatching_base_num string, originating_base_num string, request_datetime timestamp, on_scene_datetime timestamp, pickup_datetime timestamp, dropoff_datetime timestamp, PULocationID long, DOLocationID long, trip_miles double, trip_time long, base_passenger_fare double, tolls double, bcf double, sales_tax double, congestion_surcharge double, airport_fee double, tips double, driver_pay double, shared_request_flag string, shared_match_flag string, access_a_ride_flag string, wav_request_flag string, wav_match_flag string"
TRIPS = "source_id int, source_name string, pickup_datetime timestamp, dropoff_datetime timestamp, pickup_hour_ts timestamp, pickup_date date, pickup_year int, pickup_month int, pickup_hour int, pickup_day_of_week int, is_weekend boolean, PULocationID long, DOLocationID long, trip_duration_seconds double, trip_duration_mins double, trip_miles double, speed_mph double"
DEMAND = "source_id int, source_name string, PULocationID long, pickup_date date, pickup_year int, pickup_month int, pickup_day int, pickup_hour int, pickup_day_of_week int, is_weekend boolean, trip_count long"
YELLOW_FILL = {"passenger_count": 1.0, "RatecodeID": 1.0, "congestion_surcharge": 0.0, "airport_fee": 0.0, "store_and_fwd_flag": "N"}
HVFHV_FILL = {"originating_base_num": "Unknown", **{c: 0.0 for c in ("tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips", "driver_pay")}, **{c: "N" for c in ("shared_request_flag", "shared_match_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag")}}
# End of fixed values.


def parsed(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def enforce(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Columns of the schema in its order and types: found whatever their case, typed nulls where missing, the rest dropped."""
    there = {c.lower(): c for c in df.columns}
    value = lambda f: F.col(f"`{there[f.name.lower()]}`") if f.name.lower() in there else F.lit(None)
    return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in parsed(schema)])


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def require(df: DataFrame, names: list[str]) -> DataFrame:
    if lacking := missing_columns(df, names):
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def standardise(df: DataFrame, schema: str | T.StructType = TRIPS) -> DataFrame:
    """Like enforce, but every column of the schema has to be there."""
    return enforce(require(df, [f.name for f in parsed(schema)]), schema)


def same_columns(df: DataFrame, names: list[str]) -> bool:
    """Whether an output that is there has just these columns in this order, so that its step may be skipped."""
    return df.columns == list(names)


def fill(df: DataFrame, values: dict) -> DataFrame:
    """fillna for those keys that are columns."""
    return df.fillna({k: v for k, v in values.items() if k in df.columns})


def described(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, data_type string")


def normalise_demand(df: DataFrame) -> DataFrame:
    """Rows for a regressor: source_id 0 where the column is missing, no nulls, label and is_weekend_int added."""
    df = df if "source_id" in df.columns else df.withColumn("source_id", F.lit(0))
    names = ["source_id", "PULocationID", "pickup_year", "pickup_month", "pickup_hour", "pickup_day_of_week", "is_weekend", "trip_count"]
    rows = require(df, names).select(*names).dropna()
    ints = ["source_id", "PULocationID", "pickup_year", "pickup_month", "pickup_hour", "pickup_day_of_week"]
    return rows.select(*[F.col(c).cast("int").alias(c) for c in ints], F.col("is_weekend").cast("int").alias("is_weekend_int"), F.col("trip_count").cast("double").alias("label"))


def with_day(df: DataFrame) -> DataFrame:
    """pickup_date and pickup_day, whichever is missing made from the other."""
    if "pickup_date" not in df.columns:
        df = df.withColumn("pickup_date", F.make_date("pickup_year", "pickup_month", "pickup_day"))
    return df if "pickup_day" in df.columns else df.withColumn("pickup_day", F.dayofmonth("pickup_date"))


def rounded(c: Column | str, digits: int) -> Column:
    """Half up on the decimal value, so that engines agree on it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(30,10)"), digits).cast("double")
