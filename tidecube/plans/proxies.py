"""The driver's tables seen as trips, zones and long histories, in Spark and as SQL for the oracle."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.operators import cube, features, forecast, schema
from tidecube.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_yellow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of events as raw yellow rows, with nulls and odd codes at known places."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    null_at = lambda k, v: F.when(F.col("event_id") % k != 0, v)
    return e.select(
        (F.col("event_id") % 4 + 1).cast("int").alias("VendorID"), F.col("ts").alias("tpep_pickup_datetime"), F.timestamp_add("SECOND", F.floor(F.col("value") * 60), F.col("ts").cast("timestamp")).alias("tpep_dropoff_datetime"),
        null_at(5, (F.col("event_id") % 9).cast("double")).alias("passenger_count"), F.col("value").alias("trip_distance"), null_at(7, (F.col("event_id") % 8).cast("double")).alias("RatecodeID"),
        (F.col("user_id") % 30).alias("PULocationID"), F.get_json_object("props", "$.k").cast("long").alias("DOLocationID"), null_at(11, F.col("event_id") % 8).alias("payment_type"), (F.col("value") - 1).alias("fare_amount"), F.col("value").alias("total_amount"), null_at(3, F.lit(2.5)).alias("Airport_fee"),
    )


RAW_YELLOW = """ry AS (SELECT CAST(event_id % 4 + 1 AS BIGINT) AS VendorID, ts AS pickup, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS dropoff, CAST(floor(value * 60) AS BIGINT) AS secs,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 9 AS DOUBLE) END AS passenger_count, value AS trip_distance, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 8 AS DOUBLE) END AS RatecodeID,
  CAST(user_id % 30 AS BIGINT) AS PULocationID, CAST(json_extract(props, '$.k') AS BIGINT) AS DOLocationID, CASE WHEN event_id % 11 <> 0 THEN event_id % 8 END AS payment_type,
  value - 1 AS fare_amount, value AS total_amount, CASE WHEN event_id % 3 <> 0 THEN 2.5 END AS airport_fee FROM events WHERE event_type IN ('click', 'view'))"""
YELLOW_CHECKS = [
    ("valid_years", "year(pickup) IN (2023, 2024)"), ("time_order", "dropoff > pickup"), ("duration", "secs / 60.0 >= 1.0 AND secs / 60.0 <= 180"), ("distance", "trip_distance > 0 AND trip_distance <= 100"),
    ("passengers", "coalesce(passenger_count, 1) BETWEEN 1 AND 6"), ("fare", "fare_amount >= 0.01 AND total_amount >= 0.01"), ("codes", "VendorID IN (1, 2) AND coalesce(RatecodeID, 1) IN (1, 2, 3, 4, 5, 6, 99) AND payment_type IN (1, 2, 3, 4, 5, 6)"),
]


def raw_hvfhv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type not in ('click', 'view')")
    seconds = F.floor(F.col("value") * 60)
    return e.select(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("HV000"), (F.col("event_id") % 5 + 2).cast("string"))).alias("hvfhs_license_num"), F.col("ts").alias("pickup_datetime"), F.timestamp_add("SECOND", seconds, F.col("ts").cast("timestamp")).alias("dropoff_datetime"),
        (F.col("user_id") % 30).alias("PULocationID"), F.get_json_object("props", "$.k").cast("long").alias("DOLocationID"), F.col("value").alias("trip_miles"), seconds.cast("long").alias("trip_time"), (F.col("value") - 2).alias("base_passenger_fare"),
    )


RAW_HVFHV = """rh AS (SELECT CASE WHEN event_id % 13 <> 0 THEN 'HV000' || CAST(event_id % 5 + 2 AS VARCHAR) END AS license, ts AS pickup, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS dropoff, CAST(floor(value * 60) AS BIGINT) AS secs,
  CAST(user_id % 30 AS BIGINT) AS PULocationID, CAST(json_extract(props, '$.k') AS BIGINT) AS DOLocationID, value AS miles, value - 2 AS fare FROM events WHERE event_type NOT IN ('click', 'view'))"""
HVFHV_CHECKS = [
    ("required", "license IS NOT NULL AND pickup IS NOT NULL AND dropoff IS NOT NULL AND PULocationID IS NOT NULL AND DOLocationID IS NOT NULL"), ("valid_years", "year(pickup) IN (2023, 2024)"), ("time_order", "dropoff > pickup"),
    ("distance", "miles > 0 AND miles <= 100"), ("duration", "secs BETWEEN 60 AND 10800"), ("fare", "fare >= 0.01"),
]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as standardised trips, uncleaned, so that each source and hour has some."""
    e = table(spark, sf_dir, "events")
    seconds = F.floor(F.col("value") * 60)
    sid = F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1)
    rows = e.select(
        sid.alias("source_id"), F.when(sid == 0, "yellow").otherwise("hvfhv").alias("source_name"), F.col("ts").cast("timestamp").alias("pickup_datetime"), F.timestamp_add("SECOND", seconds, F.col("ts").cast("timestamp")).alias("dropoff_datetime"),
        (F.col("user_id") % 30).alias("PULocationID"), F.get_json_object("props", "$.k").cast("long").alias("DOLocationID"), F.col("value").alias("trip_miles"), seconds.alias("secs"),
    )
    return schema.standardise(features.with_motion(features.with_time_parts(rows), F.col("secs").cast("double"), "trip_miles"))


TRIPS = """t AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS source_id, CASE WHEN event_type IN ('click', 'view') THEN 'yellow' ELSE 'hvfhv' END AS source_name, ts AS pickup, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS dropoff,
  date_trunc('hour', ts) AS hour_ts, CAST(ts AS DATE) AS pickup_date, year(ts) AS pickup_year, month(ts) AS pickup_month, day(ts) AS pickup_day, hour(ts) AS pickup_hour, dayofweek(ts) + 1 AS pickup_day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend,
  CAST(user_id % 30 AS BIGINT) AS PULocationID, CAST(json_extract(props, '$.k') AS BIGINT) AS DOLocationID, CAST(floor(value * 60) AS DOUBLE) AS secs, value AS miles FROM events)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("location_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


ZONES = "z AS (SELECT CAST(n_nationkey AS BIGINT) AS location_id, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey)"
CUBE = TRIPS + """, c AS (SELECT source_id, source_name, PULocationID, pickup_date, pickup_year, pickup_month, pickup_day, pickup_hour, pickup_day_of_week, is_weekend, count(*) AS trip_count FROM t GROUP BY ALL)"""


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.demand_cube(trips(spark, sf_dir))


def orders_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as years of demand: a zone is a customer's nation, the hour its priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("long").alias("PULocationID"), F.to_date("o_orderdate").alias("pickup_date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pickup_hour"), F.lit(1).alias("trip_count"))
    return forecast.source_free_demand(rows)


ORDERS = "o AS (SELECT CAST(c_nationkey AS BIGINT) AS PULocationID, CAST(o_orderdate AS DATE) AS pickup_date, CAST(o_orderpriority[1:1] AS BIGINT) AS pickup_hour, CAST(count(*) AS DOUBLE) AS trip_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def orders_cells(demand: DataFrame) -> DataFrame:
    """The cells of a sparse grid, written: several parts of a plan read them, orders are read once."""
    return files.kept(forecast.cells(demand), files.fresh(demand.sparkSession))


def orders_grid(spark: SparkSession, sf_dir: str) -> forecast.SparseGrid:
    """A sample for quick looks: zones 0 to 4 on every 30th day of the year, hours 0 to 5, zero-filled."""
    return forecast.SparseGrid(orders_cells(orders_demand(spark, sf_dir).where("PULocationID < 5")), stride=30, hours=6)


GRID = ORDERS + """, d5 AS (SELECT * FROM o WHERE PULocationID < 5),
g AS (SELECT zn.PULocationID, dt.pickup_date, h.pickup_hour, coalesce(d5.trip_count, 0.0) AS trip_count, year(dt.pickup_date) AS pickup_year, month(dt.pickup_date) AS pickup_month, dayofweek(dt.pickup_date) + 1 AS pickup_day_of_week, year(dt.pickup_date) * 12 + month(dt.pickup_date) AS month_index
  FROM (SELECT DISTINCT PULocationID FROM d5) zn CROSS JOIN (SELECT DISTINCT pickup_date FROM d5 WHERE dayofyear(pickup_date) % 30 = 1) dt CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS pickup_hour) h
  LEFT JOIN d5 ON d5.PULocationID = zn.PULocationID AND d5.pickup_date = dt.pickup_date AND d5.pickup_hour = h.pickup_hour)"""


def full_grid(spark: SparkSession, sf_dir: str) -> forecast.SparseGrid:
    """All zones, dates and hours: zero-filled."""
    return forecast.SparseGrid(orders_cells(orders_demand(spark, sf_dir)))


FULL_GRID = ORDERS + """, g AS (SELECT zn.PULocationID, dt.pickup_date, h.pickup_hour, coalesce(o.trip_count, 0.0) AS trip_count, year(dt.pickup_date) AS pickup_year, month(dt.pickup_date) AS pickup_month, dayofweek(dt.pickup_date) + 1 AS pickup_day_of_week, year(dt.pickup_date) * 12 + month(dt.pickup_date) AS month_index
  FROM (SELECT DISTINCT PULocationID FROM o) zn CROSS JOIN (SELECT DISTINCT pickup_date FROM o) dt CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS pickup_hour) h
  LEFT JOIN o ON o.PULocationID = zn.PULocationID AND o.pickup_date = dt.pickup_date AND o.pickup_hour = h.pickup_hour)"""


def also_full(queries: dict, name: str, f, sql: str, full_sql: str | None = None) -> None:
    """Registers a query of the sample grid, and as NAME_full the same over the full grid."""
    queries[name] = (f, sql)
    queries[f"{name}_full"] = (functools.partial(f, grid=full_grid), full_sql or sql.replace(GRID, FULL_GRID))
