"""The demand cube and what is answered from it instead of from trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecube.functions import trips as fn

KEYS = ["source_id", "source_name", "PULocationID", "pickup_date", "pickup_year", "pickup_month", "pickup_day", "pickup_hour", "pickup_day_of_week", "is_weekend"]
SOURCE = ["source_id", "source_name"]


def demand_cube(trips: DataFrame) -> DataFrame:
    """Trips by source, zone and hour; only hours with trips."""
    return trips.withColumn("pickup_day", F.dayofmonth("pickup_date")).groupBy(*KEYS).agg(F.count("*").alias("trip_count"))


def roll_up(cube: DataFrame, *keys: str) -> DataFrame:
    """Sums of the cube, which equal counts of trips."""
    return cube.groupBy(*keys).agg(F.sum("trip_count").alias("trip_count"))


def count_trips(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(*keys).agg(F.count("*").alias("trip_count"))


def with_hour_ts(cube: DataFrame) -> DataFrame:
    return cube.withColumn("pickup_hour_ts", fn.hour_timestamp(F.col("pickup_date"), F.col("pickup_hour")))


HOURLY = [*SOURCE, "pickup_hour_ts", "pickup_date", "pickup_year", "pickup_month", "pickup_day_of_week", "pickup_hour"]


def hourly_demand(cube: DataFrame) -> DataFrame:
    return roll_up(with_hour_ts(cube), *HOURLY)


def with_zones(df: DataFrame, zones: DataFrame, key: str = "PULocationID") -> DataFrame:
    """Left join; Spark broadcasts the zones while they are small."""
    return df.join(zones, df[key] == zones["location_id"], "left")


def borough_hourly_demand(cube: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones are many to one borough, so hours are summed per borough after the join; a null borough is a group."""
    return roll_up(with_zones(with_hour_ts(cube), zones), *HOURLY, "borough")


def top_zones(counts: DataFrame, zones: DataFrame, n: int = 20) -> DataFrame:
    """counts(location_id, source_id, source_name, trip_count): the n largest of each source, ties by location."""
    order = Window.partitionBy(*SOURCE).orderBy(F.desc("trip_count"), "location_id")
    ranked = counts.withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= n)
    return ranked.join(zones, "location_id", "left")


def top_pickup_zones(cube: DataFrame, zones: DataFrame, n: int = 20) -> DataFrame:
    return top_zones(roll_up(cube.withColumnRenamed("PULocationID", "location_id"), "location_id", *SOURCE), zones, n)


def top_dropoff_zones(trips: DataFrame, zones: DataFrame, n: int = 20) -> DataFrame:
    return top_zones(count_trips(trips.withColumnRenamed("DOLocationID", "location_id"), "location_id", *SOURCE), zones, n)


def metrics_by_hour(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*SOURCE, "pickup_hour").agg(
        F.count("*").alias("trip_count"), F.avg("trip_duration_seconds").alias("avg_trip_duration_seconds"), F.avg("trip_miles").alias("avg_trip_miles"), F.avg("speed_mph").alias("avg_speed_mph")
    )


def feature_profile(trips: DataFrame, columns: list[str]) -> DataFrame:
    """Per source and column: approximate distinct values, nulls and their share; one pass, then one row a column."""
    aggs = [F.count("*").alias("row_count")]
    for c in columns:
        aggs += [F.approx_count_distinct(c).alias(f"d_{c}"), F.count(c).alias(f"n_{c}")]
    wide, types = trips.groupBy(*SOURCE).agg(*aggs), dict(trips.dtypes)
    share = lambda c: F.coalesce(F.round(F.try_divide((F.col("row_count") - F.col(f"n_{c}")) * 100.0, F.col("row_count")), 4), F.lit(0.0))
    row = lambda c: F.struct(F.lit(c).alias("feature_name"), F.lit(types[c]).alias("data_type"), F.col(f"d_{c}").alias("approx_distinct_count"), F.col(f"n_{c}").alias("non_null_count"), (F.col("row_count") - F.col(f"n_{c}")).alias("null_count"), share(c).alias("null_pct"), F.col("row_count"))
    return wide.select(*SOURCE, F.explode(F.array(*[row(c) for c in columns])).alias("profile")).select(*SOURCE, "profile.*")


def cleaning_summary(cube: DataFrame, raw_rows: dict[int, int | None], names: dict[int, str]) -> DataFrame:
    """(source, metric, value): curated, and where the raw count is known raw, removed and removed_pct. raw_rows has a few sources."""
    spark = cube.sparkSession
    raw = spark.createDataFrame([(k, names[k], raw_rows.get(k)) for k in names], "source_id int, source_name string, raw long")
    both = raw.join(roll_up(cube, "source_id"), "source_id", "left").fillna(0, ["trip_count"])
    pct = F.coalesce(F.round(F.try_divide((F.col("raw") - F.col("trip_count")) * 100.0, F.col("raw")), 4), F.lit(0.0))
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"))
    rows = F.array(metric("curated_rows", F.col("trip_count")), metric("raw_rows", F.col("raw")), metric("removed_rows", F.col("raw") - F.col("trip_count")), metric("removed_pct", F.when(F.col("raw").isNotNull(), pct)))
    return both.select(*SOURCE, F.explode(rows).alias("m")).select(*SOURCE, "m.*").where("value is not null")


def named_summary(cube: DataFrame, raw_rows: dict[int, int | None], names: dict[int, str]) -> DataFrame:
    """cleaning_summary as the published table has it: curated_row_count, raw_row_count, removed_row_count and an unrounded
    removed_pct."""
    rows = cleaning_summary(cube, raw_rows, names).where("metric <> 'removed_pct'").withColumn("metric", F.regexp_replace("metric", "_rows$", "_row_count"))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    share = rows.groupBy(*SOURCE).agg((of("removed_row_count") * 100.0).alias("removed"), of("raw_row_count").alias("raw")).where("raw is not null")
    return rows.unionByName(share.select(*SOURCE, F.lit("removed_pct").alias("metric"), F.coalesce(F.try_divide("removed", "raw"), F.lit(0.0)).alias("value")))
