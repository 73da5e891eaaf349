"""Queries of sources and sinks: what is written is read again (S, K, X8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.plans.proxies import CUBE, demand, table
from tidecube.sources import files
from tidecube.sources.files import fresh

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("s5_row_count", "SELECT count(*) AS n FROM lineitem")
def s5(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("s6_file_inventory", None)
def s6(spark, sf):
    return files.inventory(spark, sf)


@query("s15_months", "SELECT CAST(m AS DATE) AS month_start, year(m) AS pickup_year, month(m) AS pickup_month FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH)) AS m)")
def s15(spark, sf):
    return files.months(spark, "2023-11", "2024-03").withColumns({"pickup_year": F.col("pickup_year").cast("long"), "pickup_month": F.col("pickup_month").cast("long")})


@query("s19_ranges", "SELECT h AS pickup_hour, d AS pickup_day_of_week FROM (SELECT unnest(generate_series(0, 23)) AS h) CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS d)")
def s19(spark, sf):
    return spark.range(24).withColumnRenamed("id", "pickup_hour").crossJoin(spark.range(1, 8).withColumnRenamed("id", "pickup_day_of_week"))


@query("s2_drifting_files", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_orderkey AS VARCHAR) AS extra FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL FROM orders WHERE o_orderkey % 2 = 1")
def s2(spark, sf):
    o, at = table(spark, sf, "orders"), fresh(spark)
    o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("int").alias("O_ORDERKEY"), F.col("o_orderkey").cast("string").alias("extra")).write.parquet(f"{at}/a")
    o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus").write.parquet(f"{at}/b")
    return files.read_months(spark, [f"{at}/a", f"{at}/b"], "o_orderkey long, extra string")


CUBE_SUMS = f"WITH {CUBE} SELECT CAST(pickup_day AS BIGINT) AS pickup_day, CAST(sum(trip_count) AS BIGINT) AS trips FROM c GROUP BY 1"


def sums(df):
    return df.groupBy(F.col("pickup_day").cast("long").alias("pickup_day")).agg(F.sum(F.col("trip_count").cast("long")).alias("trips"))


@query("k2_partitioned_parquet", CUBE_SUMS)
def k2(spark, sf):
    at = fresh(spark)
    files.write_partitioned(demand(spark, sf), at, "pickup_day")
    return sums(spark.read.parquet(at))


@query("k5_csv", CUBE_SUMS)
def k5(spark, sf):
    at = fresh(spark)
    demand(spark, sf).select("pickup_day", "trip_count").write.mode("overwrite").option("header", "true").csv(at)
    return sums(spark.read.option("header", "true").csv(at))


@query("k6_json", CUBE_SUMS)
def k6(spark, sf):
    at = fresh(spark)
    demand(spark, sf).select("pickup_day", "trip_count").write.json(at)
    return sums(spark.read.schema("pickup_day int, trip_count long").json(at))


@query("x8_medallion", CUBE_SUMS)
def x8(spark, sf):
    at = fresh(spark)
    gold = lambda d: sums(d)
    files.medallion(spark, demand(spark, sf), at, lambda d: d.dropna(), gold)
    return files.medallion(spark, demand(spark, sf), at, lambda d: d.dropna(), gold)  # again: every step is taken as it is
