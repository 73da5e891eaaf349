"""Samples, resumable steps, published tables, names and speeds, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import analytics, cube, features, metrics, models, schema
from tidecube.operators.schema import rounded
from tidecube.plans.cleaning_queries import RAW_YELLOW, STD_Y, YEARS, raw_yellow, standard
from tidecube.plans.cube_queries import SPEED, longs, r
from tidecube.plans.forecast_queries import NAIVE_SQL, naive_predictions
from tidecube.plans.io_queries import CUBE_SUMS, fresh, sums
from tidecube.plans.proxies import CUBE, FULL_GRID, GRID, TRIPS, ZONES, demand, full_grid, table, trips, zones
from tidecube.plans.serving_queries import BASE, serving_rows
from tidecube.sources import files

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


#: The 32 bits that analytics.hashed takes.
HASH = "('0x' || substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 8))::UBIGINT"
EVENT = HASH.format("event_id")


@query("t9_hash_sample", f"SELECT * FROM events WHERE {EVENT} < CAST(floor(0.1 * 4294967296) AS UBIGINT)")
def t9(spark, sf):
    return analytics.hash_sample(table(spark, sf, "events"), "event_id", 0.1)


@query("t10_balanced_sample", f"(SELECT *, 'target' AS sample_group FROM events WHERE event_type = 'click' ORDER BY {EVENT}, event_id LIMIT 100) UNION ALL (SELECT *, 'other' FROM events WHERE event_type <> 'click' ORDER BY {EVENT}, event_id LIMIT 100)")
def t10(spark, sf):
    return analytics.balanced_sample(table(spark, sf, "events"), "event_type", "click", "event_id", 100)


@query("t11_sample_then_cap", f"SELECT * FROM events WHERE {EVENT} < least(1.0, 500.0 / (SELECT count(*) FROM events)) * 4294967296 ORDER BY {EVENT}, event_id LIMIT 500")
def t11(spark, sf):
    return analytics.capped_sample(table(spark, sf, "events"), "event_id", 500)


#: Averages to one digit: engines round single speeds that end in a 5 differently.
SPEED_BY_HOUR = f"SELECT source_id, source_name, pickup_hour, count(*) AS trip_count, avg({SPEED}) AS v FROM t GROUP BY ALL"


@query("a10_speed_by_hour", f"WITH {TRIPS}, h AS ({SPEED_BY_HOUR}) SELECT CAST(source_id AS BIGINT) AS source_id, CAST(pickup_hour AS BIGINT) AS pickup_hour, {r('v', 1)} AS avg_speed_mph FROM h")
def a10(spark, sf):
    out = longs(cube.metrics_by_hour(trips(spark, sf)), "source_id", "pickup_hour")
    return out.select("source_id", "pickup_hour", rounded("avg_speed_mph", 1).alias("avg_speed_mph"))


@query("a25_weighted_speed", f"WITH {TRIPS}, h AS ({SPEED_BY_HOUR}) SELECT CAST(pickup_hour AS BIGINT) AS pickup_hour, {r('sum(v * trip_count) / sum(trip_count)', 1)} AS avg_speed_mph FROM h GROUP BY 1")
def a25(spark, sf):
    return longs(analytics.weighted_metrics(cube.metrics_by_hour(trips(spark, sf))), "pickup_hour").select("pickup_hour", rounded("avg_speed_mph", 1).alias("avg_speed_mph"))


@query("a32_evaluator", f"{NAIVE_SQL.replace(GRID, FULL_GRID)}, m AS (SELECT {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e))')} AS mae, {r('1 - sum(e * e) / (sum(a * a) - sum(a) * sum(a) / count(*))')} AS r2 FROM p) SELECT unnest(['rmse', 'mae', 'r2']) AS metric, unnest([rmse, mae, r2]) AS value FROM m")
def a32(spark, sf):
    rows = naive_predictions(spark, sf, full_grid).selectExpr("actual_trip_count as label", "predicted_trip_count as prediction")
    with models.kept(rows) as (once,):
        found = models.evaluated(once)
    return spark.createDataFrame(list(found.items()), "metric string, value double").withColumn("value", rounded("value", 4))


@query("c14_test_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1")
def c14(spark, sf):
    rows = table(spark, sf, "orders").withColumn("pickup_year", F.year("o_orderdate"))
    _train, test = models.holdout(rows, [1996, 1997], 1998)
    return test.groupBy(F.col("pickup_year").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("e29_month_names", "SELECT monthname(CAST(o_orderdate AS DATE)) AS month_name, count(*) AS n FROM orders GROUP BY 1")
def e29(spark, sf):
    return table(spark, sf, "orders").groupBy(fn.label(F.month("o_orderdate"), fn.MONTHS, "Unknown").alias("month_name")).agg(F.count("*").alias("n"))


@query("j16_default_zero", f"WITH {CUBE}, {ZONES}, p AS (SELECT PULocationID, CAST(sum(trip_count) AS BIGINT) AS n FROM c WHERE pickup_hour = 3 AND PULocationID % 2 = 0 GROUP BY 1) SELECT location_id, zone, coalesce(n, 0) AS predicted_trips FROM z LEFT JOIN p ON PULocationID = location_id")
def j16(spark, sf):
    known = demand(spark, sf).where("pickup_hour = 3 and PULocationID % 2 = 0").groupBy("PULocationID").agg(F.sum("trip_count").cast("long").alias("n"))
    z = zones(spark, sf)
    return z.join(known, z["location_id"] == known["PULocationID"], "left").select("location_id", "zone", F.coalesce("n", F.lit(0)).alias("predicted_trips"))


#: (name, type) of standardised trips, as Spark prints them.
COLUMNS = [(name, {"long": "bigint"}.get(kind, kind)) for name, kind in (x.split() for x in schema.TRIPS.split(", "))]


@query("p15_schema", f"SELECT * FROM (VALUES {', '.join(map(str, COLUMNS))}) v(column_name, data_type)")
def p15(spark, sf):
    return schema.described(standard_trips(spark, sf))


def standard_trips(spark, sf):
    return features.yellow_trips(raw_yellow(spark, sf), YEARS)


@query("s9_path_or_table", CUBE_SUMS)
def s9(spark, sf):
    at, name = fresh(spark), f"tidecube_demand_{uuid.uuid4().hex}"
    demand(spark, sf).where("pickup_day <= 15").write.parquet(at)
    files.publish(demand(spark, sf).where("pickup_day > 15"), name)
    found = [files.read_table(spark, at, name), files.read_table(spark, f"{at}-gone", name)]
    return sums(found[0].unionByName(found[1]))


@query("s12_available_sources", CUBE_SUMS)
def s12(spark, sf):
    at = fresh(spark)
    demand(spark, sf).where("source_id = 0").write.parquet(f"{at}/a")
    demand(spark, sf).where("source_id <> 0").write.parquet(f"{at}/b")
    return sums(files.combined_sources(spark, {"a": f"{at}/a", "missing": f"{at}/none", "b": f"{at}/b"}))


@query("x8_monthly_medallion", CUBE_SUMS)
def x8(spark, sf):
    at, months = fresh(spark), [f"{m:02d}" for m in range(1, 13)]
    month = lambda m: demand(spark, sf).where(F.col("pickup_month") == int(m))
    gold = lambda d: d.select("pickup_day", "trip_count")
    files.medallion_months(spark, months[:5], month, at, lambda d: d.dropna(), gold)  # as if it had broken off
    return sums(files.medallion_months(spark, months, month, at, lambda d: d.dropna(), gold))


@query("x9_resumed_pipeline", f"WITH {RAW_YELLOW} {STD_Y}")
def x9(spark, sf):
    at = fresh(spark)
    files.write_once(standard_trips(spark, sf), at)
    return standard(files.write_once(standard_trips(spark, sf), at))  # taken as it is


@query("k12_k13_published_serving", f"WITH {BASE} SELECT PULocationID, borough, predicted_trip_count, demand_level FROM s WHERE source_id = 1 AND pickup_month = 1 AND pickup_day_of_week BETWEEN 2 AND 4")
def k12(spark, sf):
    name, view = f"tidecube_serving_{uuid.uuid4().hex}", f"agg_{uuid.uuid4().hex}"
    serving_rows(spark, sf).createOrReplaceTempView(view)
    files.publish(spark.table(view), name, "source_id", ["pickup_month", "pickup_day_of_week", "pickup_hour", "PULocationID"])
    spark.catalog.dropTempView(view)
    return spark.table(name).where("source_id = 1 and pickup_month = 1 and pickup_day_of_week between 2 and 4").select("PULocationID", "borough", "predicted_trip_count", "demand_level")


@query("k8_ordered_fields", "SELECT * FROM (VALUES ('1', '0.5', NULL), ('2', NULL, NULL)) v(a, b, c)")
def k8(spark, sf):
    at = fresh(spark)
    files.write_single_csv(files.rows_frame(spark, [{"b": 0.5, "a": 1, "x": 3}, {"a": 2}], ["a", "b", "c"]), at)
    return spark.read.schema("a string, b string, c string").option("header", "true").csv(at)


@query("a31_checked", f"{NAIVE_SQL.replace(GRID, FULL_GRID)} SELECT count(*) AS n, {r('sqrt(avg(e * e))')} AS rmse FROM p")
def a31(spark, sf):
    found = metrics.checked_metrics(naive_predictions(spark, sf, full_grid), "actual_trip_count", "predicted_trip_count")
    return spark.createDataFrame([(found["n"], found["rmse"])], "n long, rmse double")
