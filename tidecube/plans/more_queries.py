"""The rest of the inventory: single joins, filters, sorts, sinks and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecube.operators import cube, forecast, metrics, models, schema, serving
from tidecube.operators.schema import rounded
from tidecube.plans.cube_queries import INTS, longs, r
from tidecube.plans.forecast_queries import ERRORS, NAIVE_SQL, naive_predictions
from tidecube.plans.io_queries import CUBE_SUMS, fresh, sums
from tidecube.plans.proxies import CUBE, GRID, ORDERS, TRIPS, ZONES, also_full, demand, full_grid, orders_demand, orders_grid, table, trips, zones
from tidecube.plans.serving_queries import BASE, serving_rows
from tidecube.sources import files

QUERIES: dict = {}


def query(name: str, sql: str | None, full_sql: str | None = None):
    def add(f):
        if sql and GRID in sql:
            also_full(QUERIES, name, f, sql, full_sql)
        else:
            QUERIES[name] = (f, sql)
        return f

    return add


@query("s1_parquet_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def s1(spark, sf):
    return spark.read.option("mergeSchema", "false").parquet(f"{sf}/lineitem.parquet").where("l_quantity > 30").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s7_zone_lookup", f"WITH {ZONES} SELECT location_id, borough, zone, zone AS service_zone FROM z")
def s7(spark, sf):
    at = fresh(spark)
    zones(spark, sf).select(F.col("location_id").alias("LocationID"), F.col("borough").alias("BOROUGH"), F.col("zone").alias("Zone")).write.option("header", "true").csv(at)
    return files.read_zones(spark, at)


@query("s10_catalog_table", CUBE_SUMS)
def s10(spark, sf):
    name = f"tidecube_demand_{uuid.uuid4().hex}"
    files.publish(demand(spark, sf), name)  # also k4
    return sums(spark.table(name))


@query("s20_literal_rows", "SELECT * FROM (VALUES ('New Year', DATE '2024-01-01'), ('Christmas', DATE '2024-12-25')) v(holiday_name, pickup_date)")
def s20(spark, sf):
    return spark.createDataFrame([("New Year", "2024-01-01"), ("Christmas", "2024-12-25")], "holiday_name string, d string").select("holiday_name", F.to_date("d").alias("pickup_date"))


@query("s23_best_metric_row", "SELECT 'b' AS config, 1.5::DOUBLE AS rmse")
def s23(spark, sf):
    at = fresh(spark)
    spark.createDataFrame([("a", "trainable", 2.0, "m"), ("b", "trainable", 1.5, "m"), ("c", "naive", 1.0, "m"), ("d", "trainable", 0.5, None)], "config string, selection string, rmse double, artifact string").write.option("header", "true").csv(at)
    rows = spark.read.option("header", "true").schema("config string, selection string, rmse double, artifact string").csv(at)
    return metrics.best(rows.where("selection = 'trainable' and artifact is not null")).select("config", "rmse")


@query("k1_k3_parquet", CUBE_SUMS)
def k1(spark, sf):
    at = fresh(spark)
    demand(spark, sf).write.mode("overwrite").parquet(at)
    return sums(spark.read.parquet(at))


@query("p2_standardised", f"WITH {TRIPS} SELECT CAST(source_id AS BIGINT) AS source_id, PULocationID, secs AS trip_duration_seconds FROM t")
def p2(spark, sf):
    return longs(schema.standardise(trips(spark, sf).withColumn("extra", F.lit(1))).select("source_id", "PULocationID", "trip_duration_seconds"), "source_id")


@query("p9_p10_unknown_borough", f"WITH {CUBE}, {ZONES} SELECT coalesce(borough, 'Unknown') AS borough, count(*) AS n FROM c LEFT JOIN z ON PULocationID = location_id GROUP BY 1")
def p9(spark, sf):
    return cube.with_zones(demand(spark, sf), zones(spark, sf)).fillna({"borough": "Unknown"}).groupBy("borough").agg(F.count("*").alias("n"))


@query("c14_year_split", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1")
def c14(spark, sf):
    rows = table(spark, sf, "orders").withColumn("pickup_year", F.year("o_orderdate"))
    train, _test = models.holdout(rows, [1996, 1997], 1998)
    return train.groupBy(F.col("pickup_year").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("c16_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def c16(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("c17_null_pairs", "SELECT count(*) AS n FROM (SELECT nullif(event_id % 5, 0) AS a, nullif(event_id % 3, 0) AS b FROM events) WHERE a IS NOT NULL AND b IS NOT NULL")
def c17(spark, sf):
    rows = table(spark, sf, "events").selectExpr("cast(nullif(event_id % 5, 0) as double) as label", "cast(nullif(event_id % 3, 0) as double) as prediction")
    return metrics.regression_metrics(rows).select("n")


@query("c19_parameterised_slice", f"WITH {BASE} SELECT PULocationID, predicted_trip_count FROM s WHERE source_id = 1 AND pickup_month = 1 AND pickup_day_of_week = 3 AND pickup_hour = 12")
def c19(spark, sf):
    serving_rows(spark, sf).createOrReplaceTempView("serving_slice")
    text = "select PULocationID, predicted_trip_count from serving_slice where source_id = :source and pickup_month = :month and pickup_day_of_week = :dow and pickup_hour = :hour"
    return spark.sql(text, args={"source": 1, "month": 1, "dow": 3, "hour": 12})


@query("c20_inequalities", f"WITH {CUBE} SELECT count(*) AS n FROM c WHERE source_id <> 0 AND trip_count > 1")
def c20(spark, sf):
    return demand(spark, sf).where("source_id <> 0 and trip_count > 1").agg(F.count("*").alias("n"))


@query("e20_error_terms", f"SELECT l_linenumber, {r('sqrt(avg(pow(l_discount - l_tax, 2)))', 6)} AS rmse, {r('avg(abs(l_discount - l_tax))', 6)} AS mae FROM lineitem GROUP BY 1")
def e20(spark, sf):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(rounded(F.sqrt(F.avg(F.pow(e, 2))), 6).alias("rmse"), rounded(F.avg(F.abs(e)), 6).alias("mae"))


@query("c2_shipped_after_order", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def c2(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).where("l_shipdate > o_orderdate").agg(F.count("*").alias("n"))


@query("j2_trips_with_zones", f"WITH {TRIPS}, {ZONES} SELECT zone, count(*) AS n FROM t LEFT JOIN z ON PULocationID = location_id GROUP BY 1")
def j2(spark, sf):
    return cube.with_zones(trips(spark, sf), zones(spark, sf)).groupBy("zone").agg(F.count("*").alias("n"))


@query("j4_grid_join", f"WITH {GRID} SELECT count(*) AS n, sum(trip_count) AS trips, count_if(trip_count = 0) AS zeros FROM g")
def j4(spark, sf, grid=orders_grid):
    return grid(spark, sf).rows().agg(F.count("*").alias("n"), F.sum("trip_count").alias("trips"), F.count_if(F.col("trip_count") == 0).alias("zeros"))


@query("j8_holiday_orders", "SELECT holiday_name, count(*) AS n FROM orders JOIN (VALUES ('Midsummer', DATE '1996-06-24'), ('New Year', DATE '1997-01-01')) h(holiday_name, d) ON CAST(o_orderdate AS DATE) = d GROUP BY 1")
def j8(spark, sf):
    days = spark.createDataFrame([("Midsummer", "1996-06-24"), ("New Year", "1997-01-01")], "holiday_name string, t string").select("holiday_name", F.to_date("t").alias("d"))
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")).join(days, "d").groupBy("holiday_name").agg(F.count("*").alias("n"))


@query("j14_scalar_cross_join", "SELECT event_id, value > (SELECT quantile_cont(value, 0.5) FROM events) AS above FROM events")
def j14(spark, sf):
    e = table(spark, sf, "events")
    return e.crossJoin(F.broadcast(serving.exact_quantiles(e, "value", [0.25, 0.5, 0.75]))).select("event_id", (F.col("value") > F.col("q")[1]).alias("above"))


@query("a29_source_agnostic", f"WITH {CUBE} SELECT PULocationID, pickup_date, CAST(pickup_hour AS BIGINT) AS pickup_hour, sum(trip_count)::DOUBLE AS trip_count FROM c GROUP BY ALL")
def a29(spark, sf):
    return longs(forecast.source_free_demand(demand(spark, sf)), "pickup_hour")


@query("a37_location_accuracy", f"{NAIVE_SQL} SELECT PULocationID, {ERRORS} FROM p GROUP BY 1")
def a37(spark, sf, grid=orders_grid):
    return metrics.by_keys(naive_predictions(spark, sf, grid), "PULocationID")


@query("a39_baseline", f"WITH {CUBE} SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in INTS if c != 'pickup_year')}, source_name, PULocationID, {r('avg(trip_count)')} AS predicted_trip_count, any_value(is_weekend) AS is_weekend FROM c GROUP BY ALL")
def a39(spark, sf):
    return longs(serving.baseline(demand(spark, sf)), *[c for c in INTS if c != "pickup_year"])


@query("a50_file_sizes", None)
def a50(spark, sf):
    return files.inventory(spark, sf).where("is_parquet").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("a51_count", "SELECT count(*) AS n FROM customer")
def a51(spark, sf):
    return table(spark, sf, "customer").agg(F.count("*").alias("n"))


@query("t5_mixed_order", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 50")
def t5(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey").limit(50)


@query("f2_modelling_dates", f"WITH {ORDERS} SELECT DISTINCT pickup_date FROM o WHERE dayofyear(pickup_date) % 30 = 1")
def f2(spark, sf):
    return forecast.modelling_dates(orders_demand(spark, sf), 30)


@query("f7_naive_baseline", f"{NAIVE_SQL} SELECT PULocationID, pickup_date, CAST(pickup_hour AS BIGINT) AS pickup_hour, q AS prediction FROM p")
def f7(spark, sf, grid=orders_grid):
    rows = models.naive(naive_predictions(spark, sf, grid)).select("PULocationID", "pickup_date", "pickup_hour", rounded("prediction", 4).alias("prediction"))
    return longs(rows, "pickup_hour")


def labelled(rows):
    return rows.withColumns({"label": F.col("trip_count"), "zone": F.col("PULocationID").cast("string"), "is_weekend_int": F.col("is_weekend").cast("int")})


def with_features(spark, sf):
    return labelled(full_grid(spark, sf).with_history())


@query("m7_plain_forest", None)
def m7(spark, sf):
    names = ["PULocationID", "pickup_year", "pickup_month", "pickup_hour", "pickup_day_of_week", "is_weekend_int"]
    train, test = models.holdout(labelled(full_grid(spark, sf).rows()), [1996, 1997, 1998, 1999], 2000)  # needs no history
    with models.kept(models.spread(train.select("label", *names))) as (fit_on,):
        model = models.plain_forest(fit_on, names)
    return metrics.regression_metrics(model.transform(test))


@query("m8_saved_model_holdout", None)
def m8(spark, sf):
    train, test = models.holdout(with_features(spark, sf), [1996, 1997, 1998, 1999], 2000)
    with models.kept(models.spread(train.select("label", "zone", *models.NUMBERS))) as (fit_on,):
        model = models.saved(models.fit(fit_on, models.configurations()["linear_ridge"]), fresh(spark))  # also k14
    return models.scored_holdout(model, test).select("PULocationID", "pickup_date", "pickup_hour", "actual_trip_count", "predicted_trip_count", "prediction_error", "absolute_error")


@query("m9_refit_forecast", None)
def m9(spark, sf):
    full = full_grid(spark, sf)
    with models.kept(models.spread(with_features(spark, sf).select("label", "zone", *models.NUMBERS))) as (fit_on,):
        model = models.fit(fit_on, models.configurations()["linear_plain"])
    target = forecast.forecast_features(forecast.serving_grid(full.zones, 2002, [1, 2]), full).withColumn("zone", F.col("PULocationID").cast("string"))
    out = forecast.scored(model.transform(target).drop("zone"), zones(spark, sf))
    return out.select("PULocationID", "borough", "zone", "pickup_year", "pickup_month", "pickup_day_of_week", "pickup_hour", "predicted_trip_count", "demand_level").withColumn("prediction_timestamp", F.current_timestamp())
