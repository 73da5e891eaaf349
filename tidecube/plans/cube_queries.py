"""Queries of the demand cube and its analyses (A4-A28, A52, W1, W2, T, U, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import analytics, cube
from tidecube.operators.schema import rounded
from tidecube.plans.proxies import CUBE, TRIPS, ZONES, demand, table, trips, zones

QUERIES: dict = {}
R4 = "CAST(round(CAST({} AS DECIMAL(30,10)), {}) AS DOUBLE)"


def r(x: str, digits: int = 4) -> str:
    return R4.format(x, digits)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def hour_text(df):
    return df.withColumn("pickup_hour_ts", F.date_format("pickup_hour_ts", "yyyy-MM-dd HH:mm:ss"))


INTS = ["source_id", "pickup_year", "pickup_month", "pickup_day_of_week", "pickup_hour"]
INT_SQL = "CAST(source_id AS BIGINT) AS source_id, CAST(pickup_year AS BIGINT) AS pickup_year, CAST(pickup_month AS BIGINT) AS pickup_month, CAST(pickup_day_of_week AS BIGINT) AS pickup_day_of_week, CAST(pickup_hour AS BIGINT) AS pickup_hour"
TOP_SQL = "SELECT location_id, CAST(source_id AS BIGINT) AS source_id, source_name, CAST(trip_count AS BIGINT) AS trip_count, CAST(rk AS BIGINT) AS source_rank, borough, zone FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY trip_count DESC, location_id) AS rk FROM n) LEFT JOIN z USING (location_id) WHERE rk <= 20"


@query("w1_top_zones", f"WITH {CUBE}, {ZONES}, n AS (SELECT PULocationID AS location_id, source_id, source_name, sum(trip_count) AS trip_count FROM c GROUP BY ALL) {TOP_SQL}")
def w1(spark, sf):
    return longs(cube.top_pickup_zones(demand(spark, sf), zones(spark, sf)), "source_id", "source_rank")


@query("t1_top_dropoff_zones", f"WITH {TRIPS}, {ZONES}, n AS (SELECT DOLocationID AS location_id, source_id, source_name, count(*) AS trip_count FROM t GROUP BY ALL) {TOP_SQL}")
def t1(spark, sf):
    return longs(cube.top_dropoff_zones(trips(spark, sf), zones(spark, sf)), "source_id", "source_rank")


@query("a5_demand_cube", f"WITH {CUBE} SELECT {INT_SQL}, source_name, PULocationID, pickup_date, CAST(pickup_day AS BIGINT) AS pickup_day, is_weekend, trip_count FROM c")
def a5(spark, sf):
    return longs(demand(spark, sf), *INTS, "pickup_day")


HOURLY = f"SELECT {INT_SQL}, source_name, strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS pickup_hour_ts, pickup_date, count(*) AS trip_count FROM t GROUP BY ALL"


@query("a6_hourly_demand", f"WITH {TRIPS} {HOURLY}")
def a6(spark, sf):
    return hour_text(longs(cube.hourly_demand(demand(spark, sf)), *INTS))


@query("a6_hourly_demand_raw", f"WITH {TRIPS} {HOURLY}")
def a6_raw(spark, sf):
    return hour_text(longs(cube.count_trips(trips(spark, sf), *cube.HOURLY), *INTS))


BOROUGH = f"SELECT {INT_SQL}, source_name, strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS pickup_hour_ts, pickup_date, borough, count(*) AS trip_count FROM t LEFT JOIN z ON PULocationID = location_id GROUP BY ALL"


@query("a7_borough_hourly", f"WITH {TRIPS}, {ZONES} {BOROUGH}")
def a7(spark, sf):
    return hour_text(longs(cube.borough_hourly_demand(demand(spark, sf), zones(spark, sf)), *INTS))


@query("a7_borough_hourly_raw", f"WITH {TRIPS}, {ZONES} {BOROUGH}")
def a7_raw(spark, sf):
    return hour_text(longs(cube.count_trips(cube.with_zones(trips(spark, sf), zones(spark, sf)), *cube.HOURLY, "borough"), *INTS))


@query("a8_weekend_by_hour", f"WITH {TRIPS} SELECT CAST(source_id AS BIGINT) AS source_id, source_name, CAST(pickup_hour AS BIGINT) AS pickup_hour, is_weekend, count(*) AS trip_count FROM t GROUP BY ALL")
def a8(spark, sf):
    return longs(cube.roll_up(demand(spark, sf), "source_id", "source_name", "pickup_hour", "is_weekend"), "source_id", "pickup_hour")


@query("a9_weekday_by_hour", f"WITH {TRIPS} SELECT CAST(source_id AS BIGINT) AS source_id, source_name, CAST(pickup_day_of_week AS BIGINT) AS pickup_day_of_week, CAST(pickup_hour AS BIGINT) AS pickup_hour, is_weekend, count(*) AS trip_count FROM t GROUP BY ALL")
def a9(spark, sf):
    return longs(cube.roll_up(demand(spark, sf), "source_id", "source_name", "pickup_day_of_week", "pickup_hour", "is_weekend"), "source_id", "pickup_day_of_week", "pickup_hour")


SPEED = "CASE WHEN secs > 0 THEN round(miles / (secs / 3600), 2) END"
BY_HOUR = f"SELECT source_id, source_name, pickup_hour, count(*) AS trip_count, avg(secs) AS s, avg(miles) AS m FROM t GROUP BY ALL"


@query("a10_metrics_by_hour", f"WITH {TRIPS}, h AS ({BY_HOUR}) SELECT CAST(source_id AS BIGINT) AS source_id, source_name, CAST(pickup_hour AS BIGINT) AS pickup_hour, trip_count, {r('s')} AS avg_trip_duration_seconds, {r('m')} AS avg_trip_miles FROM h")
def a10(spark, sf):
    out = cube.metrics_by_hour(trips(spark, sf))
    return longs(out, "source_id", "pickup_hour").select("source_id", "source_name", "pickup_hour", "trip_count", rounded("avg_trip_duration_seconds", 4).alias("avg_trip_duration_seconds"), rounded("avg_trip_miles", 4).alias("avg_trip_miles"))


@query("a25_weighted_metrics", f"WITH {TRIPS}, h AS ({BY_HOUR}) SELECT CAST(pickup_hour AS BIGINT) AS pickup_hour, CAST(sum(trip_count) AS BIGINT) AS trip_count, {r('sum(s * trip_count) / sum(trip_count)')} AS avg_trip_duration_seconds, {r('sum(m * trip_count) / sum(trip_count)')} AS avg_trip_miles FROM h GROUP BY 1")
def a25(spark, sf):
    return longs(analytics.weighted_metrics(cube.metrics_by_hour(trips(spark, sf))), "pickup_hour").drop("avg_speed_mph")


@query("a4_feature_profile", f"WITH {TRIPS} SELECT CAST(source_id AS BIGINT) AS source_id, source_name, f AS feature_name, count(*) AS row_count, count(v) AS non_null_count, count(*) - count(v) AS null_count, round((count(*) - count(v)) * 100.0 / count(*), 4)::DOUBLE AS null_pct FROM (SELECT source_id, source_name, unnest(['PULocationID', 'DOLocationID', 'trip_miles', 'speed_mph']) AS f, unnest([CAST(PULocationID AS DOUBLE), CAST(DOLocationID AS DOUBLE), miles, {SPEED}]) AS v FROM t) GROUP BY ALL")
def a4(spark, sf):
    return longs(cube.feature_profile(trips(spark, sf), ["PULocationID", "DOLocationID", "trip_miles", "speed_mph"]), "source_id").drop("approx_distinct_count", "data_type")


@query("a11_cleaning_summary", f"WITH {TRIPS}, n AS (SELECT source_id, source_name, count(*) AS k FROM t GROUP BY ALL), m AS (SELECT CAST(source_id AS BIGINT) AS source_id, source_name, unnest(['curated_rows', 'raw_rows', 'removed_rows', 'removed_pct']) AS metric, unnest(CASE source_id WHEN 0 THEN [k::DOUBLE, 1000000.0, 1000000.0 - k, round((1000000 - k) * 100.0 / 1000000, 4)::DOUBLE] ELSE [k::DOUBLE, NULL, NULL, NULL] END) AS value FROM n) SELECT * FROM m WHERE value IS NOT NULL")
def a11(spark, sf):
    return longs(cube.cleaning_summary(demand(spark, sf), {0: 1_000_000, 1: None}, {0: "yellow", 1: "hvfhv"}), "source_id")


@query("a12_source_summary", f"WITH {CUBE} SELECT CAST(source_id AS BIGINT) AS source_id, count(*) AS row_count, CAST(sum(trip_count) AS BIGINT) AS trips, {r('avg(trip_count)')} AS avg_trips, min(trip_count) AS min_trips, max(trip_count) AS max_trips, count(DISTINCT PULocationID) AS zones, CAST(min(pickup_year) AS BIGINT) AS first_year, CAST(max(pickup_year) AS BIGINT) AS last_year, min(pickup_date) AS first_date, max(pickup_date) AS last_date FROM c GROUP BY 1")
def a12(spark, sf):
    return longs(analytics.source_summary(demand(spark, sf)), "source_id", "first_year", "last_year")


def simple(name, keys):
    sql = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in INTS else k for k in keys)

    @query(name, f"WITH {CUBE} SELECT {sql}, CAST(sum(trip_count) AS BIGINT) AS trip_count FROM c GROUP BY ALL")
    def f(spark, sf):
        return longs(cube.roll_up(demand(spark, sf), *keys), *[k for k in keys if k in INTS])


simple("a13_hourly_by_source", ["source_id", "pickup_hour"])
simple("a15_weekday_by_source", ["source_id", "pickup_day_of_week"])
simple("a22_combined_hourly", ["pickup_hour"])
simple("a22_weekend_hourly", ["is_weekend", "pickup_hour"])
simple("a26_daily_demand", ["pickup_date", "pickup_year", "pickup_month", "pickup_day_of_week"])


@query("a14_monthly_by_source", f"WITH {CUBE} SELECT CAST(source_id AS BIGINT) AS source_id, CAST(pickup_year AS BIGINT) AS pickup_year, CAST(pickup_month AS BIGINT) AS pickup_month, strftime(pickup_date, '%Y-%m') AS year_month, CAST(sum(trip_count) AS BIGINT) AS trips FROM c GROUP BY ALL")
def a14(spark, sf):
    return longs(analytics.monthly(demand(spark, sf)), "source_id", "pickup_year", "pickup_month")


@query("a16_source_totals", f"WITH {CUBE} SELECT source_name, CAST(sum(trip_count) AS BIGINT) AS trips, min(pickup_date) AS first_date, max(pickup_date) AS last_date FROM c GROUP BY 1")
def a16(spark, sf):
    return demand(spark, sf).groupBy("source_name").agg(F.sum("trip_count").alias("trips"), F.min("pickup_date").alias("first_date"), F.max("pickup_date").alias("last_date"))


@query("a17_grand_total", f"WITH {TRIPS} SELECT count(*) AS trips FROM t")
def a17(spark, sf):
    return demand(spark, sf).agg(F.sum("trip_count").alias("trips"))


@query("a18_combined_monthly", f"WITH {CUBE} SELECT CAST(date_trunc('month', pickup_date) AS DATE) AS month_start, CAST(sum(trip_count) AS BIGINT) AS trips FROM c GROUP BY 1")
def a18(spark, sf):
    return demand(spark, sf).groupBy(F.to_date(F.date_trunc("month", "pickup_date")).alias("month_start")).agg(F.sum("trip_count").alias("trips"))


@query("a19_distribution", f"WITH v AS (SELECT value AS x FROM events), m AS (SELECT count(x) AS n, avg(x) AS mu FROM v), p AS (SELECT avg((x - mu) * (x - mu)) AS m2, avg((x - mu) * (x - mu) * (x - mu)) AS m3 FROM v, m) SELECT (SELECT n FROM m) AS n, {r('(SELECT mu FROM m)')} AS mean, (SELECT {r('stddev_samp(x)')} FROM v) AS stddev, (SELECT min(x) FROM v) AS least, (SELECT max(x) FROM v) AS most, {r('m3 / pow(m2, 1.5)')} AS skewness FROM p")
def a19(spark, sf):
    return analytics.distribution(table(spark, sf, "events"), "value")


SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@query("a20_quantiles", f"SELECT unnest({SHARES}::DOUBLE[]) AS share, unnest(quantile_disc(value, {SHARES})) AS value FROM events")
def a20(spark, sf):
    return analytics.quantiles(table(spark, sf, "events"), "value", SHARES)


@query("a21_pivot", f"WITH {CUBE}, m AS (SELECT source_name, unnest(['cells', 'trips']) AS metric, unnest([count(*), CAST(sum(trip_count) AS BIGINT)]) AS value FROM c GROUP BY 1) SELECT metric, max(value) FILTER (source_name = 'yellow') AS yellow, max(value) FILTER (source_name = 'hvfhv') AS hvfhv FROM m GROUP BY 1")
def a21(spark, sf):
    long = demand(spark, sf).groupBy("source_name").agg(F.count("*").alias("cells"), F.sum("trip_count").alias("trips")).unpivot("source_name", ["cells", "trips"], "metric", "value")
    return analytics.pivoted(long, "metric", "source_name", ["yellow", "hvfhv"], "value")


@query("a23_borough_share", f"WITH {CUBE}, {ZONES}, b AS (SELECT coalesce(borough, 'Unknown') AS borough, CAST(sum(trip_count) AS BIGINT) AS trips FROM c LEFT JOIN z ON PULocationID = location_id GROUP BY 1) SELECT borough, trips, {r('trips * 100.0 / (SELECT sum(trips) FROM b)', 2)} AS share_pct FROM b")
def a23(spark, sf):
    rows = cube.with_zones(cube.roll_up(demand(spark, sf), "PULocationID"), zones(spark, sf)).fillna("Unknown", ["borough"])
    return analytics.shares(rows, "borough", "trip_count")


@query("c18_boroughs", f"WITH {CUBE}, {ZONES} SELECT borough, CAST(sum(trip_count) AS BIGINT) AS trips FROM c JOIN z ON PULocationID = location_id WHERE borough IN ('ASIA', 'EUROPE') GROUP BY 1")
def c18(spark, sf):
    rows = cube.with_zones(demand(spark, sf), zones(spark, sf)).where(F.col("borough").isin("ASIA", "EUROPE"))
    return rows.groupBy("borough").agg(F.sum("trip_count").alias("trips"))


@query("a24_combined_top_zones", f"WITH {CUBE}, {ZONES} SELECT PULocationID, borough, zone, CAST(sum(trip_count) AS BIGINT) AS trips FROM c LEFT JOIN z ON PULocationID = location_id GROUP BY ALL ORDER BY trips DESC, PULocationID LIMIT 10")
def a24(spark, sf):
    rows = cube.roll_up(demand(spark, sf), "PULocationID").withColumnRenamed("trip_count", "trips")
    return cube.with_zones(analytics.top(rows, 10, F.desc("trips"), "PULocationID"), zones(spark, sf)).drop("location_id")


@query("t2_top_source_zones", f"WITH {CUBE} SELECT CAST(source_id AS BIGINT) AS source_id, PULocationID, CAST(sum(trip_count) AS BIGINT) AS trips FROM c GROUP BY ALL ORDER BY trips DESC, source_id, PULocationID LIMIT 20")
def t2(spark, sf):
    rows = cube.roll_up(demand(spark, sf), "source_id", "PULocationID").withColumnRenamed("trip_count", "trips")
    return longs(analytics.top(rows, 20, F.desc("trips"), "source_id", "PULocationID"), "source_id")


@query("w2_top_per_source", f"WITH {CUBE}, d AS (SELECT source_name, pickup_date, CAST(sum(trip_count) AS BIGINT) AS trips FROM c GROUP BY ALL) SELECT source_name, pickup_date, trips, CAST(row_number() OVER (PARTITION BY source_name ORDER BY trips DESC, pickup_date) AS BIGINT) AS rank FROM d QUALIFY rank <= 10")
def w2(spark, sf):
    rows = cube.roll_up(demand(spark, sf), "source_name", "pickup_date").withColumnRenamed("trip_count", "trips")
    return longs(analytics.top_per(rows, ["source_name"], 10, F.desc("trips"), "pickup_date"), "rank")


HOLIDAYS = [("New Year", d) for d in ("1996-01-01", "1997-01-01", "1998-01-01")] + [("Midsummer", d) for d in ("1996-06-24", "1997-06-24")]
HOL_SQL = "hol(holiday_name, pickup_date) AS (VALUES " + ", ".join(f"('{n}', DATE '{d}')" for n, d in HOLIDAYS) + ")"
DAYS_SQL = "days AS (SELECT CAST(o_orderdate AS DATE) AS pickup_date, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) AS d, count(*) AS trips FROM orders GROUP BY ALL)"
IMPACT_SQL = f"WITH {HOL_SQL}, {DAYS_SQL}, onday AS (SELECT * FROM days JOIN hol USING (pickup_date)), offday AS (SELECT * FROM days ANTI JOIN hol USING (pickup_date)), i AS (SELECT holiday_name, onday.pickup_date, onday.trips, {r('avg(offday.trips)', 2)} AS baseline_trips, count(offday.trips) AS baseline_days FROM onday LEFT JOIN offday USING (y, m, d) GROUP BY ALL), j AS (SELECT *, {r('(trips - baseline_trips) * 100.0 / nullif(baseline_trips, 0)', 2)} AS pct_vs_baseline FROM i)"


def impact(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("pickup_date")).groupBy("pickup_date").agg(F.count("*").alias("trips"))
    days = days.withColumns({"pickup_year": F.year("pickup_date"), "pickup_month": F.month("pickup_date"), "pickup_day_of_week": F.dayofweek("pickup_date")})
    holidays = spark.createDataFrame(HOLIDAYS, "holiday_name string, day string").select("holiday_name", F.to_date("day").alias("pickup_date"))
    return analytics.holiday_impact(days, holidays)


QUERIES["a27_holiday_impact"] = (impact, IMPACT_SQL + " SELECT * FROM j")


@query("a28_holiday_summary", IMPACT_SQL + f" SELECT holiday_name, count(*) AS days, {r('avg(trips)', 2)} AS avg_trips, {r('avg(pct_vs_baseline)', 2)} AS avg_pct FROM j GROUP BY 1")
def a28(spark, sf):
    return analytics.holiday_summary(impact(spark, sf))


@query("j9_days_without_holiday", f"WITH {HOL_SQL}, {DAYS_SQL} SELECT pickup_date, trips FROM days ANTI JOIN hol USING (pickup_date)")
def j9(spark, sf):
    holidays = spark.createDataFrame(HOLIDAYS, "holiday_name string, day string").select(F.to_date("day").alias("pickup_date"))
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("pickup_date")).agg(F.count("*").alias("trips"))
    return days.join(holidays, "pickup_date", "left_anti")


B = "CASE WHEN trip_count < 10 THEN '0-9' WHEN trip_count < 50 THEN '10-49' WHEN trip_count < 100 THEN '50-99' WHEN trip_count < 250 THEN '100-249' ELSE '250+' END"
BO = "CASE WHEN trip_count < 10 THEN 1 WHEN trip_count < 50 THEN 2 WHEN trip_count < 100 THEN 3 WHEN trip_count < 250 THEN 4 ELSE 5 END"


@query("a52_band_distribution", f"WITH d AS (SELECT CAST(o_orderdate AS DATE) AS x, count(*) AS trip_count FROM orders GROUP BY 1), b AS (SELECT {B} AS target_bin, CAST({BO} AS BIGINT) AS bin_order, count(*) AS n, sum(trip_count) AS s FROM d GROUP BY ALL) SELECT target_bin, bin_order, {r('n * 100.0 / sum(n) OVER ()', 2)} AS row_share_pct, {r('s * 100.0 / sum(s) OVER ()', 2)} AS trip_share_pct FROM b")
def a52(spark, sf):
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("trip_count"))
    return longs(analytics.band_distribution(days), "bin_order")


@query("a30_distinct_zones", f"WITH {TRIPS} SELECT DISTINCT PULocationID FROM t")
def a30(spark, sf):
    return demand(spark, sf).select("PULocationID").distinct()


@query("c21_trim_at_p99", "SELECT event_id, value FROM events WHERE value <= (SELECT quantile_disc(value, 0.99) FROM events)")
def c21(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    p99 = analytics.quantiles(e, "value", [0.99]).select(F.col("value").alias("p99"))
    return e.crossJoin(F.broadcast(p99)).where("value <= p99").drop("p99")


@query("e19_log1p", f"SELECT event_id, {r('ln(1 + value)', 6)} AS log_value FROM events")
def e19(spark, sf):
    return table(spark, sf, "events").select("event_id", rounded(F.log1p("value"), 6).alias("log_value"))


@query("u1_union_feeds", f"WITH {TRIPS} SELECT source_name, count(*) AS n FROM t GROUP BY 1")
def u1(spark, sf):
    t = trips(spark, sf)
    return t.where("source_id = 0").unionByName(t.where("source_id = 1")).groupBy("source_name").agg(F.count("*").alias("n"))


@query("e14_hour_timestamp", f"WITH {CUBE} SELECT DISTINCT strftime(CAST(pickup_date AS TIMESTAMP) + to_hours(pickup_hour), '%Y-%m-%d %H:%M:%S') AS pickup_hour_ts FROM c")
def e14(spark, sf):
    return hour_text(cube.with_hour_ts(demand(spark, sf)).select("pickup_hour_ts").distinct())


@query("e10_day_names", f"WITH {TRIPS} SELECT dayname(pickup) AS day_name, count(*) AS n FROM t GROUP BY 1")
def e10(spark, sf):
    return trips(spark, sf).groupBy(fn.label(F.col("pickup_day_of_week"), fn.DAYS, "Unknown").alias("day_name")).agg(F.count("*").alias("n"))
