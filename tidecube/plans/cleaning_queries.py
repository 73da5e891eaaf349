"""Queries of schema enforcement, cleaning and features (P, C, E, A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import cleaning, features, schema
from tidecube.operators.schema import rounded
from tidecube.plans.cube_queries import longs, r
from tidecube.plans.proxies import HVFHV_CHECKS, RAW_HVFHV, RAW_YELLOW, TRIPS, YELLOW_CHECKS, raw_hvfhv, raw_yellow, table, trips

QUERIES: dict = {}
YEARS = [2023, 2024]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def yellow(spark, sf):
    return schema.fill(schema.enforce(raw_yellow(spark, sf), schema.YELLOW), schema.YELLOW_FILL)


def hvfhv(spark, sf):
    return schema.fill(schema.enforce(raw_hvfhv(spark, sf), schema.HVFHV), schema.HVFHV_FILL)


def step_query(name, rows, steps, view, checks, k):
    """One filter by itself: what it keeps, by zone."""

    @query(name, f"WITH {view} SELECT PULocationID, count(*) AS n FROM {view[:2]} WHERE {checks[k][1]} GROUP BY 1")
    def f(spark, sf):
        return rows(spark, sf).where(steps(YEARS)[k][1]).groupBy("PULocationID").agg(F.count("*").alias("n"))


for _k, _n in enumerate(["c1_valid_years", "c2_time_order", "c3_duration", "c4_distance", "c5_passengers", "c6_fare", "c7_codes"]):
    step_query(_n, yellow, cleaning.yellow_steps, RAW_YELLOW, YELLOW_CHECKS, _k)
for _k, _n in enumerate(["c9_required", "c10_valid_years", "c10_time_order", "c10_distance", "c11_trip_time", "c12_fare"]):
    step_query(_n, hvfhv, cleaning.hvfhv_steps, RAW_HVFHV, HVFHV_CHECKS, _k)


def counts_sql(view, checks):
    sums = ", ".join(f"coalesce(sum(CASE WHEN {' AND '.join(f'({c})' for _, c in checks[: k + 1])} THEN 1 ELSE 0 END), 0)" for k in range(len(checks)))
    names = "[" + ", ".join(f"'{n}'" for n, _ in checks) + "]"
    return f"WITH {view}, s AS (SELECT list_value(count(*), {sums})::BIGINT[] AS n FROM {view[:2]}) SELECT unnest({names}) AS step, unnest(generate_series(1, {len(checks)})) AS step_order, unnest(n[:-2]) AS rows_before, unnest(n[2:]) AS rows_after, unnest(n[:-2]) - unnest(n[2:]) AS rows_removed FROM s"


@query("c8_yellow_step_counts", counts_sql(RAW_YELLOW, YELLOW_CHECKS))
def c8(spark, sf):
    return cleaning.step_counts(yellow(spark, sf), cleaning.yellow_steps(YEARS))


@query("c13_hvfhv_step_counts", counts_sql(RAW_HVFHV, HVFHV_CHECKS))
def c13(spark, sf):
    return cleaning.step_counts(hvfhv(spark, sf), cleaning.hvfhv_steps(YEARS))


ALL_Y, ALL_H = (" AND ".join(f"({c})" for _, c in checks) for checks in (YELLOW_CHECKS, HVFHV_CHECKS))
STD_Y = f"SELECT CAST(0 AS BIGINT) AS source_id, PULocationID, DOLocationID, strftime(pickup, '%Y-%m-%d %H:%M:%S') AS pickup, CAST(hour(pickup) AS BIGINT) AS pickup_hour, CAST(dayofweek(pickup) + 1 AS BIGINT) AS pickup_day_of_week, dayofweek(pickup) IN (0, 6) AS is_weekend, CAST(secs AS DOUBLE) AS trip_duration_seconds, trip_distance AS trip_miles FROM ry WHERE {ALL_Y}"
STD_H = f"SELECT CAST(1 AS BIGINT) AS source_id, PULocationID, DOLocationID, strftime(pickup, '%Y-%m-%d %H:%M:%S') AS pickup, CAST(hour(pickup) AS BIGINT) AS pickup_hour, CAST(dayofweek(pickup) + 1 AS BIGINT) AS pickup_day_of_week, dayofweek(pickup) IN (0, 6) AS is_weekend, CAST(secs AS DOUBLE) AS trip_duration_seconds, miles AS trip_miles FROM rh WHERE {ALL_H}"


def standard(df):
    return longs(df, "source_id", "pickup_hour", "pickup_day_of_week").select("source_id", "PULocationID", "DOLocationID", F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss").alias("pickup"), "pickup_hour", "pickup_day_of_week", "is_weekend", "trip_duration_seconds", "trip_miles")


@query("x9_yellow_pipeline", f"WITH {RAW_YELLOW} {STD_Y}")
def x9(spark, sf):
    return standard(features.yellow_trips(raw_yellow(spark, sf), YEARS))


@query("x10_hvfhv_pipeline", f"WITH {RAW_HVFHV} {STD_H}")
def x10(spark, sf):
    return standard(features.hvfhv_trips(raw_hvfhv(spark, sf), YEARS))


@query("s12_combined_feeds", f"WITH {RAW_YELLOW}, {RAW_HVFHV} {STD_Y} UNION ALL {STD_H}")
def s12(spark, sf):
    return standard(features.combined(features.yellow_trips(raw_yellow(spark, sf), YEARS), features.hvfhv_trips(raw_hvfhv(spark, sf), YEARS)))


@query("p1_enforced_schema", f"WITH {RAW_YELLOW} SELECT VendorID, PULocationID, CAST(NULL AS VARCHAR) AS store_and_fwd_flag, airport_fee::DOUBLE AS airport_fee FROM ry")
def p1(spark, sf):
    return schema.enforce(raw_yellow(spark, sf), schema.YELLOW).select("VendorID", "PULocationID", "store_and_fwd_flag", "airport_fee")


@query("p5_yellow_fill", f"WITH {RAW_YELLOW} SELECT coalesce(passenger_count, 1.0)::DOUBLE AS passenger_count, coalesce(RatecodeID, 1.0)::DOUBLE AS ratecode, 0.0::DOUBLE AS congestion_surcharge, coalesce(airport_fee, 0.0)::DOUBLE AS airport_fee, 'N' AS store_and_fwd_flag, count(*) AS n FROM ry GROUP BY ALL")
def p5(spark, sf):
    rows = yellow(spark, sf).withColumnRenamed("RatecodeID", "ratecode")
    return rows.groupBy("passenger_count", "ratecode", "congestion_surcharge", "airport_fee", "store_and_fwd_flag").agg(F.count("*").alias("n"))


@query("p6_hvfhv_fill", f"WITH {RAW_HVFHV} SELECT 'Unknown' AS originating_base_num, 0.0::DOUBLE AS tips, 'N' AS wav_match_flag, count(*) AS n FROM rh")
def p6(spark, sf):
    return hvfhv(spark, sf).groupBy("originating_base_num", "tips", "wav_match_flag").agg(F.count("*").alias("n"))


@query("p7_dropna", "SELECT count(*) AS n FROM (SELECT nullif(event_id % 4, 0) AS a, nullif(event_id % 3, 0) AS b FROM events) WHERE a IS NOT NULL AND b IS NOT NULL")
def p7(spark, sf):
    return table(spark, sf, "events").selectExpr("nullif(event_id % 4, 0) as a", "nullif(event_id % 3, 0) as b").dropna(subset=["a", "b"]).agg(F.count("*").alias("n"))


@query("a1_null_audit", f"WITH {RAW_YELLOW} SELECT unnest(['passenger_count', 'RatecodeID', 'payment_type', 'airport_fee', 'PULocationID']) AS column_name, unnest([count(*) - count(passenger_count), count(*) - count(RatecodeID), count(*) - count(payment_type), count(*) - count(airport_fee), 0]) AS null_count FROM ry")
def a1(spark, sf):
    return cleaning.null_audit(schema.enforce(raw_yellow(spark, sf), schema.YELLOW), ["passenger_count", "RatecodeID", "payment_type", "airport_fee", "PULocationID"])


@query("a2_quality_checks", f"WITH {TRIPS} SELECT count(*) AS row_count, count_if(pickup IS NULL) AS null_pickup, count_if(dropoff IS NULL) AS null_dropoff, count_if(PULocationID IS NULL) AS null_pu, count_if(DOLocationID IS NULL) AS null_do, count_if(dropoff <= pickup) AS bad_order, count_if(secs < 60) AS too_short, count_if(secs > 10800) AS too_long, count_if(miles <= 0) AS no_distance, count_if(miles > 100) AS too_far, count_if(pickup_year NOT IN (2023, 2024)) AS bad_year FROM t")
def a2(spark, sf):
    return cleaning.quality_checks(trips(spark, sf), YEARS)


@query("x11_validate", QUERIES["a2_quality_checks"][1])
def x11(spark, sf):
    t = trips(spark, sf)
    return cleaning.validate(t, t.columns, YEARS)


@query("a3_rows_by_year_source", f"WITH {TRIPS} SELECT CAST(pickup_year AS BIGINT) AS pickup_year, source_name, count(*) AS row_count FROM t GROUP BY ALL")
def a3(spark, sf):
    return longs(cleaning.rows_by(trips(spark, sf), "pickup_year", "source_name"), "pickup_year")


@query("e6_speed", f"WITH {TRIPS} SELECT PULocationID, count(*) AS n, count(CASE WHEN secs > 0 THEN 1 END) AS moving, {r('sum(CASE WHEN secs > 0 THEN miles / (secs / 3600) END) / count(CASE WHEN secs > 0 THEN 1 END)', 2)} AS avg_speed FROM t GROUP BY 1")
def e6(spark, sf):
    t, s = trips(spark, sf), F.col("trip_duration_seconds")
    return t.groupBy("PULocationID").agg(F.count("*").alias("n"), F.count("speed_mph").alias("moving"), rounded(F.avg(F.when(s > 0, F.col("trip_miles") / (s / 3600))), 2).alias("avg_speed"))


def case(column, names, other):
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


@query("e7_e9_labels", f"WITH {RAW_YELLOW} SELECT {case('payment_type', fn.PAYMENT, 'Other')} AS payment_type_label, {case('coalesce(RatecodeID, 1)', fn.RATECODE, 'Other')} AS ratecode_label, {case('VendorID', fn.VENDOR, 'Unknown')} AS vendor_label, count(*) AS n FROM ry GROUP BY ALL")
def e7(spark, sf):
    rows = features.with_labels(yellow(spark, sf).withColumn("pickup_day_of_week", F.dayofweek("tpep_pickup_datetime")))
    return rows.groupBy("payment_type_label", "ratecode_label", "vendor_label").agg(F.count("*").alias("n"))


@query("e11_company", f"WITH {RAW_HVFHV} SELECT {case('license', fn.COMPANY, 'Other')} AS company, count(*) AS n FROM rh GROUP BY 1")
def e11(spark, sf):
    return hvfhv(spark, sf).groupBy(fn.label(F.col("hvfhs_license_num"), fn.COMPANY, "Other").alias("company")).agg(F.count("*").alias("n"))


@query("e4_time_parts", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(hour(ts) AS BIGINT) AS h, CAST(dayofweek(ts) + 1 AS BIGINT) AS dow, CAST(year(ts) * 12 + month(ts) AS BIGINT) AS month_index, strftime(ts, '%Y-%m') AS year_month, CAST(CASE month(ts) WHEN 1 THEN 12 ELSE month(ts) - 1 END AS BIGINT) AS previous FROM events")
def e4(spark, sf):
    t = features.with_time_parts(table(spark, sf, "events"), "ts")
    y, m = F.col("pickup_year"), F.col("pickup_month")
    return longs(t.select("event_id", y.alias("y"), m.alias("m"), F.col("pickup_hour").alias("h"), F.col("pickup_day_of_week").alias("dow"), fn.month_index(y, m).alias("month_index"), fn.year_month(y, m).alias("year_month"), fn.previous_month(m).alias("previous")), "y", "m", "h", "dow", "month_index", "previous")


@query("e15_make_date", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def e15(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.year("ts").alias("pickup_year"), F.month("ts").alias("pickup_month"), F.dayofmonth("ts").alias("pickup_day"))
    return schema.with_day(rows).select("event_id", F.col("pickup_date").alias("d"))


@query("e22_e24_bands", "SELECT event_id, CASE WHEN value < 20 THEN 'low' WHEN value < 50 THEN 'medium' WHEN value < 100 THEN 'high' ELSE 'very_high' END AS band, CASE WHEN value < 10 THEN '0-9' WHEN value < 50 THEN '10-49' WHEN value < 100 THEN '50-99' WHEN value < 250 THEN '100-249' ELSE '250+' END AS bucket, greatest(value - 30, 0.0)::DOUBLE AS clamped FROM events")
def e22(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", fn.fixed_band(v).alias("band"), fn.demand_bucket(v).alias("bucket"), fn.non_negative(v - 30).alias("clamped"))


@query("e28_age", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s ago' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hr ago' ELSE (s // 86400) || ' d ago' END AS age FROM (SELECT event_id, CAST(floor(value * value * 10) AS BIGINT) AS s FROM events)")
def e28(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.age(F.floor(F.col("value") * F.col("value") * 10)).alias("age"))


@query("e30_clock", "SELECT h AS hour, (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || ' ' || (CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END) AS clock FROM (SELECT unnest(generate_series(0, 23)) AS h)")
def e30(spark, sf):
    return spark.range(24).select(F.col("id").alias("hour"), fn.clock(F.col("id")).alias("clock"))


@query("e32_xml_escape", "SELECT event_id, replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM events")
def e32(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.xml_escape(F.col("props")).alias("escaped"))


@query("e27_prefix", "SELECT p_partkey, p_name[:20] AS prefix FROM part")
def e27(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.substring("p_name", 1, 20).alias("prefix"))


@query("p11_normalised_demand", f"WITH {TRIPS} SELECT CAST(PULocationID AS BIGINT) AS PULocationID, CAST(pickup_hour AS BIGINT) AS pickup_hour, CAST(is_weekend AS BIGINT) AS is_weekend_int, count(*)::DOUBLE AS label FROM t GROUP BY ALL")
def p11(spark, sf):
    rows = trips(spark, sf).groupBy("PULocationID", "pickup_year", "pickup_month", "pickup_hour", "pickup_day_of_week", "is_weekend").agg(F.count("*").alias("trip_count"))
    out = schema.normalise_demand(rows).groupBy("PULocationID", "pickup_hour", "is_weekend_int").agg(F.sum("label").alias("label"))
    return longs(out, "PULocationID", "pickup_hour", "is_weekend_int")


@query("c15_date_stride", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofyear(o_orderdate) % 7 = 1")
def c15(spark, sf):
    from tidecube.operators.forecast import modelling_dates

    return modelling_dates(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("pickup_date")), 7).withColumnRenamed("pickup_date", "d")
