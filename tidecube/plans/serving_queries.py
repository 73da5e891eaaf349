"""Queries of the serving table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.operators import guard, serving
from tidecube.operators.schema import rounded
from tidecube.plans.cube_queries import longs, r
from tidecube.plans.proxies import CUBE, ZONES, demand, zones

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


BASE = CUBE + f""", {ZONES}, b AS (SELECT CAST(source_id AS BIGINT) AS source_id, source_name, PULocationID, CAST(pickup_month AS BIGINT) AS pickup_month, CAST(pickup_day_of_week AS BIGINT) AS pickup_day_of_week, CAST(pickup_hour AS BIGINT) AS pickup_hour, {r('avg(trip_count)')} AS predicted_trip_count, any_value(is_weekend) AS is_weekend FROM c GROUP BY ALL),
q AS (SELECT quantile_cont(predicted_trip_count, [0.25, 0.5, 0.75]) AS q FROM b), s AS (SELECT b.*, coalesce(borough, 'Unknown') AS borough, coalesce(zone, 'Unknown') AS zone, CASE WHEN predicted_trip_count <= q[1] THEN 'low' WHEN predicted_trip_count <= q[2] THEN 'medium' WHEN predicted_trip_count <= q[3] THEN 'high' ELSE 'very_high' END AS demand_level FROM b CROSS JOIN q LEFT JOIN z ON PULocationID = location_id)"""


def serving_rows(spark, sf):
    return longs(serving.serving_table(demand(spark, sf), zones(spark, sf)), "source_id", "pickup_month", "pickup_day_of_week", "pickup_hour")


@query("x5_serving_table", f"WITH {BASE} SELECT * FROM s")
def x5(spark, sf):
    return serving_rows(spark, sf)


@query("a40_quartiles", "SELECT unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS quartile FROM events")
def a40(spark, sf):
    return serving.exact_quantiles(spark.read.parquet(f"{sf}/events.parquet"), "value", [0.25, 0.5, 0.75]).select(F.explode("q").alias("quartile"))


@query("x7_slice_one_source", f"WITH {BASE} SELECT PULocationID, borough, zone, predicted_trip_count, demand_level FROM s WHERE source_id = 0 AND pickup_month = 1 AND pickup_day_of_week = 2 AND pickup_hour = 8")
def x7(spark, sf):
    return serving.zone_slice(serving_rows(spark, sf), 1, 2, 8, 0)


COMBINED = f"WITH {BASE}, y AS (SELECT PULocationID, borough, zone, {r('sum(predicted_trip_count)')} AS predicted_trip_count FROM s WHERE pickup_month = 1 AND pickup_day_of_week = 2 AND pickup_hour = 8 GROUP BY ALL), k AS (SELECT quantile_cont(predicted_trip_count, [0.25, 0.5, 0.75]) AS q FROM y), w AS (SELECT y.*, CASE WHEN predicted_trip_count <= q[1] THEN 'low' WHEN predicted_trip_count <= q[2] THEN 'medium' WHEN predicted_trip_count <= q[3] THEN 'high' ELSE 'very_high' END AS demand_level FROM y CROSS JOIN k)"


def combined(spark, sf):
    return serving.zone_slice(serving_rows(spark, sf), 1, 2, 8)


QUERIES["x7_slice_combined"] = (combined, COMBINED + " SELECT * FROM w")


@query("a42_zone_profile", f"WITH {BASE} SELECT pickup_hour, {r('sum(predicted_trip_count)')} AS predicted_trip_count FROM s WHERE PULocationID = 3 AND pickup_month = 1 AND pickup_day_of_week = 2 GROUP BY 1")
def a42(spark, sf):
    return serving.zone_profile(serving_rows(spark, sf), 3, 1, 2)


@query("a43_zone_names", f"WITH {BASE} SELECT any_value(zone) AS zone, any_value(borough) AS borough FROM s WHERE PULocationID = 3")
def a43(spark, sf):
    return serving.zone_names(serving_rows(spark, sf), 3)


@query("a44_freshness", f"WITH {BASE} SELECT CAST(NULL AS TIMESTAMP) AS last_prediction, CAST(NULL AS VARCHAR) AS model_version, count(*) AS row_count FROM s")
def a44(spark, sf):
    return serving.freshness(serving_rows(spark, sf))


@query("a45_kpis", f"{COMBINED} SELECT count(DISTINCT PULocationID) AS zones, max(predicted_trip_count) AS peak, {r('avg(predicted_trip_count)')} AS mean, {r('sum(predicted_trip_count)')} AS total, (SELECT borough FROM (SELECT borough, sum(predicted_trip_count) AS v FROM w GROUP BY 1) ORDER BY v DESC, borough DESC LIMIT 1) AS top_borough FROM w")
def a45(spark, sf):
    return serving.kpis(combined(spark, sf))


@query("a46_borough_breakdown", f"{COMBINED} SELECT borough, {r('sum(predicted_trip_count)')} AS trips FROM w GROUP BY 1")
def a46(spark, sf):
    return combined(spark, sf).groupBy("borough").agg(rounded(F.sum("predicted_trip_count"), 4).alias("trips"))


@query("a47_level_counts", f"{COMBINED} SELECT demand_level, count(*) AS row_count FROM w GROUP BY 1")
def a47(spark, sf):
    return combined(spark, sf).groupBy("demand_level").agg(F.count("*").alias("row_count"))


@query("a48_histogram", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(29, floor((value - lo) * 30 / (hi - lo))) AS BIGINT) AS bin, count(*) AS row_count FROM events, e GROUP BY 1")
def a48(spark, sf):
    return serving.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("t7_peaks", f"{COMBINED}, p AS (SELECT PULocationID, predicted_trip_count FROM w ORDER BY predicted_trip_count DESC, PULocationID LIMIT 10), m AS (SELECT CASE WHEN max(predicted_trip_count) = 0 THEN 1 ELSE max(predicted_trip_count) END AS most FROM p) SELECT PULocationID, predicted_trip_count, {r('predicted_trip_count * 100 / most', 2)} AS pct_of_max, predicted_trip_count >= 0.85 * most AS is_peak FROM p, m")
def t7(spark, sf):
    return serving.peaks(combined(spark, sf))


@query("a30_filter_options", f"WITH {BASE} SELECT DISTINCT pickup_hour FROM s")
def a30(spark, sf):
    return serving.filter_options(serving_rows(spark, sf), "pickup_hour")


#: Scores of recommend() from the same cube; (x - least) / (most - least), 0 where all are alike.
SCALED = "coalesce(({0} - min({0}) OVER ()) / nullif(max({0}) OVER () - min({0}) OVER (), 0), 0.0)"
X6_SQL = f"""WITH {CUBE}, y AS (SELECT PULocationID, pickup_year, avg(trip_count) AS m FROM c GROUP BY ALL),
slope AS (SELECT PULocationID, CASE WHEN count(*) > 1 THEN regr_slope(m, pickup_year) ELSE 0.0 END AS trend_slope FROM y GROUP BY 1),
each AS (SELECT PULocationID, avg(trip_count) AS mean_demand, coalesce(stddev_samp(trip_count) / avg(trip_count), 0.0) AS demand_cv,
  sum(CASE WHEN source_id = 0 THEN trip_count ELSE 0 END) / sum(trip_count) AS yellow_share FROM c GROUP BY 1),
scored AS (SELECT *, {SCALED.format('mean_demand')} AS demand_score, 1 - {SCALED.format('demand_cv')} AS reliability_score, {SCALED.format('trend_slope')} AS growth_score, yellow_share AS source_score
  FROM each JOIN slope USING (PULocationID)),
summed AS (SELECT *, 0.4 * demand_score + 0.25 * reliability_score + 0.2 * growth_score + 0.15 * source_score AS opportunity_score FROM scored)
SELECT PULocationID, {', '.join(f"{r(x)} AS {x}" for x in 'mean_demand demand_cv trend_slope yellow_share demand_score reliability_score growth_score source_score opportunity_score'.split())},
  CASE WHEN opportunity_score >= 0.7 THEN 'top_pick' WHEN opportunity_score >= 0.5 THEN 'good' WHEN opportunity_score >= 0.3 THEN 'okay' ELSE 'avoid' END AS band
FROM summed ORDER BY round(opportunity_score, 9) DESC, PULocationID LIMIT 15"""


@query("x6_recommender", X6_SQL)
def x6(spark, sf):
    return serving.recommend(demand(spark, sf))


GUARD_CASES = [
    ("select 1", True), ("SELECT * FROM t;", True), ("  select 1  ", True), ("with a as (select 1) select * from a", True), ("select x from t limit 5 offset 2", True), ("select 'drop table' as x", True),
    ("drop table t", False), ("DELETE FROM t", False), ("insert into t values (1)", False), ("update\nt set x = 1", False), ("select 1; select 2", False), ("", False), (";", False), ("explain select 1", False), ("garbage", False), ("select * from (delete from t returning *)", False),
]


@query("x1_sql_guard", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(v).lower()})" for k, (_, v) in enumerate(GUARD_CASES)) + ") v(n, allowed)")
def x1(spark, sf):
    return spark.createDataFrame([(k, guard.is_read_only(s)) for k, (s, _) in enumerate(GUARD_CASES)], "n int, allowed boolean")


@query("x2_guarded_query", f"WITH {BASE} SELECT borough, count(*) AS n FROM s GROUP BY 1")
def x2(spark, sf):
    serving_rows(spark, sf).createOrReplaceTempView("serving_predictions")
    out = guard.run(spark, guard.extract_sql("```sql\nselect borough, count(*) as n from serving_predictions group by 1;\n```"))
    return spark.createDataFrame([(x["borough"], x["n"]) for x in out["rows"]], "borough string, n long")


@query("a49_sums_by_hour", f"WITH {BASE} SELECT pickup_hour, {r('sum(predicted_trip_count)')} AS trips FROM s WHERE borough = 'ASIA' GROUP BY 1")
def a49(spark, sf):
    return serving_rows(spark, sf).where("borough = 'ASIA'").groupBy("pickup_hour").agg(rounded(F.sum("predicted_trip_count"), 4).alias("trips"))
