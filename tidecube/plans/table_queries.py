"""Queries over the given tables of what else works on literals, files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import analytics, cleaning, cube, metrics, schema
from tidecube.operators.schema import rounded
from tidecube.plans.cleaning_queries import YEARS, counts_sql, yellow
from tidecube.plans.cube_queries import longs, r
from tidecube.plans.forecast_queries import FEATURES_SQL
from tidecube.plans.io_queries import CUBE_SUMS, sums
from tidecube.plans.proxies import CUBE, FULL_GRID, GRID, RAW_YELLOW, TRIPS, YELLOW_CHECKS, demand, full_grid, table, trips
from tidecube.sources import files
from tidecube.sources.files import fresh

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("s11_existing_paths", "SELECT 'none' AS name, false AS there UNION ALL SELECT DISTINCT lower(n_name), true FROM nation WHERE n_regionkey < 2")
def s11(spark, sf):
    """A folder for each nation of two regions; which paths and globs of all nations find something is asked, none for one that is not there."""
    at, rows = fresh(spark), table(spark, sf, "nation").withColumn("name", F.lower("n_name"))
    rows.where("n_regionkey < 2").write.partitionBy("name").parquet(at)
    names = [x["name"] for x in files.inventory(spark, at).select(F.regexp_extract(F.url_decode("path"), "name=([^/]*)", 1).alias("name")).where("name <> ''").distinct().collect()]
    found = [(n, files.exists(spark, f"{at}/name={n.replace(' ', '?')}/*.parquet")) for n in [*names, "none"]]
    return spark.createDataFrame(found, "name string, there boolean")


@query("s14_s16_copied_files", f"{CUBE_SUMS}")
def s14(spark, sf):
    """The cube's files copied by tasks, twice: what is there is skipped, an empty file is replaced."""
    at = fresh(spark)
    demand(spark, sf).repartition(4).write.parquet(f"{at}/from")
    paths = [x["path"] for x in files.inventory(spark, f"{at}/from").where("is_parquet").select("path").collect()]
    pairs = [(p, f"{at}/to/{p.rpartition('/')[2]}") for p in paths]
    files.copy_files(spark, pairs[:2])
    done = files.copy_files(spark, pairs)
    if sorted(d["action"] for d in done) != ["copied"] * (len(pairs) - 2) + ["skipped"] * 2:
        raise RuntimeError(f"copies: {done}")
    return sums(spark.read.parquet(f"{at}/to"))


@query("s24_qualified_paths", "SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 's3a://b/' || n_name ELSE 'hdfs://host:8020/raw/' || n_name END AS path FROM nation")
def s24(spark, sf):
    """Paths of nations: those with a scheme stay, others get one; Python's rule, asked once for each kind of path."""
    kept, prefixed = files.qualified("s3a://b/", "hdfs://host:8020"), files.qualified("/raw/", "hdfs://host:8020")
    return table(spark, sf, "nation").select("n_name", F.concat(F.when(F.col("n_nationkey") % 2 == 0, kept).otherwise(prefixed), "n_name").alias("path"))


@query("s15_months_of_events", """WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM events), (SELECT date_trunc('month', max(ts)) FROM events), INTERVAL 1 MONTH)) AS m)
SELECT CAST(m AS DATE) AS month_start, year(m) AS pickup_year, month(m) AS pickup_month, count(ts) AS events FROM m LEFT JOIN events ON date_trunc('month', ts) = m GROUP BY ALL""")
def s15(spark, sf):
    """Every month from the first event to the last, with its events."""
    events = table(spark, sf, "events")
    ends = events.agg(F.date_format(F.min("ts"), "yyyy-MM").alias("a"), F.date_format(F.max("ts"), "yyyy-MM").alias("b")).first()
    counts = events.groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month_start")).agg(F.count("*").alias("events"))
    return longs(files.months(spark, ends["a"], ends["b"]), "pickup_year", "pickup_month").join(counts, "month_start", "left").fillna(0, ["events"])


@query("s19_ranges_of_demand", f"WITH {CUBE} SELECT h AS pickup_hour, d AS pickup_day_of_week, CAST(coalesce(sum(trip_count), 0) AS BIGINT) AS trips FROM (SELECT unnest(generate_series(0, 23)) AS h) CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS d) LEFT JOIN (FROM c WHERE PULocationID = 3) ON h = pickup_hour AND d = pickup_day_of_week GROUP BY ALL")
def s19(spark, sf):
    """Trips of one zone for each of 24 hours and 7 weekdays, 0 where there are none."""
    grid = spark.range(24).withColumnRenamed("id", "pickup_hour").crossJoin(spark.range(1, 8).withColumnRenamed("id", "pickup_day_of_week"))
    counts = longs(demand(spark, sf).where("PULocationID = 3"), "pickup_hour", "pickup_day_of_week").groupBy("pickup_hour", "pickup_day_of_week").agg(F.sum("trip_count").alias("trips"))
    return grid.join(counts, ["pickup_hour", "pickup_day_of_week"], "left").fillna(0, ["trips"])


HOLIDAYS = [("New Year", "2024-01-01"), ("Labour Day", "2024-05-01"), ("Christmas", "2024-12-25")]


@query("s20_literal_holidays", f"WITH {TRIPS}, v AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{d}')" for n, d in HOLIDAYS) + ") v(holiday_name, pickup_date)) SELECT holiday_name, v.pickup_date, count(t.pickup) AS trips FROM v LEFT JOIN t ON t.pickup_date = v.pickup_date GROUP BY ALL")
def s20(spark, sf):
    """Rows that stand in the query, with the trips of their days."""
    days = spark.createDataFrame(HOLIDAYS, "holiday_name string, d string").select("holiday_name", F.to_date("d").alias("pickup_date"))
    counts = trips(spark, sf).groupBy("pickup_date").agg(F.count("*").alias("trips"))
    return days.join(counts, "pickup_date", "left").fillna(0, ["trips"])


HISTORIES = {"location_avg": "la", "location_hour_avg": "lh", "location_dow_hour_avg": "ld", "previous_month_location_hour_avg": "pmo"}


def sweep(spark, sf, grid=full_grid):
    """The error of each history taken as a forecast, over all zones, dates and hours from 1997 on."""
    rows = grid(spark, sf).with_history().where("pickup_year >= 1997").select("trip_count", F.inline(F.array(*[F.struct(F.lit(n.split("_")[0]).alias("model"), F.lit(n).alias("config"), F.col(n).alias("q")) for n in HISTORIES])))
    return rows.groupBy("model", "config").agg(rounded(F.sqrt(F.avg(F.pow(F.col("q") - F.col("trip_count"), 2))), 4).alias("rmse"))


SWEEP_SQL = FEATURES_SQL.replace(GRID, FULL_GRID) + ", m AS (" + " UNION ALL ".join(f"SELECT '{n.split('_')[0]}' AS model, '{n}' AS config, {r(f'sqrt(avg(({c} - trip_count) * ({c} - trip_count)))')} AS rmse FROM f WHERE pickup_year >= 1997" for n, c in HISTORIES.items()) + ")"


@query("t12_best_histories", f"{SWEEP_SQL} SELECT model, config, rmse FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY rmse, config) = 1")
def t12(spark, sf):
    return metrics.best(sweep(spark, sf), "model")


@query("s23_best_history", f"{SWEEP_SQL} SELECT config, rmse FROM m WHERE config <> 'location_avg' ORDER BY rmse, config LIMIT 1")
def s23(spark, sf):
    """The metrics of a sweep as a file with a header; of its trainable rows with an artifact the best."""
    at = fresh(spark)
    rows = sweep(spark, sf).withColumns({"selection": F.when(F.col("config") == "location_avg", "naive").otherwise("trainable"), "artifact": F.concat(F.lit("models/"), "config")})
    rows.write.option("header", "true").csv(at)
    back = spark.read.option("header", "true").schema(rows.schema).csv(at)
    return metrics.best(back.where("selection = 'trainable' and artifact is not null")).select("config", "rmse")


@query("k8_ordered_fields_of_regions", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, NULL::VARCHAR AS missing, r_name, CAST(count(*) AS VARCHAR) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def k8(spark, sf):
    """A few rows as dictionaries, as one CSV with fields in an order of its own; a field that no row has is empty."""
    at, nations = fresh(spark), table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    rows = [x.asDict() for x in table(spark, sf, "region").join(nations, "r_regionkey").collect()]
    files.write_single_csv(files.rows_frame(spark, rows, ["r_regionkey", "missing", "r_name", "n"]), at)
    return spark.read.schema("r_regionkey string, missing string, r_name string, n string").option("header", "true").csv(at)


@query("e30_clock_of_events", "SELECT (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END) || ' ' || (CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END) AS clock, count(*) AS events FROM events GROUP BY 1")
def e30(spark, sf):
    return table(spark, sf, "events").groupBy(fn.clock(F.hour("ts")).alias("clock")).agg(F.count("*").alias("events"))


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "n long, line string")


PCT = "CASE WHEN {1} = 0 THEN '0.00 %' ELSE printf('%.2f %%', 100.0 * {0} / {1}) END"
K10_SQL = f"""WITH steps AS ({counts_sql(RAW_YELLOW, YELLOW_CHECKS)}),
ends AS (SELECT (SELECT rows_before FROM steps WHERE step_order = 1) AS a, (SELECT rows_after FROM steps ORDER BY step_order DESC LIMIT 1) AS b)
SELECT 1::BIGINT AS n, '| step | before | after | removed | % |' AS line UNION ALL SELECT 2, '|---|---|---|---|---|'
UNION ALL SELECT step_order + 2, format('| {{}} | {{:,}} | {{:,}} | {{:,}} | {{}} |', step, rows_before, rows_after, rows_removed, {PCT.format('rows_removed', 'rows_before')}) FROM steps
UNION ALL SELECT {len(YELLOW_CHECKS) + 3}, format('| all | {{:,}} | {{:,}} | {{:,}} | {{}} |', a, b, a - b, {PCT.format('(a - b)', 'a')}) FROM ends"""


@query("k10_cleaning_report", K10_SQL)
def k10(spark, sf):
    """The Markdown report of the counts that came with the write, line by line."""
    cleaner = cleaning.Counted(yellow(spark, sf), cleaning.yellow_steps(YEARS))
    cleaner.written(fresh(spark))
    steps = spark.createDataFrame(cleaner.steps(), "step string, step_order long, rows_before long, rows_after long, rows_removed long")
    return lines(spark, files.cleaning_report(steps))


K11_SQL = f"""WITH {CUBE}, s AS (SELECT source_id, count(*) AS n, CAST(sum(trip_count) AS BIGINT) AS trips, avg(trip_count) AS a, count(DISTINCT PULocationID) AS zones FROM c GROUP BY 1)
SELECT format('| {{}} | {{:,}} | {{:,}} | {{}} | {{:,}} |', source_id, n, trips, printf('%.2f', a), zones) AS line FROM s UNION ALL SELECT '| trip_count | bigint |' UNION ALL SELECT '* data files: 1' UNION ALL SELECT '* k11.csv'"""


@query("k11_analysis_report", K11_SQL)
def k11(spark, sf):
    """Of the Markdown report of a published cube the lines of its sources, of one column, its files and its outputs."""
    at = fresh(spark)
    files.kept(demand(spark, sf).coalesce(1), at)
    rows = spark.read.parquet(at)
    text = files.analysis_report("demand", files.inventory(spark, at), schema.described(rows), analytics.source_summary(rows), ["k11.csv"])
    wanted = F.col("line").rlike(r"^\| [0-9]|^\| trip_count |^\* data files|^\* k11")
    return lines(spark, text).where(wanted).select("line")


@query("a11_named_cleaning_summary", f"""WITH {TRIPS}, n AS (SELECT source_id, source_name, count(*) AS k FROM t GROUP BY ALL),
m AS (SELECT CAST(source_id AS BIGINT) AS source_id, source_name, unnest(['curated_row_count', 'raw_row_count', 'removed_row_count', 'removed_pct']) AS metric, unnest([k::DOUBLE, 3.0 * k, 2.0 * k, 2.0 * k * 100.0 / (3.0 * k)]) AS value FROM n)
SELECT source_id, source_name, metric, round(value, 9) AS value FROM m""")
def a11(spark, sf):
    """cleaning_summary under the names of the published table, its share unrounded but for the last digits of a double."""
    rows = demand(spark, sf)
    raw = {x["source_id"]: 3 * x["trip_count"] for x in cube.roll_up(rows, "source_id").collect()}
    out = cube.named_summary(rows, raw, {0: "yellow", 1: "hvfhv"})
    return longs(out, "source_id").withColumn("value", F.round("value", 9))
