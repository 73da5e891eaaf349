"""Queries of what is published and kept up to date: versions, refreshed cubes, file ledgers, guarded texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecube.operators import cleaning, cube, guard, sketches
from tidecube.plans.cleaning_queries import YEARS, counts_sql, hvfhv, yellow
from tidecube.plans.cube_queries import SPEED, longs
from tidecube.plans.proxies import CUBE, HVFHV_CHECKS, RAW_HVFHV, RAW_YELLOW, TRIPS, YELLOW_CHECKS, demand, table, trips
from tidecube.sources import layout
from tidecube.sources.files import fresh, kept
from tidecube.sources.versions import VersionedTable
from tidecube.streaming.ledger import MONTH, Medallion, refresh_cube

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


CELLS = ["source_id", "PULocationID", "pickup_date", "pickup_hour", "trip_count"]
CELLS_SQL = f"WITH {CUBE} SELECT CAST(source_id AS BIGINT) AS source_id, PULocationID, pickup_date, CAST(pickup_hour AS BIGINT) AS pickup_hour, trip_count FROM c"


def cells(df):
    return longs(df.select(*CELLS), "source_id", "pickup_hour")


@query("a5_refreshed_cube", CELLS_SQL)
def a5(spark, sf):
    """A cube of trips until the 20th of each month, to which those of later days, and some of early ones, come late."""
    late = (F.dayofmonth("pickup_date") > 20) | (F.col("DOLocationID") % 7 == 3)
    rows, published = trips(spark, sf), VersionedTable(spark, fresh(spark))
    published.replace(cube.demand_cube(rows.where(~F.coalesce(late, F.lit(False)))), MONTH)
    refresh_cube(published, rows.where(late), ("late", 0))
    refresh_cube(published, rows.where(late), ("late", 0))  # again: it is there
    return cells(published.read())


@query("x8_file_ledger", CELLS_SQL)
def x8(spark, sf):
    """Two updates of the medallion from one folder, the second of files that came after the first."""
    at, rows = fresh(spark), trips(spark, sf)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    lake = Medallion(spark, f"{at}/lake", lambda df: df.dropna(subset=["PULocationID", "pickup_date"]))
    for half in ("source_id = 0", "source_id <> 0"):
        rows.where(half).write.mode("append").parquet(f"{at}/raw")
        lake.update(f"{at}/raw", schema)
    return cells(lake.gold.read())


@query("k4_versions", f"WITH {CUBE} SELECT 1 AS version, CAST(pickup_day AS BIGINT) AS pickup_day, CAST(sum(trip_count) AS BIGINT) AS trips FROM c WHERE source_id = 0 GROUP BY ALL UNION ALL SELECT 2, CAST(pickup_day AS BIGINT), CAST(sum(trip_count) AS BIGINT) FROM c GROUP BY ALL")
def k4(spark, sf):
    """Two versions of a table, read side by side."""
    published, rows = VersionedTable(spark, fresh(spark)), demand(spark, sf)
    sums = lambda df: df.groupBy(F.col("pickup_day").cast("long").alias("pickup_day")).agg(F.sum("trip_count").cast("long").alias("trips"))
    published.replace(sums(rows.where("source_id = 0")))
    published.replace(sums(rows))
    return published.read(1).withColumn("version", F.lit(1)).unionByName(published.read().withColumn("version", F.lit(2)))


#: Texts and, where they are to run, what DuckDB counts for the same text.
TEXTS = [
    ("select * from nation", True), ("with a as (select n_regionkey k, count(*) n from nation group by 1) select * from a join region on k = r_regionkey where n > 4", True),
    ("select c_mktsegment, avg(c_acctbal) from customer group by 1 having count(*) > 1 order by 2 desc;", True), ("select n_name from nation union select r_name from region", True),
    ("select n_name, row_number() over (partition by n_regionkey order by n_name) as k from nation", True), ("select 'drop table nation' as words from region", True),
    ("select * from customer where c_acctbal > (select avg(c_acctbal) from customer)", True),
    ("select identifier('ref' || 'lect')('java.util.UUID', 'randomUUID') from nation", False), ("select java_method('java.util.UUID', 'randomUUID') from nation", False), ("select * from orders", False),
    ("select * from text.`/etc/hosts`", False), ("select input_file_name() from nation", False), ("select * from range(3)", False), ("select * from nation; select 1", False), ("drop table nation", False),
    ("select * from (delete from nation)", False), ("create table x as select * from nation", False),
]


@query("x1_guarded_texts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS n, {str(ok).lower()} AS allowed, {'(SELECT count(*) FROM (' + text.rstrip(';') + '))' if ok else 'CAST(NULL AS BIGINT)'} AS row_count" for k, (text, ok) in enumerate(TEXTS)) + ")")
def x1(spark, sf):
    """Texts over views of nation, region and customer: whether each is allowed, and its rows."""
    known = {name: table(spark, sf, name) for name in ("nation", "region", "customer")}
    out = None
    for k, (text, _) in enumerate(TEXTS):
        row = spark.range(1).select(F.lit(k).alias("n"))
        try:
            counted = guard.checked(spark, text, known).agg(F.count("*").alias("row_count"))
            one = row.crossJoin(counted).select("n", F.lit(True).alias("allowed"), "row_count")
        except guard.Refused:
            one = row.select("n", F.lit(False).alias("allowed"), F.lit(None).cast("long").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query("k13_clustered_slice", f"WITH {CUBE} SELECT CAST(source_id AS BIGINT) AS source_id, PULocationID, pickup_date, CAST(pickup_hour AS BIGINT) AS pickup_hour, trip_count FROM c WHERE (PULocationID = 7 AND pickup_day_of_week IN (2, 3)) OR (pickup_hour = 5 AND pickup_month = 1)")
def k13(spark, sf):
    """Two slices by different columns of a cube that lies along a curve of four."""
    at = fresh(spark)
    layout.write_clustered(demand(spark, sf), at, ["PULocationID", "pickup_month", "pickup_day_of_week", "pickup_hour"], bits=5, bloom=["PULocationID"])
    return cells(spark.read.parquet(at).where("(PULocationID = 7 and pickup_day_of_week in (2, 3)) or (pickup_hour = 5 and pickup_month = 1)"))


def observed_counts(spark, rows, steps):
    cleaner = cleaning.Counted(rows, steps)
    cleaner.written(fresh(spark))
    return spark.createDataFrame(cleaner.steps(), "step string, step_order long, rows_before long, rows_after long, rows_removed long")


@query("c8_observed_counts", counts_sql(RAW_YELLOW, YELLOW_CHECKS))
def c8(spark, sf):
    """Step counts of the job that writes the cleaned rows."""
    return observed_counts(spark, yellow(spark, sf), cleaning.yellow_steps(YEARS))


@query("c13_observed_counts", counts_sql(RAW_HVFHV, HVFHV_CHECKS))
def c13(spark, sf):
    return observed_counts(spark, hvfhv(spark, sf), cleaning.hvfhv_steps(YEARS))


PROFILED = ["PULocationID", "DOLocationID", "trip_miles", "speed_mph"]
PROFILE_SQL = f"""WITH {TRIPS} SELECT CAST(source_id AS BIGINT) AS source_id, source_name, f AS feature_name, count(*) AS row_count, count(v) AS non_null_count, round((count(*) - count(v)) * 100.0 / count(*), 4)::DOUBLE AS null_pct, true AS distinct_near, true AS quartiles_near
FROM (SELECT source_id, source_name, unnest({PROFILED}) AS f, unnest([CAST(PULocationID AS DOUBLE), CAST(DOLocationID AS DOUBLE), miles, {SPEED}]) AS v FROM t WHERE pickup_year = 2024 AND pickup_month BETWEEN 1 AND 6) GROUP BY ALL"""


@query("a4_sketched_profile", PROFILE_SQL)
def a4(spark, sf):
    """A profile of half a year from monthly sketches, and whether it is as near to the exact one as the sketches promise."""
    rows = trips(spark, sf)
    monthly = kept(sketches.monthly_sketches(rows, PROFILED), fresh(spark))
    found = sketches.profile(monthly, "2024-01", "2024-06")
    values = rows.where("pickup_year = 2024 and pickup_month between 1 and 6").select("source_id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("v")) for c in PROFILED])))
    exact = values.groupBy("source_id", "feature_name").agg(F.count_distinct("v").alias("d"), *[F.percentile("v", F.lit(p)).alias(n) for p, n in ((0.21, "l1"), (0.29, "h1"), (0.46, "l2"), (0.54, "h2"), (0.71, "l3"), (0.79, "h3"))])
    both = found.join(exact, ["source_id", "feature_name"])
    near = [F.col("quantiles")[k - 1].between(F.col(f"l{k}"), F.col(f"h{k}")) for k in (1, 2, 3)]
    out = both.withColumn("distinct_near", F.abs(F.col("approx_distinct_count") - F.col("d")) <= 0.05 * F.col("d")).withColumn("quartiles_near", near[0] & near[1] & near[2])
    return longs(out, "source_id").select("source_id", "source_name", "feature_name", "row_count", "non_null_count", "null_pct", "distinct_near", "quartiles_near")
