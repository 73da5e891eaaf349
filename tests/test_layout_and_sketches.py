"""What clustered files let a scan skip, sketches that add up, and counts that cost no pass of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.operators import cleaning, sketches
from tidecube.sources import layout


def rows_scanned(df):
    """What the Parquet scan hands on after row groups and pages were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def cube(spark):
    """A cube whose zones are skewed: a third of all rows are of zone 3."""
    rows = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, 3).otherwise(F.pmod(F.xxhash64("id"), F.lit(260))).cast("long").alias("zone"), *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)) + 1).cast("int").alias(c) for n, c in ((12, "month"), (7, "dow"), (24, "hour"))], "id")
    return rows.unionByName(spark.sql("select cast(null as long) zone, 1 month, 1 dow, 1 hour, -1L id"))


def test_every_filter_column_skips_rows(spark, cube, tmp_path):
    columns, small = ["zone", "month", "dow", "hour"], {"parquet.page.size": "4096", "parquet.page.row.count.limit": "500"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_clustered(cube, f"{tmp_path}/z", columns, bits=4, bloom=["zone"], row_group_bytes=64 << 10, **small)
        cube.repartitionByRange(*columns).sortWithinPartitions(*columns).write.options(**{"parquet.block.size": str(64 << 10)}, **small).parquet(f"{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole, total = cube.count(), {"z": 0, "s": 0}
    for where in ("month = 5 and hour = 7", "dow = 3 and hour = 20", "hour = 1", "dow = 2 and month = 11 and hour between 3 and 5", "zone = 77 and hour = 7"):
        found = {at: spark.read.parquet(f"{tmp_path}/{at}").where(where) for at in total}
        assert sorted(map(str, found["z"].collect())) == sorted(map(str, found["s"].collect())) == sorted(map(str, cube.where(where).collect()))
        for at, df in found.items():
            total[at] += rows_scanned(df)
    assert total["z"] < 0.6 * total["s"] and total["z"] < 0.4 * 5 * whole
    assert spark.read.parquet(f"{tmp_path}/z").where("zone is null").count() == 1 and spark.read.parquet(f"{tmp_path}/z").count() == whole


def test_places_on_the_curve(spark):
    df = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    got = {(r.a, r.b): r.p for r in df.select("a", "b", layout.curve([F.col("a"), F.col("b")], 3).alias("p")).collect()}
    assert got == {(a, b): sum(((a >> i & 1) << 2 * i + 1) | ((b >> i & 1) << 2 * i) for i in range(3)) for a in range(8) for b in range(8)}
    values = [None, -1.0, 0.0, 2.5, 3.0, 9.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", layout.rank(F.col("v"), [0.0, 1.0, 3.0]).alias("r")).collect()
    assert [r.r for r in sorted(rows, key=lambda r: (r.v is not None, r.v or 0))] == [0, 0, 1, 2, 3, 3]
    with pytest.raises(ValueError, match="too many bits"):
        layout.write_clustered(df, "nowhere", ["a", "b"], bits=40)


def test_an_empty_table_is_laid_out(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b int")
    layout.write_clustered(df, f"{tmp_path}/z", ["a", "b"])
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/z").count() == 0


def test_sketches_of_months_add_up(spark):
    rng = random.Random(8)
    rows = [(k % 2, "ab"[k % 2], 2024, 1 + k % 5, rng.choice([None, rng.gauss(0, 9)]), rng.randint(0, 40_000) if k % 5 else None) for k in range(60_000)]
    trips = spark.createDataFrame(rows, "source_id int, source_name string, pickup_year int, pickup_month int, x double, z long")
    monthly = sketches.monthly_sketches(trips, ["x", "z"]).persist()
    for first, last in (("2024-01", "2024-05"), ("2024-02", "2024-04"), ("2024-03", "2024-03"), ("2024-01", "2024-01")):
        got = {(r.source_id, r.feature_name): r for r in sketches.profile(monthly, first, last).collect()}
        for source in (0, 1):
            for feature, at in (("x", 4), ("z", 5)):
                of = [r[at] for r in rows if r[0] == source and int(first[5:]) <= r[3] <= int(last[5:])]
                known, r = [v for v in of if v is not None], got[source, feature]
                assert (r.row_count, r.non_null_count, r.null_count) == (len(of), len(known), len(of) - len(known))
                assert abs(r.approx_distinct_count - len(set(known))) <= 0.05 * len(set(known))
                if known:
                    assert all(abs(np.mean(np.array(known) <= q) - s) <= 0.03 for q, s in zip(r.quantiles, (0.25, 0.5, 0.75)))
                else:
                    assert r.quantiles is None
    #: merged month by month, in any grouping and order
    whole = {r.feature_name: r for r in sketches.merged(monthly, "feature_name").collect()}
    pairs = sketches.merged(monthly.withColumn("half", F.col("pickup_month") % 2), "feature_name", "half", "source_id").repartition(7, "half")
    for r in sketches.merged(pairs.orderBy(F.desc("half")), "feature_name").select("*", F.hll_sketch_estimate("distinct_sketch").alias("d"), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5)).alias("m")).collect():
        one = spark.createDataFrame([(whole[r.feature_name].distinct_sketch,)], "s binary").select(F.hll_sketch_estimate("s")).first()[0]
        values = np.array([x[4 if r.feature_name == "x" else 5] for x in rows if x[4 if r.feature_name == "x" else 5] is not None])
        assert r.d == one and r.row_count == whole[r.feature_name].row_count == 60_000 and abs(np.mean(values <= r.m) - 0.5) <= 0.03
    monthly.unpersist()


def steps():
    return [("positive", F.expr("x > 0")), ("small", F.expr("x < 50")), ("even", F.expr("x % 2 = 0"))]


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(200).select(F.when(F.col("id") % 7 != 0, F.col("id") - 20).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("y"))
    want = [r.asDict() for r in cleaning.step_counts(df, steps()).orderBy("step_order").collect()]
    cleaner, sc = cleaning.Counted(df, steps()), spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        out = cleaner.written(f"{tmp_path}/out")
    finally:
        sc._jsc.clearJobGroup()
    assert len(sc.statusTracker().getJobIdsForGroup("counted")) == 1  # the write is the only job
    assert cleaner.steps() == want
    assert sorted(map(str, out.collect())) == sorted(map(str, cleaning.cleaned(df, steps()).collect())) and out.columns == df.columns
    assert cleaner.nulls() == {r.column_name: r.null_count for r in cleaning.null_audit(out).collect()}


def test_no_row_left_is_an_error(spark, tmp_path):
    cleaner = cleaning.Counted(spark.range(5).withColumn("x", F.lit(-1)), steps())
    with pytest.raises(ValueError, match="no rows"):
        cleaner.written(f"{tmp_path}/out")
    assert [s["rows_after"] for s in cleaner.steps()] == [0, 0, 0]
    empty = cleaning.Counted(spark.range(0).withColumn("x", F.lit(1)), steps())
    with pytest.raises(ValueError, match="no rows"):
        empty.written(f"{tmp_path}/none")
    assert [s["rows_before"] for s in empty.steps()] == [0, 0, 0] and empty.nulls() == {"id": 0, "x": 0}
