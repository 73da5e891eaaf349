"""Sessions, sources, resumable steps, reports, samples, quantiles, the sweep's selection and the guard's edges."""

import logging
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube import session
from tidecube.functions import trips as fn
from tidecube.operators import analytics, features, guard, metrics, models, schema, serving
from tidecube.sources import files


def test_session_settings_come_from_environment_configuration_and_defaults():
    got = session.options({"spark": {"master": "local[3]", "driver_memory": "1g"}}, {"SPARK_DRIVER_MEMORY": "2g"})
    assert (got["spark.master"], got["spark.driver.memory"], got["spark.sql.shuffle.partitions"]) == ("local[3]", "2g", "48")
    assert "spark.executor.memory" not in got
    got = session.options(None, {"SPARK_MASTER_URL": "spark://host:7077", "SPARK_EXECUTOR_CORES": "5"})
    assert (got["spark.executor.cores"], got["spark.executor.memory"], got["spark.cores.max"]) == ("5", "1500m", "4")
    assert session.options({"spark": None}, {})["spark.master"] == "local[1]"


def test_drifting_files_are_one_scan_a_schema(spark, tmp_path):
    for k in range(6):
        rows = spark.range(k, k + 1)
        (rows.withColumn("x", F.lit("a")) if k % 2 else rows.select(F.col("id").cast("int").alias("ID"))).write.parquet(f"{tmp_path}/{k}")
    df = files.read_months(spark, [f"{tmp_path}/{k}" for k in range(6)], "id long, x string")
    assert sorted(map(tuple, df.collect())) == [(0, None), (1, "a"), (2, None), (3, "a"), (4, None), (5, "a")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 2
    with pytest.raises(FileNotFoundError):
        files.read_months(spark, [], "id long")


def test_missing_sources_are_warned_of(spark, tmp_path, caplog):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    with caplog.at_level(logging.WARNING):
        assert files.combined_sources(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, lambda d: d.where("id > 0")).count() == 2
    assert "b is missing" in caplog.text
    with pytest.raises(FileNotFoundError):
        files.combined_sources(spark, {"b": f"{tmp_path}/b"})
    with pytest.raises(ValueError, match="no feeds"):
        features.combined()
    assert files.exists(spark, f"{tmp_path}/*") and not files.exists(spark, f"{tmp_path}/b/*.parquet")


def test_a_half_written_output_is_made_again(spark, tmp_path):
    at = f"{tmp_path}/out"
    spark.range(2).write.parquet(at)
    os.remove(f"{at}/_SUCCESS")
    assert files.write_once(spark.range(5), at).count() == 5
    assert files.write_once(spark.range(9), at).count() == 5


def test_months_go_on_where_they_broke_off(spark, tmp_path):
    read = []

    def month(m):
        read.append(m)
        if m == "2024-03" and len(read) < 5:
            raise OSError("gone")
        return spark.createDataFrame([(m, 1), (m, None)], "month string, n int")

    run = lambda: files.medallion_months(spark, ["2024-01", "2024-02", "2024-03"], month, str(tmp_path), lambda d: d.dropna(), lambda d: d.groupBy("month").agg(F.sum("n").alias("n")))
    with pytest.raises(OSError):
        run()
    before = {d: os.stat(f"{tmp_path}/gold/{d}/_SUCCESS").st_mtime_ns for d in ("2024-01", "2024-02")}
    assert sorted(map(tuple, run().collect())) == [("2024-01", 1), ("2024-02", 1), ("2024-03", 1)]
    assert before == {d: os.stat(f"{tmp_path}/gold/{d}/_SUCCESS").st_mtime_ns for d in before}


def test_copies_skip_what_is_there_and_replace_empty_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]) * 1000)
    (tmp_path / "to").mkdir()
    (tmp_path / "to/0.bin").write_bytes(b"old")
    (tmp_path / "to/1.bin").write_bytes(b"")
    pairs = [(f"{tmp_path}/{k}.bin", f"file://{tmp_path}/to/{k}.bin") for k in range(3)]
    actions = lambda done: {r["source"][-5:]: r["action"] for r in done}
    assert actions(files.copy_files(spark, pairs)) == {"0.bin": "skipped", "1.bin": "replaced", "2.bin": "copied"}
    assert (tmp_path / "to/0.bin").read_bytes() == b"old" and (tmp_path / "to/1.bin").read_bytes() == b"\1" * 1000
    assert actions(files.copy_files(spark, pairs, overwrite=True)) == dict.fromkeys(("0.bin", "1.bin", "2.bin"), "replaced")
    assert (tmp_path / "to/0.bin").read_bytes() == b"\0" * 1000 and sorted(os.listdir(tmp_path / "to")) == ["0.bin", "1.bin", "2.bin"]
    assert files.copy_files(spark, []) == []


def test_a_hot_partition_is_written_whole(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id")
    files.write_partitioned(df, f"{tmp_path}/p", "k")
    files.write_partitioned(df.where("k = 1").limit(3), f"{tmp_path}/p", "k")
    assert {r.k: r["count"] for r in spark.read.parquet(f"{tmp_path}/p").groupBy("k").count().collect()} == {0: 1800, 1: 3}


def test_reports(spark, tmp_path):
    cube = spark.createDataFrame([(0, 5, 1, 2024, "2024-01-01"), (0, 7, 2, 2024, "2024-01-02"), (1, 8, 2, 2024, "2024-01-02")], "source_id int, trip_count long, PULocationID long, pickup_year int, d string").withColumn("pickup_date", F.to_date("d"))
    cube.write.parquet(f"{tmp_path}/cube")
    text = files.analysis_report("demand", files.inventory(spark, f"{tmp_path}/cube"), schema.described(cube), analytics.source_summary(cube), ["a.csv"])
    assert "| trip_count | bigint |" in text and "| 0 | 2 | 12 | 6.00 | 2 |" in text and text.endswith("* a.csv\n")
    rows = files.rows_frame(spark, [{"b": 1, "a": None, "z": 2}], ["a", "b"])
    assert rows.columns == ["a", "b"] and rows.collect() == [(None, "1")]


def test_capped_samples(spark):
    df = spark.range(10_000)
    got = [r.id for r in analytics.capped_sample(df, "id", 500).collect()]
    assert 400 <= len(got) <= 500 and got == [r.id for r in analytics.capped_sample(df.repartition(5), "id", 500).collect()]
    assert 3500 < sum(got) / len(got) < 6500  # not the first ids
    assert analytics.capped_sample(df.limit(40), "id", 500).count() == 40 and analytics.capped_sample(df.limit(0), "id", 5).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(1)
    for values in ([], [None], [3.0], [1.0, 2.0], [rng.choice([1.0, 2.5, 7.0, None]) for _ in range(300)], [rng.gauss(0, 1) for _ in range(999)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got, known = serving.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], parts=7).first().q, [v for v in values if v is not None]
        assert got == ([None] * 5 if not known else pytest.approx([float(np.quantile(known, q)) for q in (0, 0.25, 0.5, 0.9, 1)]))


def test_metrics_of_no_rows_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 1.0)], "label double, prediction double")
    assert metrics.checked_metrics(df)["rmse"] == 2.0
    with pytest.raises(ValueError, match="no rows"):
        metrics.checked_metrics(df.where("label is null"))


def test_the_best_of_a_sweep_is_saved(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 23), rng.randint(1, 7), 1, rng.random(), rng.random(), rng.random(), rng.random(), rng.random(), str(rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c.startswith('pickup') else 'double'}" for c in models.NUMBERS) + ", zone string")
    df = df.withColumn("label", 3 * F.col("location_avg") + F.col("pickup_hour") / 10)
    got = {r.config: r for r in models.select_and_save(df.limit(300), df, str(tmp_path), ["linear_plain", "linear_elastic", "forest_20_5"]).collect()}
    assert set(got) == {"naive", "linear_plain", "linear_elastic", "forest_20_5"}
    assert [c for c, r in got.items() if r.best] == ["linear_plain"] and {c for c, r in got.items() if r.best_of_model} == {"linear_plain", "forest_20_5"}
    assert got["naive"].selection == "baseline" and got["naive"].artifact is None
    best = models.PipelineModel.load(f"{tmp_path}/best_pipeline").transform(df)
    assert metrics.checked_metrics(best)["rmse"] == got["linear_plain"].rmse
    assert spark.read.option("header", "true").csv(f"{tmp_path}/metrics").count() == 4
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError, match="no configuration"):
        models.select_and_save(df.limit(30), df.limit(30), str(tmp_path), [])


ALLOWED = ["select `set`, \"copy\" from t", "select 1 as `update`", "select a from t join u using (a)", "select 'reflect(' as x", "select transform(a, x -> x + 1) from t", "select `a.b`.c from `my db`.t", "select 'it\\'s; drop' as x -- set; x\n", "select /* reflect('a') */ 1", "select r'\\d' from t"]
BLOCKED = [
    "select reflect('java.lang.System', 'exit', '0')", "select java_method('a', 'b')", "select `reflect`('a', 'b')", "select try_reflect ('a')", "select REFLECT/**/('a')", "select * from parquet.`/any/path`", "select * from `parquet`.`x`",
    "select * from anything . `s3://b/x`", "select transform(a) using 'sh' as b from t", "select \"'\", reflect(\"java.lang.System\", \"exit\", \"0\"), \"'\"", "select r'\\', reflect('a', 'b'), '\\''", "select 1 -- x\r, reflect('a')", "select '\\'', reflect('a', 'b')",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_guard_allows_quoted_names_and_texts(sql):
    assert guard.is_read_only(sql)


@pytest.mark.parametrize("sql", BLOCKED)
def test_guard_blocks_calls_files_and_scripts(sql):
    assert not guard.is_read_only(sql)


def test_guard_takes_no_files_for_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    assert "error" in guard.run(spark, f"select * from parquet.`{tmp_path}/t`")
    assert guard.run(spark, "select 1 as x")["rows"] == [{"x": 1}] and spark.conf.get("spark.sql.runSQLOnFiles") == before


def test_month_names():
    assert (fn.MONTHS[1], fn.MONTHS[12], len(fn.MONTHS)) == ("January", "December", 12)


def test_training_rows_are_spread_whole(spark):
    """Nulls, repeated rows and an empty table: the same rows, over all cores at least."""
    from tidecube.operators import models

    for values in ([], [None, 1, 1, 2, None] * 40):
        out = models.spread(spark.createDataFrame([(v,) for v in values], "v int").coalesce(1))
        assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism or not values
        assert sorted(map(str, values)) == sorted(str(r.v) for r in out.collect())
