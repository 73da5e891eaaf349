"""Many files of few schemas, loads that fail half-way, tables that are not there, and quantiles of skewed columns."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidecube.operators import serving
from tidecube.sources import files


def test_many_files_of_three_schemas_are_three_scans(spark, tmp_path):
    kinds = [pa.schema([("ID", pa.int32())]), pa.schema([("id", pa.int64()), ("x", pa.string())]), pa.schema([("id", pa.float64()), ("extra", pa.bool_())])]
    paths = []
    for k in range(2000):
        row = [{"ID": k}, {"id": k, "x": "a"}, {"id": float(k), "extra": True}][k % 3]
        paths.append(f"{tmp_path}/{k}.parquet")
        pq.write_table(pa.Table.from_pylist([row], kinds[k % 3]), paths[-1])
    began = time.monotonic()
    df = files.read_months(spark, paths, "id long, x string")
    assert time.monotonic() - began < 60
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 3
    assert df.agg(F.count("*"), F.sum("id"), F.count("x")).first() == (2000, sum(range(2000)), 667)


def test_files_that_tasks_cannot_open_are_opened_by_the_driver(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(3, 5).selectExpr("cast(id as int) id").write.parquet(f"{tmp_path}/b")
    uri = [f"{tmp_path}/a", f"file:{tmp_path}/b"]
    assert sorted(r.id for r in files.read_months(spark, uri, "id long").collect()) == [0, 1, 2, 3, 4]
    assert len(files.file_schemas(spark, uri)) == 2


def test_a_broken_file_is_not_another_tables_rows(spark, tmp_path):
    spark.range(2).write.mode("overwrite").saveAsTable("loads_other")
    try:
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad/x.parquet").write_bytes(b"no parquet at all")
        assert files.read_table(spark, f"{tmp_path}/none", "loads_other").count() == 2
        with pytest.raises(Exception, match="(?i)parquet"):
            files.read_table(spark, f"{tmp_path}/bad", "loads_other").count()
    finally:
        spark.sql("drop table loads_other")


def jdbc(spark, url, name):
    return sorted(map(tuple, spark.read.format("jdbc").options(url=url, dbtable=name).load().collect()))


def tables(spark, url):
    return [r[0] for r in jdbc(spark, url, "(select tablename from sys.systables where tabletype = 'T') t")]


def test_a_failing_load_keeps_the_old_rows(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    files.write_jdbc(old, url, "served")
    assert jdbc(spark, url, "served") == [(1, "a"), (2, None)]
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate('CREATE INDEX by_id ON served ("id")')
    connection.close()
    bad = spark.range(400, numPartitions=4).select(F.when(F.col("id") < 399, F.col("id").cast("int")).otherwise(F.raise_error(F.lit("a task fails")).cast("int")).alias("id"), F.lit("x").alias("name"))
    with pytest.raises(Exception, match="a task fails"):
        files.write_jdbc(bad, url, "served")
    assert jdbc(spark, url, "served") == [(1, "a"), (2, None)] and tables(spark, url) == ["SERVED"]
    files.write_jdbc(spark.createDataFrame([(7, "z")] * 3, "id int, name string"), url, "served")
    assert jdbc(spark, url, "served") == [(7, "z")] * 3 and tables(spark, url) == ["SERVED"]
    indexes = jdbc(spark, url, "(select conglomeratename from sys.sysconglomerates where conglomeratename = 'BY_ID') t")
    assert indexes == [("BY_ID",)]
    files.write_jdbc(old.limit(0), url, "served")
    assert jdbc(spark, url, "served") == []


SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["even", "hot", "tail", "two", "constant"])
@pytest.mark.parametrize("times", [1, 10])
def test_quantiles_are_exact_within_small_ranges(spark, kind, times):
    rng, n = random.Random(kind), 2000 * times
    draw = {"even": rng.random, "hot": lambda: 5.0 if rng.random() < 0.7 else rng.gauss(0, 1), "tail": lambda: float(np.exp(rng.gauss(0, 40))), "two": lambda: rng.choice([-1.0, 1.0]), "constant": lambda: 3.0}[kind]
    values = [draw() for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "x double").repartition(6)
    got = serving.exact_quantiles(df, "x", SHARES, parts=8, fits=50).first().q
    assert got == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12)
    ranks = [0, n // 3, n // 2, n - 1]
    ordered = sorted(values)
    for k, r in serving.narrowed(df.select(F.col("x").alias("v")).where("v is not null"), ranks, 8, 50).items():
        assert r.low <= ordered[k] <= r.high and (r.n <= 50 or r.low == r.high)
        assert r.before == sum(v < r.low for v in values) and r.n == sum(r.low <= v <= r.high for v in values)
