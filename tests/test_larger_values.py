"""Queries against their SQL where the smallest tables do not reach: busy cells of the sample grid, columns of many values."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tidecube.operators import analytics
from tidecube.plans import registry


def same_as_sql(spark, tables, name, *views):
    con = duckdb.connect()
    for t in views:
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    df, rel = registry.queries()[name](spark, tables), con.sql(registry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in df.columns]
    rows = sorted(repr(tuple(r)) for r in df.collect())
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    return rows


def test_sample_of_busy_cells_has_the_buckets_of_its_sql(spark, tmp_path):
    at = str(tmp_path)
    orders = [(1, dt.datetime(y, 1, 1), f"{k}-X") for y in (1996, 1997) for k, n in ((1, 3), (2, 9), (3, 10), (4, 60), (5, 300)) for _ in range(n)]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{at}/customer.parquet")
    assert len(same_as_sql(spark, at, "a35_error_by_bucket", "orders", "customer")) == 2


def test_trim_and_quantiles_of_many_values_are_exact(spark, tmp_path):
    at, n = str(tmp_path), 600_011
    value = F.pmod(F.col("id") * 7919 + 17, F.lit(n)) / 7
    spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 1000 != 0, value).alias("value")).repartition(6).write.parquet(f"{at}/events.parquet")
    assert len(same_as_sql(spark, at, "a20_quantiles", "events")) == 8
    kept = registry.queries()["c21_trim_at_p99"](spark, at).agg(F.count("*"), F.max("value")).first()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    assert [tuple(kept)] == con.sql(f"select count(*), max(value) from ({registry.oracle_sql()['c21_trim_at_p99']})").fetchall()


def test_quantiles_of_odd_columns(spark):
    of = lambda values, kind: [r.value for r in analytics.quantiles(spark.createDataFrame([(v,) for v in values], f"x {kind}"), "x", [0.0, 0.5, 0.99, 1.0]).collect()]
    assert of([], "double") == of([None], "double") == [None] * 4
    assert of([2**60 + 1, 2**60, None, 2**60 + 2], "long") == [2**60, 2**60 + 1, 2**60 + 2, 2**60 + 2]
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    assert of(days[::-1], "date") == [days[0], days[4], days[9], days[9]]
    assert [repr(v) for v in of([float("nan"), 1.0, float("inf"), float("-inf")], "double")] == ["-inf", "1.0", "nan", "nan"]
