"""The SQL guard on the analysed plan: what runs, what does not however it is written, and two runs at once."""

import threading

import pytest
from pyspark.sql import functions as F

from tidecube.operators import guard


@pytest.fixture(scope="module")
def views(spark):
    spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("borough"), (F.col("id") * 1.5).alias("trips"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id)").alias("ts")).createOrReplaceTempView("guarded_trips")
    spark.range(5).selectExpr("id", "concat('n', id) as name").createOrReplaceTempView("guarded_names")
    spark.range(9).write.mode("overwrite").saveAsTable("guarded_secret")
    yield {"guarded_trips": spark.table("guarded_trips"), "guarded_names": spark.table("guarded_names")}
    spark.sql("drop table guarded_secret")


GOOD = {
    "select 1": 1,
    "SELECT * FROM guarded_trips;": 50,
    "select borough, sum(trips) s, count(*) n from guarded_trips group by borough having count(*) > 1 order by s desc": 3,
    "with a as (select * from guarded_trips where id > 40) select a.id, name from a left join guarded_names n on a.id = n.id": 9,
    "select id from guarded_trips union all select id from guarded_names": 55,
    "select id, row_number() over (partition by borough order by trips desc) r from guarded_trips": 50,
    "select upper(name), substring(name, 1, 1), length(name) from guarded_names where name like 'n%' and id in (select id from guarded_trips)": 5,
    "select date_trunc('hour', ts) h, avg(trips) from guarded_trips where trips > (select avg(trips) from guarded_trips) group by 1": 25,
    "select 'drop table x; reflect(' as `update`": 1,
    "select case when id > 2 then 'a' else coalesce(name, 'b') end from guarded_names -- delete from x": 5,
    "select y from guarded_names lateral view explode(array(1, 2)) e as y": 10,
    "select * from GUARDED_NAMES limit 2 offset 1": 2,
}
BAD = [
    "select reflect('java.util.UUID', 'randomUUID')",
    "select identifier('reflect')('java.util.UUID', 'randomUUID')",
    "select identifier('re' || 'flect')('java.util.UUID', 'randomUUID')",
    "select identifier('java_' || 'method')('java.lang.System', 'getProperty', 'user.home')",
    "select `try_reflect`('java.util.UUID', 'randomUUID')",
    "select * from identifier('guarded_secret')",
    "select * from identifier('guarded_' || 'secret')",
    "select * from guarded_secret",
    "select * from default.guarded_secret",
    "select * from spark_catalog.default.guarded_secret",
    "select (select count(*) from guarded_secret) from guarded_names",
    "with guarded_names as (select * from guarded_secret) select * from guarded_names",
    "select * from parquet.`/root/testdata/sf0.001/nation.parquet`",
    "select * from text.`/etc/passwd`",
    "select * from identifier('text.`/etc/passwd`')",
    "select * from range(10)",
    "select * from global_temp.anything",
    "select input_file_name() from guarded_names",
    "select current_user()",
    "select raise_error('x')",
    "select transform(id) using 'cat' as (x string) from guarded_names",
    "with recursive r(n) as (select 1 union all select n + 1 from r) select * from r",
    "select 1) union (select 2; drop table guarded_secret",
    "select * from (delete from guarded_names)",
    "select 1 union all insert into x values (1)",
    "select no_such_function(1)",
    "select nothing from guarded_names",
    "explain select 1",
    "drop table guarded_secret",
    "select 1 /* unclosed",
    "", ";", "\n", "garbage", None,
]


@pytest.mark.parametrize("sql", GOOD)
def test_queries_run(spark, views, sql):
    out = guard.run(spark, sql, tables=views)
    assert out.get("row_count") == GOOD[sql], out


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(spark, views, sql):
    assert list(guard.run(spark, sql, tables=views)) == ["error"]


def test_tables_of_the_session_are_known_when_none_are_given(spark, views):
    assert guard.run(spark, "select count(*) as n from guarded_secret")["rows"] == [{"n": 9}]
    assert guard.run(spark, "select count(*) as n from guarded_names", most=1)["rows"] == [{"n": 5}]
    assert guard.run(spark, "select id from guarded_trips")["row_count"] == 50
    assert guard.run(spark, "select id from guarded_trips", most=7)["row_count"] == 7


def test_a_session_of_its_own(spark, views):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    guard.run(spark, "select * from guarded_names", tables=views)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("guarded_") and t.namespace == ["global_temp"]]
    assert guard.run(spark, "select * from guarded_names", tables={"guarded_names": spark.range(2)})["row_count"] == 2
    assert spark.table("guarded_names").count() == 5


def test_two_runs_at_once_do_not_open_each_others_doors(spark, views):
    found = {}

    def several(k):
        file = "select * from parquet.`/root/testdata/sf0.001/nation.parquet`"
        found[k] = [list(guard.run(spark, file if i % 2 == k else "select count(*) as n from guarded_trips", tables=views)) for i in range(6)]

    threads = [threading.Thread(target=several, args=(k,)) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for k, outcomes in found.items():
        assert outcomes == [["error"] if i % 2 == k else ["row_count", "rows"] for i in range(6)]
