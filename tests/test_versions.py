"""Versioned tables: failing writers, concurrent ones, months that stay untouched, and batches that count once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidecube.operators import cube
from tidecube.sources.versions import Conflict, VersionedTable
from tidecube.streaming.ledger import Medallion, refresh_cube


def rows(df):
    return sorted(map(tuple, df.collect()))


def failing(spark, n):
    """Rows of which the last cannot be written."""
    return spark.range(n, numPartitions=4).select(F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))


def trips(spark, seed, n, months=(1, 2, 3)):
    rng = random.Random(seed)
    out = [(rng.choice([0, 1]), rng.choice([4, 5, None]), rng.choice(months), rng.randint(1, 28), rng.randint(0, 23)) for _ in range(n)]
    df = spark.createDataFrame(out, "source_id int, PULocationID long, m int, d int, pickup_hour int")
    date = F.make_date(F.lit(2024), "m", "d")
    return df.select(
        "source_id", F.when(F.col("source_id") == 0, "yellow").otherwise("hvfhv").alias("source_name"), "PULocationID", date.alias("pickup_date"), F.year(date).alias("pickup_year"), F.month(date).alias("pickup_month"), "pickup_hour",
        F.dayofweek(date).alias("pickup_day_of_week"), F.dayofweek(date).isin(1, 7).alias("is_weekend"),
    )


def test_a_failing_replace_leaves_the_table_and_its_view(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.versions() == [] and table.manifest()["parts"] == {}
    assert table.replace(spark.range(5)) == 1
    table.show("versioned_numbers")
    reader = table.read()
    with pytest.raises(Exception, match="broken"):
        table.replace(failing(spark, 100))
    assert table.versions() == [1] and rows(table.read()) == rows(reader) == rows(spark.table("versioned_numbers")) == rows(spark.range(5))
    assert table.replace(spark.range(7)) == 2
    assert rows(spark.table("versioned_numbers")) == rows(reader) == rows(table.read(1)) == rows(spark.range(5))
    table.show("versioned_numbers")
    assert rows(spark.table("versioned_numbers")) == rows(table.read()) == rows(spark.range(7))
    spark.sql("drop view versioned_numbers")


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in "ab")
    a.replace(spark.range(1))
    last, b.manifest = b.manifest(), lambda version=None: last
    a.replace(spark.range(2))
    with pytest.raises(Conflict):
        b.replace(spark.range(3))
    assert rows(a.read()) == [(0,), (1,)]
    assert sorted(f for f in os.listdir(tmp_path / "t/manifests") if not f.endswith(".crc")) == ["1.json", "2.json"]


def test_late_trips_change_only_their_months(spark, tmp_path):
    table, first, late = VersionedTable(spark, str(tmp_path / "cube")), trips(spark, 1, 400), trips(spark, 2, 60, months=(2,))
    table.replace(cube.demand_cube(first), ["pickup_year", "pickup_month"])
    before = {f: os.stat(tmp_path / "cube" / f).st_mtime_ns for f in table.manifest()["parts"].values()}
    assert refresh_cube(table, late) == ["part_pickup_year=2024/part_pickup_month=2"]
    after = table.manifest()["parts"]
    assert len(after) == 3 and [n for n, f in after.items() if f in before] == [f"part_pickup_year=2024/part_pickup_month={m}" for m in (1, 3)]
    assert all(os.stat(tmp_path / "cube" / f).st_mtime_ns == t for f, t in before.items())
    assert sorted(map(str, table.read().collect())) == sorted(map(str, cube.demand_cube(first.unionByName(late)).select(table.read().columns).collect()))
    assert rows(table.read(1).agg(F.sum("trip_count"))) == [(400,)] and rows(table.read().agg(F.sum("trip_count"))) == [(460,)]
    assert refresh_cube(table, trips(spark, 3, 10, months=(7,))) == ["part_pickup_year=2024/part_pickup_month=7"]
    assert refresh_cube(table, late.limit(0)) == []


def test_a_batch_counts_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "cube"))
    for batch in (("files", 0), ("files", 0), ("files", 1), ("files", 0), ("others", 0)):
        refresh_cube(table, trips(spark, 1, 50), batch)
    assert table.read().agg(F.sum("trip_count")).first()[0] == 150 and table.taken(("files", 1)) and not table.taken(("others", 1))


def test_expired_versions_take_only_their_own_folders(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "cube"))
    for k in range(4):
        refresh_cube(table, trips(spark, k, 100, months=(1, 2) if k == 0 else (1,)))
    want = rows(table.read().drop("PULocationID"))
    assert len(table.expire(keep=1)) == 3 and table.versions() == [4]
    assert rows(table.read().drop("PULocationID")) == want


def test_files_are_taken_once_and_broken_runs_go_on(spark, tmp_path):
    raw, schema = str(tmp_path / "raw"), trips(spark, 0, 1).schema.simpleString()[7:-1].replace(":", " ")
    clean, fail = lambda d: d.dropna(subset=["PULocationID"]), []

    def broken(df):
        if fail:
            raise OSError(fail.pop())
        return clean(df)

    parts = [trips(spark, k, 80, months=(k + 1,)) for k in range(4)]
    for k in (0, 1):
        parts[k].coalesce(1).write.parquet(f"{raw}/{k}")
    m = Medallion(spark, str(tmp_path / "lake"), broken)
    done = m.update(raw, schema, files_a_batch=1)
    assert [d["rows"] for d in done] == [80, 80]
    assert m.update(raw, schema) == []  # no old file is read again
    parts[2].coalesce(1).write.parquet(f"{raw}/2")
    fail.append("between bronze and silver")
    with pytest.raises(Exception, match="between bronze and silver"):
        m.update(raw, schema)
    assert m.bronze.taken(("files", 2)) and not m.silver.taken(("files", 2))
    gold, m.gold.merge = m.gold.merge, lambda *a: (_ for _ in ()).throw(OSError("between silver and gold"))
    with pytest.raises(Exception, match="between silver and gold"):
        m.update(raw, schema)
    m.gold.merge = gold
    (late := trips(spark, 9, 30, months=(1, 4))).coalesce(1).write.parquet(f"{raw}/late")
    m.update(raw, schema)
    want = cube.demand_cube(clean(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(late)))
    assert rows(m.gold.read().select(want.columns)) == rows(want)
    assert m.bronze.read().count() == 270 and m.silver.read().count() == rows(want.agg(F.sum("trip_count")))[0][0]
