"""The demand cube is written by as many tasks as it has partitions."""

import os

import pytest

from tidecube.plans import io_queries, more_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize(("module", "name"), [(more_queries, "k1"), (io_queries, "k5")])
def test_cube_is_not_written_by_one_task(spark, monkeypatch, tmp_path, module, name):
    at = f"{tmp_path}/cube"
    monkeypatch.setattr(module, "fresh", lambda _spark: at)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small data shows it
    try:
        getattr(module, name)(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.startswith("part-") for f in os.listdir(at)) > 1
