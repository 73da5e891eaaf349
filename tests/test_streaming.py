import os

import pytest
from pyspark.sql import functions as F

from tidecube.plans.proxies import trips
from tidecube.streaming.demand import hourly_stream, keep_table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_stream_equals_batch_but_for_open_hours(spark, tmp_path):
    t = trips(spark, SF)
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    keep_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    end = t.agg(F.max("pickup_datetime") - F.expr("interval 2 hours")).first()[0]
    expect = {tuple(r) for r in hourly_stream(t).where(F.col("pickup_hour_ts") + F.expr("interval 1 hour") <= F.lit(end)).collect()}
    assert got == expect and len(got) > 100
