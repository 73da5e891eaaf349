"""Bounds of the cleaning filters, schemas, features, guard, windows, serving: hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators import analytics, cleaning, cube, features, forecast, guard, metrics, schema, serving
from tidecube.sources import files

YEARS = list(range(2018, 2026))


def yellow(spark, *changes):
    base = dict(VendorID=1, tpep_pickup_datetime=dt.datetime(2024, 1, 1, 10), tpep_dropoff_datetime=dt.datetime(2024, 1, 1, 10, 10), passenger_count=1.0, trip_distance=2.0, RatecodeID=1.0, store_and_fwd_flag="N", PULocationID=1, DOLocationID=2, payment_type=1, fare_amount=5.0, extra=0.0, mta_tax=0.0, tip_amount=0.0, tolls_amount=0.0, improvement_surcharge=0.0, total_amount=6.0, congestion_surcharge=0.0, airport_fee=0.0)
    rows = [tuple((base | c).values()) for c in changes]
    df = spark.createDataFrame(rows, schema.YELLOW)
    kept = cleaning.cleaned(schema.fill(df, schema.YELLOW_FILL).withColumn("k", F.monotonically_increasing_id()), cleaning.yellow_steps(YEARS))
    return kept.count()


def pick(**kw):
    start = dt.datetime(kw.pop("year", 2024), 1, 1, 10)
    return {"tpep_pickup_datetime": start, "tpep_dropoff_datetime": start + dt.timedelta(seconds=kw.pop("seconds", 600))} | kw


@pytest.mark.parametrize(
    ("change", "kept"),
    [
        (pick(), 1), (pick(seconds=0), 0), (pick(seconds=-5), 0), (pick(seconds=59), 0), (pick(seconds=60), 1), (pick(seconds=10800), 1), (pick(seconds=10801), 0),
        ({"trip_distance": 0.0}, 0), ({"trip_distance": 0.01}, 1), ({"trip_distance": 100.0}, 1), ({"trip_distance": 100.01}, 0),
        ({"passenger_count": None}, 1), ({"passenger_count": 0.0}, 0), ({"passenger_count": 6.0}, 1), ({"passenger_count": 7.0}, 0),
        ({"fare_amount": 0.01, "total_amount": 0.01}, 1), ({"total_amount": 0.0}, 0), ({"fare_amount": 0.0}, 0),
        ({"RatecodeID": None}, 1), ({"RatecodeID": 7.0}, 0), ({"RatecodeID": 99.0}, 1), ({"payment_type": None}, 0), ({"payment_type": 0}, 0), ({"payment_type": 6}, 1),
        ({"VendorID": None}, 0), ({"VendorID": 3}, 0), (pick(year=2017), 0), (pick(year=2018), 1), (pick(year=2025), 1), (pick(year=2026), 0),
    ],
)
def test_yellow_bounds(spark, change, kept):
    assert yellow(spark, change) == kept


@pytest.mark.parametrize(
    ("change", "kept"),
    [({}, 1), ({"trip_time": 59}, 0), ({"trip_time": 60}, 1), ({"trip_time": 10800}, 1), ({"trip_time": 10801}, 0), ({"trip_miles": 0.0}, 0), ({"trip_miles": 100.0}, 1), ({"trip_miles": 100.01}, 0), ({"base_passenger_fare": 0.0}, 0), ({"base_passenger_fare": 0.01}, 1), ({"hvfhs_license_num": None}, 0), ({"PULocationID": None}, 0), ({"dropoff_datetime": None}, 0)],
)
def test_hvfhv_bounds(spark, change, kept):
    base = dict(hvfhs_license_num="HV0003", pickup_datetime=dt.datetime(2024, 1, 1, 10), dropoff_datetime=dt.datetime(2024, 1, 1, 11), PULocationID=1, DOLocationID=2, trip_miles=1.0, trip_time=600, base_passenger_fare=9.0)
    df = spark.createDataFrame([tuple((base | change).values())], "hvfhs_license_num string, pickup_datetime timestamp, dropoff_datetime timestamp, PULocationID long, DOLocationID long, trip_miles double, trip_time long, base_passenger_fare double")
    assert features.hvfhv_trips(df, [2023, 2024, 2025]).count() == kept


def test_step_counts_add_up_and_survive_an_empty_table(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x long")
    steps = [("small", F.col("x") < 10), ("odd", F.col("x") > 2)]
    assert [tuple(r) for r in cleaning.step_counts(df, steps).orderBy("step_order").collect()] == [("small", 1, 3, 2, 1), ("odd", 2, 2, 1, 1)]
    assert [r.rows_after for r in cleaning.step_counts(df.limit(0), steps).collect()] == [0, 0]
    assert cleaning.null_audit(df.limit(0)).first().null_count == 0
    assert "| all | 3 | 1 | 2 | 66.67 % |" in files.cleaning_report(cleaning.step_counts(df, steps))


def test_schema_enforcement(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "vendorid int, Airport_fee double, other string")
    out = schema.enforce(df, schema.YELLOW)
    assert out.columns == [f.name for f in schema.parsed(schema.YELLOW)] and dict(out.dtypes)["VendorID"] == "bigint"
    row = out.first()
    assert (row.VendorID, row.airport_fee, row.store_and_fwd_flag) == (1, 2.0, None)
    with pytest.raises(ValueError, match="missing"):
        schema.standardise(df)
    assert schema.same_columns(df, ["vendorid", "Airport_fee", "other"]) and not schema.same_columns(df, ["other", "vendorid", "Airport_fee"])


def test_year_filter_is_pushed_as_a_range(spark, tmp_path):
    spark.range(5).select(F.current_timestamp().alias("ts")).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(cleaning.in_years(F.col("ts"), [2023, 2024]))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_validation(spark):
    with pytest.raises(ValueError, match="no rows"):
        cleaning.validate(spark.createDataFrame([], schema.TRIPS), ["pickup_year"], [2024])
    with pytest.raises(ValueError, match="missing"):
        cleaning.validate(spark.createDataFrame([], schema.TRIPS), ["nope"], [2024])


def test_labels_bands_and_clock(spark):
    df = spark.createDataFrame([(0,), (19,), (20,), (99,), (100,)], "n int")
    assert [r[0] for r in df.select(fn.fixed_band(F.col("n"))).collect()] == ["low", "low", "medium", "high", "very_high"]
    q = [F.lit(x) for x in (1.0, 2.0, 3.0)]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (1.1,), (3.0,), (3.1,)], "v double").select(fn.quartile_band(F.col("v"), *q)).collect()] == ["low", "medium", "high", "very_high"]
    assert [r[0] for r in spark.range(24).select(fn.clock(F.col("id"))).collect()][::12] == ["12 AM", "12 PM"]
    assert spark.range(1).select(fn.speed_mph(F.lit(3.0), F.lit(0.0))).first()[0] is None


def demand(spark, rows):
    return spark.createDataFrame(rows, "PULocationID long, pickup_date date, pickup_hour int, trip_count double")


def test_history_knows_only_the_past(spark):
    d = dt.date
    full = forecast.grid(demand(spark, [(1, d(2024, 1, 1), 0, 4.0), (2, d(2024, 1, 1), 1, 2.0), (1, d(2024, 2, 1), 0, 8.0), (1, d(2024, 4, 1), 0, 6.0)]))
    assert full.count() == 2 * 3 * 24
    rows = {(r.PULocationID, r.pickup_date, r.pickup_hour): r for r in forecast.with_history(full).collect()}
    first = rows[1, d(2024, 1, 1), 0]
    assert (first.location_avg, first.location_hour_avg, first.location_hour_zero_rate) == (0.0, 0.0, 1.0)
    feb = rows[1, d(2024, 2, 1), 0]
    assert (feb.location_hour_avg, feb.previous_month_location_hour_avg, feb.location_hour_zero_rate) == (4.0, 4.0, 0.0)
    april = rows[1, d(2024, 4, 1), 0]
    assert april.location_hour_avg == 6.0 and april.previous_month_location_hour_avg == 6.0  # March is missing for all: it falls back, it is not skipped to February
    assert all(v is not None for r in rows.values() for v in r)


def test_cube_sums_equal_trip_counts(spark):
    rows = [(0, "yellow", 1, d, 10) for d in (1, 1, 2)] + [(1, "hvfhv", 30, 1, 10)]
    t = spark.createDataFrame(rows, "source_id int, source_name string, PULocationID long, d int, pickup_hour int").withColumns({"pickup_date": F.make_date(F.lit(2024), F.lit(1), "d"), "pickup_year": F.lit(2024), "pickup_month": F.lit(1), "pickup_day_of_week": F.lit(2), "is_weekend": F.lit(False)})
    c = cube.demand_cube(t)
    assert c.agg(F.sum("trip_count")).first()[0] == 4
    zones = spark.createDataFrame([(1, "B", "Z")], "location_id long, borough string, zone string")
    assert {r.borough: r.trip_count for r in cube.borough_hourly_demand(c, zones).groupBy("borough").agg(F.sum("trip_count").alias("trip_count")).collect()} == {"B": 3, None: 1}
    table = serving.serving_table(c, zones)
    assert {r.zone for r in table.collect()} == {"Z", "Unknown"}
    assert serving.zone_slice(table, 1, 2, 10).count() == 2 and serving.zone_names(table, 77).first().zone is None


def test_metrics_of_constant_and_empty_labels(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0), (None, 1.0)], "label double, prediction double")
    assert tuple(metrics.regression_metrics(df).first()) == (2, 0.7071, 0.5, 0.0)
    assert tuple(metrics.regression_metrics(df.limit(0)).first())[:3] == (0, None, None)


GUARD_ALLOWED = ["select 1", "SELECT * FROM t", "  select 1", "select 1 ;", "with a as (select 1) select * from a", "\nselect 1\n", "select x from t where y = 1", "SELECT count(*) FROM t GROUP BY x", "select x from t limit 5 offset 2", "select 'drop t' as x"]
GUARD_BLOCKED = ["drop table t", "delete from t", "insert into t values (1)", "update t set a = 1", "alter table t add b int", "create table t (a int)", "attach 'x'", "copy t to 'x'", "pragma x", "set x = 1", "select 1; select 2", "select 1; drop table t", "; select 1; ;", "select 1;;select 2", "", "   ", ";", "\n\n", "garbage", "explain select 1", "with x as (insert into t values (1)) select 1", "with x as (delete from t) select 1", "update\nt set a = 1"]


@pytest.mark.parametrize("sql", GUARD_ALLOWED)
def test_guard_allows(sql):
    assert guard.is_read_only(sql)


@pytest.mark.parametrize("sql", GUARD_BLOCKED)
def test_guard_blocks(sql):
    assert not guard.is_read_only(sql)


def test_guarded_run(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert guard.run(spark, "select * from numbers")["row_count"] == 200
    assert "error" in guard.run(spark, "drop view numbers") and "error" in guard.run(spark, "select * from nowhere")
    assert guard.extract_sql("Here:\n```sql\nselect 1\n```") == "select 1" and guard.extract_sql("try select 2") == "select 2"


def test_write_once_and_medallion(spark, tmp_path):
    at = str(tmp_path / "out")
    assert not files.exists(spark, at)
    assert files.write_once(spark.range(3), at).count() == 3
    assert files.write_once(spark.range(9), at).count() == 3
    assert files.write_once(spark.range(9).withColumnRenamed("id", "n"), at).count() == 9
    inventory = files.inventory(spark, at)
    assert inventory.where("is_parquet").count() >= 1
    assert files.qualified("/a/b", "hdfs://n:1") == "hdfs://n:1/a/b" and files.qualified("s3://x", "hdfs://n") == "s3://x"


def test_zone_file(spark, tmp_path):
    (tmp_path / "z.csv").write_text('"LOCATIONID","Borough","Zone","service_zone"\n264,Unknown,N/A,\n265,N/A,Outside,N/A\n')
    assert [tuple(r) for r in files.read_zones(spark, str(tmp_path / "z.csv")).collect()] == [(264, "Unknown", "N/A", "N/A"), (265, "N/A", "Outside", "N/A")]


def test_jdbc_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    files.write_jdbc(spark.range(4).withColumnRenamed("id", "n"), url, "trips", driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = spark.read.format("jdbc").options(url=url, dbtable="trips", driver="org.apache.derby.jdbc.EmbeddedDriver").load()
    assert got.count() == 4


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a = {r.id for r in analytics.hash_sample(df, "id", 0.1).collect()}
    assert a == {r.id for r in analytics.hash_sample(df.repartition(7), "id", 0.1).collect()} and 350 < len(a) < 650
