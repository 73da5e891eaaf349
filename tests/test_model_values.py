"""What the fitted models say against least squares by numpy: the refit forecast, the plain regression and the baseline of a sweep."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.operators import forecast, models
from tidecube.plans import proxies, registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("orders")), random.Random(4)
    orders = [(rng.choice([1, 2, 3]), dt.datetime(y, m, d), f"{rng.randint(1, 5)}-X") for y in (1996, 1997, 1999, 2000) for m in (1, 2, 3) for d in (2, 3, 9) for _ in range(rng.randint(20, 60))]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 7), (3, 11)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(n, f"N{n}", 0) for n in (3, 7, 11)], "n_nationkey int, n_name string, n_regionkey int").coalesce(1).write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").coalesce(1).write.parquet(f"{at}/region.parquet")
    return at


def design(rows):
    """Numbers and an indicator for each zone, which stand for the intercept as well."""
    return np.array([[*[float(r[c]) for c in models.NUMBERS], *[float(r["PULocationID"] == z) for z in (3, 7, 11)]] for r in rows])


def test_refit_forecast_is_least_squares(spark, tables):
    known = proxies.full_grid(spark, tables)
    rows = known.with_history().collect()
    fitted = np.linalg.lstsq(design(rows), np.array([r["trip_count"] for r in rows]), rcond=None)[0]
    ahead = forecast.forecast_features(forecast.serving_grid(known.zones, 2002, [1, 2]), known).collect()
    want = {(r["PULocationID"], r["pickup_month"], r["pickup_day_of_week"], r["pickup_hour"]): max(v, 0.0) for r, v in zip(ahead, design(ahead) @ fitted)}
    got = {(r["PULocationID"], r["pickup_month"], r["pickup_day_of_week"], r["pickup_hour"]): r["predicted_trip_count"] for r in registry.queries()["m9_refit_forecast"](spark, tables).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 2 * 7 * 24
    assert max(abs(got[k] - want[k]) for k in want) < 0.05 and max(want.values()) > 1


def test_sweep_of_plain_regression_and_baseline(spark, tables, tmp_path):
    rows = proxies.full_grid(spark, tables).with_history().withColumns({"label": F.col("trip_count"), "zone": F.col("PULocationID").cast("string")})
    train, test = models.holdout(rows, [1996, 1997, 1999], 2000)
    found = {r.config: r for r in models.select_and_save(train, test, str(tmp_path), ["linear_plain"]).collect()}
    a, b = train.collect(), test.collect()
    y = np.array([r["label"] for r in b])
    error = {"naive": np.array([r["location_dow_hour_avg"] for r in b]) - y, "linear_plain": design(b) @ np.linalg.lstsq(design(a), np.array([r["label"] for r in a]), rcond=None)[0] - y}
    for config, e in error.items():
        r = found[config]
        assert r.n == len(b) and r.rmse == pytest.approx(np.sqrt(np.mean(e**2)), rel=0.01) and r.mae == pytest.approx(np.mean(abs(e)), rel=0.02)
        assert r.r2 == pytest.approx(1 - np.sum(e**2) / np.sum((y - y.mean()) ** 2), abs=0.02)
    assert found["linear_plain"].best and not found["naive"].best
