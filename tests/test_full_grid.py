"""The queries of the full grid over a few hand-made orders."""

import datetime as dt

import duckdb
import pytest

from tidecube.plans import forecast_queries, registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Zones 3 and 17; dates of three years that no stride of 30 has; from 1 to 300 orders in a cell."""
    at, orders = str(tmp_path_factory.mktemp("orders")), []
    for y in (1996, 1997, 2000):
        for k, n in enumerate((1, 12, 60, 120, 300)):
            orders += [(1 + k % 2, dt.datetime(y, 2, 2 + k), f"{1 + k}-X")] * n
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 17)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{at}/customer.parquet")
    return at


@pytest.mark.parametrize("name", ["f3_zero_filled_grid_full", "f6_history_features_full", "a35_error_by_bucket_full", "j4_grid_join_full"])
def test_full_grid_matches_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    df, rel = registry.queries()[name](spark, tables), con.sql(registry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in df.columns]
    rows = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    expect = {"f3_zero_filled_grid_full": 2 * 15 * 24, "f6_history_features_full": 2 * 15 * 24, "a35_error_by_bucket_full": 5, "j4_grid_join_full": 1}
    assert len(rows) == expect[name]


def test_sweep_has_every_configuration(spark, tables):
    assert forecast_queries.m6(spark, tables).count() == 10


def test_saved_model_and_sweep_agree(spark, tables):
    """The holdout's residuals are what they say, and their error is that of the sweep's same configuration."""
    rows = registry.queries()["m8_saved_model_holdout"](spark, tables).collect()
    assert len(rows) == 2 * 5 * 24
    assert all(r.prediction_error == r.predicted_trip_count - r.actual_trip_count and r.absolute_error == abs(r.prediction_error) for r in rows)
    swept = {r.config: r for r in forecast_queries.m6(spark, tables).collect()}
    rmse = (sum(r.prediction_error**2 for r in rows) / len(rows)) ** 0.5
    assert swept["linear_ridge"].n == len(rows) and abs(swept["linear_ridge"].rmse - rmse) < 0.001 * rmse + 0.0001
    best = min((r for r in swept.values() if r.selection == "trainable"), key=lambda r: (r.rmse, r.config))
    assert best.best and sum(r.best for r in swept.values()) == 1 and sum(r.best_of_model for r in swept.values()) == 3
    plain = registry.queries()["m7_plain_forest"](spark, tables).first()
    assert plain.n == len(rows) and 0 < plain.rmse < 10 * rmse and plain.mae <= plain.rmse
