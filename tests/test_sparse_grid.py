"""The sparse grid and its histories against a dense grid counted in plain Python, and what its plan reads and shuffles."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from tidecube.operators import forecast
from tidecube.plans import registry
from tidecube.sources import files

NAMES = ["location_avg", "location_hour_avg", "location_dow_hour_avg", "previous_month_location_hour_avg", "location_hour_zero_rate"]
SF = "/root/testdata/sf0.001"


def observed(seed, n):
    rng = random.Random(seed)
    days = [dt.date(2023, 1, 1) + dt.timedelta(rng.choice([0, 31, 62, 63, 150, 151, 400, rng.randint(0, 500)])) for _ in range(40)]
    return [(*k, float(v)) for k, v in {(rng.choice([1, 2, 5, 9]), rng.choice(days), rng.choice([0, 1, 3, 7])): rng.choice([0, 1, 2, 50]) for _ in range(n)}.items()]


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def dense(rows, stride, hours):
    zones, dates = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if stride > 1:
        dates = [d for d in dates if d.timetuple().tm_yday % stride == 1]
    trips = {r[:3]: r[3] for r in rows}
    grid = {(z, d, h): trips.get((z, d, h), 0.0) for z in zones for d in dates for h in range(hours)}
    month, dow = lambda d: d.year * 12 + d.month, lambda d: d.isoweekday() % 7 + 1
    keys = [lambda z, d, h: (z,), lambda z, d, h: (z, h), lambda z, d, h: (z, dow(d), h), lambda z, d, h: (h,)]
    cells = [defaultdict(lambda: defaultdict(list)) for _ in keys]
    for (z, d, h), v in grid.items():
        for key, cell in zip(keys, cells):
            cell[key(z, d, h)][month(d)].append(v)

    def past(i, z, d, h, of=mean):
        return mean([of(v) for m, v in cells[i][keys[i](z, d, h)].items() if m < month(d)])

    out = {}
    for (z, d, h), v in grid.items():
        la = past(0, z, d, h)
        la = la if la is not None else (past(3, z, d, h) or 0.0)
        lh, ld, zr = past(1, z, d, h), past(2, z, d, h), past(1, z, d, h, lambda xs: mean([float(x == 0) for x in xs]))
        lh = la if lh is None else lh
        pm = cells[1][z, h].get(month(d) - 1)
        out[z, d, h] = (v, la, lh, lh if ld is None else ld, lh if pm is None else mean(pm), 1.0 if zr is None else zr)
    return out


@pytest.mark.parametrize(("seed", "n", "stride", "hours"), [(1, 200, 1, 8), (2, 60, 1, 24), (3, 300, 30, 2), (4, 1, 1, 3)])
def test_histories_equal_the_dense_grid(spark, seed, n, stride, hours):
    rows = observed(seed, n)
    df = spark.createDataFrame(rows, "PULocationID long, pickup_date date, pickup_hour int, trip_count double")
    found = forecast.SparseGrid(forecast.cells(df), stride, hours).with_history().collect()
    got = {(r.PULocationID, r.pickup_date, r.pickup_hour): (r.trip_count, *(r[c] for c in NAMES)) for r in found}
    want = dense(rows, stride, hours)
    assert got.keys() == want.keys() and len(found) == len(got)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    plain = {(r.PULocationID, r.pickup_date, r.pickup_hour): r.trip_count for r in forecast.grid(df, stride, hours).collect()}
    assert plain == {k: v[0] for k, v in want.items()}


def test_no_demand_is_no_grid(spark):
    df = spark.createDataFrame([], "PULocationID long, pickup_date date, pickup_hour int, trip_count double")
    assert forecast.SparseGrid(forecast.cells(df)).with_history().collect() == []


def test_cells_are_read_and_nothing_of_the_grids_size_is_shuffled(spark, tmp_path):
    df = spark.createDataFrame(observed(5, 100), "PULocationID long, pickup_date date, pickup_hour int, trip_count double")
    cells = files.kept(forecast.cells(df), f"{tmp_path}/cells")
    plan = forecast.SparseGrid(cells).with_history()._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    top = plan[: plan.index("Join")]
    assert top.count("Generate") == 2 and "Aggregate" not in top  # rows are made above all joins


def test_orders_are_read_once(spark):
    plan = registry.queries()["a31_regression_metrics_full"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderdate" not in plan and "trip_count" in plan
