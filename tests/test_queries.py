"""Every query of the library against its DuckDB SQL over the smallest tables; those of the full grid over fewer orders."""

import os
import re
import shutil

import duckdb
import pytest

from tidecube.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
#: Their grid has a row for each zone, date and hour, so orders of a few zones and dates are enough to compare.
GRIDS = re.compile(r"_full$|^m[6-9]_|^a32_|^a31_checked|^t12_best_h|^s23_best_h")


def views(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The tables, and the tables with the orders of five nations on every other day."""
    few = str(tmp_path_factory.mktemp("few"))
    for f in os.listdir(SF):
        shutil.copy(f"{SF}/{f}", few)
    con = duckdb.connect()
    kept = f"SELECT o.* FROM '{SF}/orders.parquet' o JOIN '{SF}/customer.parquet' c ON o_custkey = c_custkey WHERE c_nationkey % 5 = 1 AND dayofyear(o_orderdate) % 2 = 1"
    con.sql(f"COPY ({kept}) TO '{few}/orders.parquet' (FORMAT parquet)")
    return {at: views(at) for at in (SF, few)}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, folders, name):
    whole, few = folders
    at = few if GRIDS.search(name) else whole
    df = registry.queries()[name](spark, at)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = folders[at].sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
