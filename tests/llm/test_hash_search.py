"""Multi-index hashing: probing against all codes, recall against brute force, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.llm import hash_search as H
from tidecube.llm.queries import op12_hash_search

SCHEMA = "vec_id long, embedding array<float>, score string, k1 string"


def near(spark, rows, top=20, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in H.nearest(df, df.where("vec_id % 20 = 0"), top, **how).orderBy("query_id", "rank").collect()]


def brute(ids, x, top=20):
    """Every query's neighbours, scores as sums in double precision."""
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order[:top]]
    return out


def recall(found, want):
    hit = total = 0
    for q, best in want.items():
        least = best[-1][1] if best else 0
        hit += sum(s >= least - 1e-12 for i, _, _, s in found if i == q)
        total += len(best)
    return hit / max(total, 1)


@pytest.mark.parametrize("spread", [0.02, 0.6])
@pytest.mark.parametrize("r", [0, 3, 7, 8, 15, 16, 40, 70, 128])
def test_probing_finds_every_code_within_the_radius(spread, r):
    rng = np.random.default_rng(r)
    centre = rng.integers(0, 2, (1, 128))
    bits = np.where(rng.random((700, 128)) < spread, 1 - centre, centre).astype(np.uint8)
    codes = np.packbits(bits, axis=1)
    tables = H.Tables(codes)
    for q in codes[:20]:
        want = [i for i in range(len(codes)) if sum(int(a ^ b).bit_count() for a, b in zip(q, codes[i])) <= r]
        assert tables.within(q, r).tolist() == want


def test_probing_goes_by_buckets_where_they_are_few(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (5000, 16)).astype(np.uint8)
    looked, whole = [], H.distance
    monkeypatch.setattr(H, "distance", lambda a, b: looked.append(len(b)) or whole(a, b))
    assert H.Tables(codes).within(codes[7], 15).tolist() == [7]
    assert looked[0] < 1000


def rows_of(x, ids=None):
    return [(int(i), [float(c) for c in v], "mine", "k") for i, v in zip(range(len(x)) if ids is None else ids, x)]


def test_random_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 300)
    monkeypatch.setattr(H, "QUERIES", 20)
    rng = np.random.default_rng(3)
    for x in (rng.standard_normal((1500, 32)), rng.standard_normal((12, 32))[rng.integers(0, 12, 1500)] + 0.1 * rng.standard_normal((1500, 32)) + 3):
        x = np.float32(x).astype(float)
        found, want = near(spark, rows_of(x)), brute(np.arange(len(x)), x)
        assert [(q, rank) for q, rank, _, _ in found] == [(q, k + 1) for q in want for k in range(20)]
        assert recall(found, want) >= 0.9
        score = {(q, i): s for q, best in want.items() for i, s in best}
        assert all(s == score[q, i] for q, _, i, s in found if (q, i) in score)


def test_small_tables_are_exact_and_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(4)
    x = np.float32(rng.standard_normal((30, 8))).astype(float)
    x[5:25] = x[5]
    ids = np.arange(30) * 10 + 100
    found = near(spark, rows_of(x, ids), top=6, keep=1.0)
    want = brute(ids, x, 6)
    assert found == [(q, k + 1, i, s) for q, best in sorted(want.items()) for k, (i, s) in enumerate(best)]


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(6)
    x = np.float32(rng.standard_normal((900, 16))).astype(float)
    x[::3] = x[0]
    found, want = near(spark, rows_of(x)), brute(np.arange(900), x)
    assert recall(found, want) >= 0.9 and len(found) == 45 * 20
    for q in range(0, 900, 60):
        assert [(i, s) for p, _, i, s in found if p == q] == want[q]


def test_rows_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    good = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [-0.0, -1.0]), (None, [5.0, 5.0]), (40, [0.5, 0.5])]
    rows = [(100 + 20 * i, v, None, None) for i, v in enumerate(odd)] + [(i, v, None, None) for i, v in good]
    found = near(spark, rows, keep=1.0)
    assert found == [(20, 1, 1, 2.0), (20, 2, 2, 1.0), (20, 3, 40, 0.5), (20, 4, 3, 0.0), (40, 1, 1, 1.0), (40, 2, 2, 1.0), (40, 3, 20, 0.5), (40, 4, 3, -0.5)]
    assert near(spark, []) == [] and near(spark, [(1, [1.0], None, None)]) == [] and near(spark, [(20, [1.0], None, None)]) == []


def test_query_recall_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("embedding").isNotNull()).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = [tuple(r) for r in op12_hash_search(spark, sf).collect()]
    want = brute(ids, x)
    assert len(found) == sum(map(len, want.values())) and recall(found, want) >= 0.9
