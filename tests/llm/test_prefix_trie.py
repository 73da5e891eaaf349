"""Prefix tries against plain prefix counting: ties, nulls, copies, long chains, upper levels of any size; LOUDS navigation."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.llm import prefix_trie as P
from tidecube.llm.queries import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows, rebuild=False):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
        turns = {c: ts if c % 5 == 0 else turns.get(c - c % 5, [])[: h[c]] + ts[h[c] :] for c, ts in turns.items()}
    members = defaultdict(set)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, cs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(cs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(turns[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, rebuild=False, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    labels, ids = P.turn_labels(df), df.select("conv_id").distinct()
    out = P.prefix_trie(rebuilt(labels, ids.where("conv_id is not null")) if rebuild else labels, ids, **how)
    return sorted((tuple(r) for r in out.collect()), key=str)


def sample(n, seed):
    rng = random.Random(seed)
    texts = ["a", "bé", "", None, "cc", "日本"]
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "bot", None]), rng.choice(texts[: rng.choice([2, 6])]), "mine"))
    return rows + rows[:5] + [(None, 0, "user", "x", "mine")]


@pytest.mark.parametrize("shard_turns", [3, 40, 512])
def test_equals_prefix_counting(spark, shard_turns):
    rows = sample(60, shard_turns)
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


@pytest.mark.parametrize("shard_turns", [10, 512])
def test_rebuilt_conversations(spark, shard_turns):
    rows = sample(150, 7)
    assert found(spark, rows, rebuild=True, shard_turns=shard_turns) == brute(rows, rebuild=True)


def test_hot_prefix_copies_and_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(P, "TRIE_TURNS", 50)
    rows = [(c, t, "user", "same" if t < 3 else f"{c % 7}-{t}", None) for c in range(0, 1500, 1) for t in range(4)]
    rows += [(5000, t, "bot", "tick" if t % 2 else "tock", None) for t in range(400)]
    assert found(spark, rows, shard_turns=20) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x", None)]) == []
    labels = P.turn_labels(spark.createDataFrame([], SCHEMA))
    ids = spark.createDataFrame([(3,), (1,), (1,), (None,)], "conv_id long")
    ends = hashlib.sha256(b"1,3").hexdigest()
    assert [tuple(r) for r in P.prefix_trie(labels, ids).collect()] == [(1, 0, None, 2, 0, 1, 0, ends)]


def test_many_ids_of_one_end_are_digested_in_order(spark):
    ids = list(range(-2500, 9000, 3))
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7), (1, 3, 7)], "k1 long, k2 long, conv_id long").repartition(7)
    got = {r["k2"]: (r["conv_id"], r["copies"], r["digest"]) for r in P.same_conversations(ends).collect()}
    assert got == {2: (-2500, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), 3: (7, 1, hashlib.sha256(b"7").hexdigest())}


def test_louds_bits_navigate(spark):
    rng = random.Random(2)
    up = [-1, -1, -1, 0, 0, 2, 3, 3, 5, 5, 5, 6]
    levels = [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9, 10], [11]]
    n = len(up)
    trie = P.Trie.built([np.array([up[i] + 1 for i in level]) for level in levels], [np.arange(len(level)) for level in levels], [np.zeros(len(level), int) for level in levels])
    assert len(trie.bits) == 2 * n + 1 and trie.parents().tolist() == up
    assert trie.degrees().tolist() == [up.count(i) for i in range(n)]
    for i in range(-1, n):
        assert list(trie.children(i)) == [j for j in range(n) if up[j] == i]
    values = np.array([rng.randint(0, 9) for _ in range(n)])
    below = lambda i: values[i] + sum(below(j) for j in range(n) if up[j] == i)
    assert trie.below(values).tolist() == [below(i) for i in range(n)]


def test_packed_tries_hold_every_shard(spark):
    rows = [(c, t, "user", f"{c % 9}-{t}", None) for c in range(40) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = 0
    for r in P.packed_tries(P.turn_labels(df)).collect():
        bits = np.unpackbits(np.frombuffer(r["louds"], np.uint8), bitorder="little")[: 2 * r["n_nodes"] + 1].astype(bool)
        labels = np.frombuffer(r["labels"], "<i8").reshape(-1, 2)
        trie = P.Trie(bits, labels[:, 0], labels[:, 1], [])
        assert len(labels) == r["n_nodes"] and (trie.parents() < np.arange(r["n_nodes"])).all()
        depth = np.frombuffer(r["depth"], "<i8")
        assert (depth[trie.parents()[trie.parents() >= 0]] + 1 == depth[trie.parents() >= 0]).all()
        n += r["n_nodes"]
    assert n == 9 * 6
    assert df.select(F.count("*")).first()[0] == 240
