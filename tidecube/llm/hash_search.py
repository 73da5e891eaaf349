"""Nearest neighbours by multi-index hashing: rotated binary codes, whose substrings are indexed.

Vectors become codes of signs after rotations that are learned so that signs lose little (iterative quantisation). A code
within Hamming distance r of a query's code is within r / m in at least one of m substrings (pigeonhole), so a table for each
substring finds all of them. How far to look is learned as well: for each score, the distance that most pairs of that score
keep. Floats rank what was found. All vectors are indexed, in blocks that tasks can hold; the stated queries meet the
blocks in blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecube.llm.common import written

#: Vectors a block of the index, queries a block of queries, and what vectors of either take at most: what bounds a task's memory.
BLOCK, QUERIES, BLOCK_BYTES = 8192, 4096, 8 << 20
#: Substrings are bytes of the code.
NEAR = [np.array([v for v in range(256) if v.bit_count() <= t], np.uint8) for t in range(9)]
PACKED = "block long, n long, d long, keys binary, vectors binary, codes binary, radius binary"


class Fitted(NamedTuple):
    """What turns vectors into codes, and scores into distances."""

    mean: np.ndarray
    norm: float
    rotation: np.ndarray
    #: distances[i]: how far codes of pairs with a cosine of at least i / 50 - 1 are, but for few
    distances: np.ndarray
    #: a bounded part of the vectors, which tells how good a query's neighbours are at least
    sample: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more component, so that all are of one length and the largest product is the smallest angle."""
        x = (x - self.mean) / self.norm
        rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.column_stack([x, rest - 0.5])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(self.lifted(x) @ self.rotation > 0, axis=1)

    def query_codes(self, q: np.ndarray) -> np.ndarray:
        return np.packbits((q / np.linalg.norm(q, axis=1, keepdims=True)) @ self.rotation[:-1] > 0, axis=1)

    def radius(self, q: np.ndarray, top: int) -> np.ndarray:
        """For each query, from the score of its `top`-th neighbour in the sample."""
        k = min(top, len(self.sample))
        kth = -np.partition(-(q @ (self.sample - self.mean).T), k - 1, axis=1)[:, k - 1]
        cosine = kth / (np.linalg.norm(q, axis=1) * self.norm)
        return self.distances[np.clip(np.floor((cosine + 1) * 50), 0, 100).astype(int)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of a to each row of b, codes as bytes."""
    a, b = (x.view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def fit(sample: np.ndarray, bits: int, top: int, keep: float, rounds: int = 20) -> Fitted:
    """Rotations by iterative quantisation from fixed random starts, as many as the bits need; distances by score from the
    sample's own neighbours, of which a share `keep` is to be found. The same sample gives the same result."""
    rng = np.random.default_rng(12)
    mean = sample.mean(0)
    norm = float(max(np.linalg.norm(sample - mean, axis=1).max(), 1e-300))
    start = Fitted(mean, norm, np.zeros(0), np.zeros(0), sample)
    x = start.lifted(sample)
    d, rotations = x.shape[1], []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ v).T
        rotations.append(turn)
    fitted = start._replace(rotation=np.hstack(rotations)[:, :bits])
    own = rng.permutation(len(sample))[:500]
    q = sample[own]
    apart = distance(fitted.query_codes(q), fitted.codes(sample))
    cosine = q @ (sample - mean).T / (np.linalg.norm(q, axis=1)[:, None] * norm)
    best = np.argsort(-cosine, axis=1)[:, : 10 * top + 1]
    score, apart = (np.take_along_axis(v, best, 1).ravel() for v in (cosine, apart))
    table, order = np.full(101, bits, np.int64), np.argsort(-score)
    score, apart = score[order], apart[order]
    for i in range(101):
        n = int(np.searchsorted(-score, -(i / 50 - 1), side="right"))
        if n >= 200:  # the pairs with this score and a little more
            table[i] = int(np.ceil(np.quantile(apart[max(0, n - 2000) : n], keep)))
    if (table < bits).any():  # scores that no pair of the sample has are as far as the best that some have
        last = int(np.flatnonzero(table < bits)[-1])
        table[last + 1 :] = table[last]
    return fitted._replace(distances=table)


class Tables:
    """A table for each byte of the codes: which codes have which value there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(np.sort(codes[:, j]), np.arange(257)) for j in range(codes.shape[1])])

    def within(self, query: np.ndarray, r: int) -> np.ndarray:
        """Numbers of all codes within r of the query's. With r = m t + a, one of the first a + 1 substrings is within t or
        one of the others within t - 1. If those buckets hold more than all codes once, codes are looked at straight away."""
        m = self.codes.shape[1]
        t, a = divmod(int(r), m)
        reach = [min(t if j <= a else t - 1, 8) for j in range(m)]
        values = [NEAR[x] ^ query[j] if x >= 0 else NEAR[0][:0] for j, x in enumerate(reach)]
        sizes = [self.starts[j][v.astype(int) + 1] - self.starts[j][v] for j, v in enumerate(values)]
        if sum(int(s.sum()) for s in sizes) >= len(self.codes):
            found = np.arange(len(self.codes))
        else:
            parts = [self.order[self.starts[j][x] : self.starts[j][int(x) + 1], j] for j, v in enumerate(values) for x in v[sizes[j] > 0]]
            found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        return found[distance(query[None], self.codes[found])[0] <= r]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is neither null nor zero, has only finite components and as many as most rows have (of
    sizes equally often the larger one); equal rows once."""
    v = F.col("embedding")
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(v) == (size["d"] if size else 0))
    return rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: DataFrame, fitted: Fitted, size: int, top: int, queries: bool, wider: int = 0) -> DataFrame:
    """Blocks of about `size` rows, dealt by hash: PACKED, with codes of queries and how far they look, or of the index."""
    bits = fitted.rotation.shape[1]
    n = rows.count()
    blocks = max(-(-n // size), 1)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def pack(batches):
        held = []

        def block(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            x = as_matrix(t.column("embedding").combine_chunks())
            keys = np.stack([t.column(c).to_numpy() for c in ("k1", "k2", "least")], axis=1).astype("<i8")
            f = shared.value
            codes, radius = (f.query_codes(x), np.minimum((f.radius(x, top) + 8) * 2**wider - 8, bits)) if queries else (f.codes(x), np.zeros(0))
            row = [t.column("block")[0].as_py(), len(x), x.shape[1], keys.tobytes(), x.astype("<f8").tobytes(), codes.tobytes(), radius.astype("<i8").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in PACKED.split(", ")], row))])

        for b in batches:
            at = 0
            ids = b.column("block").to_numpy()
            for cut in [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]:
                if held and cut > at and held[0].column("block")[0].as_py() != ids[at]:
                    yield block(held)
                    held = []
                if cut > at:
                    held.append(b.slice(at, cut - at))
                at = cut
        if held:
            yield block(held)

    dealt = rows.select(F.pmod("k1", F.lit(blocks)).alias("block"), "k1", "k2", "least", "embedding")
    return written(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(pack, PACKED), "queries" if queries else "index")


def search(batches, top: int) -> Iterator[pa.RecordBatch]:
    """The `top` best of each query in a block of the index: q1, q2 (the query's key), k1, k2, least, score."""
    for b in batches:
        for r in b.to_pylist():
            part = lambda name, kind, w: np.frombuffer(r[name], kind).reshape(-1, w)
            keys, x, codes = part("keys", "<i8", 3), part("vectors", "<f8", r["d"]), part("codes", np.uint8, len(r["codes"]) // r["n"])
            own, q, of = part("q_keys", "<i8", 3), part("q_vectors", "<f8", r["d"]), part("q_codes", np.uint8, codes.shape[1])
            tables, radius, found = Tables(codes), np.frombuffer(r["q_radius"], "<i8"), []
            for i in range(len(q)):
                at = tables.within(of[i], radius[i])
                if len(at) > 2 * top:
                    rough = x[at] @ q[i]
                    least = np.partition(rough, -top)[-top]
                    at = at[rough >= least - 1e-9 * abs(least) - 1e-12]
                score = (x[at] * q[i]).sum(1)  # the same for equal vectors, wherever they are
                best = at[np.lexsort((keys[at, 2], -score))[:top]]
                found.append((np.full(len(best), i), best, (x[best] * q[i]).sum(1)))
            i, at, score = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[i, 0], own[i, 1], keys[at, 0], keys[at, 1], keys[at, 2], score)], ["q1", "q2", "k1", "k2", "least", "score"])


def nearest_kinds(index: DataFrame, of: DataFrame, top: int) -> DataFrame:
    """search of every block of queries in every block of the index, and of that the `top` best of each query. Each pair of
    blocks is a key of its own, so pairs are dealt evenly whatever their number."""
    n_index, n_of = (df.agg(F.max("block")).first()[0] for df in (index, of))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n)).cast("array<long>")).alias(name)
    left = index.select(F.col("block").alias("i"), "n", "d", "keys", "vectors", "codes", every(n_of, "j"))
    right = of.select(F.col("block").alias("j"), every(n_index, "i"), *[F.col(c).alias(f"q_{c}") for c in ("keys", "vectors", "codes", "radius")])
    pairs = left.join(right, ["i", "j"]).select("n", "d", "keys", "vectors", "codes", "q_keys", "q_vectors", "q_codes", "q_radius")
    found = pairs.mapInArrow(lambda batches: search(batches, top), "q1 long, q2 long, k1 long, k2 long, least long, score double")
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least")
    return written(found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).drop("at"), "best")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, bits: int = 128, sample: int = 20_000, keep: float = 0.93) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `top` rows of vectors(vec_id, embedding) with the largest inner products with
    each of queries(vec_id), ids of rows among them, that are found; ties go to the smaller vec_id; a row is no neighbour of
    its own id. Scores are in double precision, of the vectors as they are.

    Rows that take no part (see usable) are neither found nor searched for. Equal vectors are searched for and found once, and
    stand for all their ids. Rotations and distances are learned from at most `sample` vectors, those with the smallest
    hashes, and less if they would take over 64 MB; every vector is indexed. `keep` is the share of neighbours in the sample
    that is to be within the distance. Other columns are left alone; empty tables give an empty result.
    """
    if bits % 64:
        raise ValueError("bits is a multiple of 64")
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    kinds = rows.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), (F.count_distinct("vec_id") > 1).alias("several"))
    kinds = written(kinds, "kinds")
    ids = rows.select("vec_id", "k1", "k2").distinct()
    asked = written(ids.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")), "asked")
    first = kinds.select(F.size("embedding").alias("d")).first()
    if first is None or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = min(sample, (64 << 20) // (8 * first["d"]))
    taken = kinds.orderBy("k1", "k2").select("embedding").limit(max(least, 1)).toArrow()
    fitted = fit(as_matrix(taken.column("embedding").combine_chunks()), bits, top, keep)
    distinct = asked.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct()
    most = max(BLOCK_BYTES // (8 * first["d"]), 1)
    index = packed(kinds.drop("several"), fitted, min(BLOCK, most), top + 1, False)
    wanted, size, wider = written(kinds.drop("several").join(distinct, ["k1", "k2"], "left_semi"), "wanted"), min(QUERIES, most), 0
    best = found = nearest_kinds(index, packed(wanted, fitted, size, top + 1, True), top + 1)
    enough = min(top + 1, kinds.count())
    while True:  # queries that found too few look twice as far, at last at all codes
        few = found.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).count().where(F.col("count") >= enough)
        wanted = written(wanted.join(few, ["k1", "k2"], "left_anti"), "wanted")
        if wanted.isEmpty():
            break
        wider += 1
        found = nearest_kinds(index, packed(wanted, fitted, size, top + 1, True, wider), top + 1)
        again = wanted.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"))
        best = best.join(again, ["q1", "q2"], "left_anti").unionByName(found)
    #: of equal vectors, as many of the smallest ids as can be among the nearest
    same = ids.join(kinds.where("several").select("k1", "k2"), ["k1", "k2"], "left_semi")
    same = same.withColumn("at", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("at") <= top + 1).drop("at")
    members = best.join(same, ["k1", "k2"], "left").select("q1", "q2", F.coalesce("vec_id", "least").alias("vec_id"), "score")
    order = [F.desc("score"), "vec_id"]
    members = members.withColumn("at", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(*order))).where(F.col("at") <= top + 1).drop("at")
    out = asked.join(members, ["q1", "q2"]).where("vec_id <> query_id")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
