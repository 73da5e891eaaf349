"""N-gram Jaccard join by vertical partitioning: documents as sets of word shingles, linked where the sets are alike.

All shingles have one global order: the rare before the frequent, then by hash. The order is cut into fragments; a
pair's overlap is counted in each fragment by itself and the counts are summed per pair. Pairs are those that share a
shingle among the first of either, in this order, of which any two alike sets share one.

1. Blocks of documents (dealt by a hash of doc_id) send each distinct shingle once, 5 bytes, with its number of
   documents, to buckets of shingles, which answer with frequency classes of 3 bits.
2. A document whose rare end lies wholly in shingles that no other document has can have no partner. The others are
   written, with their first shingles and their fragments.
3. In a few rounds every document is paired with one other: the most central one, by frequency of its shingles, among
   those with a common first shingle that are not of its component yet. What is alike becomes one component. Then all
   pairs across components that share a first shingle are counted as well. So groups of copies cost a few pairs for
   each member, no link between different components is missed, and nothing is compared within one.

Exact copies of whole texts join their first text's document and take no part in it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import WORD, connected_components, free_memory, written

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: Upper ends of frequency classes 0..6; class 7 is above. Class 0 is for shingles of one document.
CLASSES = np.array([1, 3, 9, 31, 99, 315, 999])
MESSAGE = "bucket int, block int, data binary"
MESSAGES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def table_of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, A-Z as a-z, and which bytes part words."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64))
    codes[65:91] = codes[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return codes, space


CODES, SPACE = table_of_bytes()


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words: differences of a running polynomial, divided by the power of the place."""
    b = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], SPACE[b], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(CODES[b] * powers(BASE, len(b)), out=run[1:])
    back = powers(INVERSE, len(b) + 1)
    return mixed((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(keys: np.ndarray, data: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, ordered; documents are the distinct keys by number. keys ascend."""
    number = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
    docs, grams, at = [], [], 0
    while at < len(data):
        stop, size = at, 0
        while stop < len(data) and number[stop] - number[at] < 1000 and (size < 1 << 20 or number[stop] == number[stop - 1]):
            size += len(data[stop]) + 1
            stop += 1
        h, starts = word_hashes(b"\n".join(data[at:stop]))
        row = np.searchsorted(np.cumsum([len(d) + 1 for d in data[at:stop]]), starts, "right")
        gram = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - words + 1 + k]
        whole = row[words - 1 :] == row[: len(h) - words + 1]
        gram, of = mixed(gram)[whole], row[: len(h) - words + 1][whole]
        count = np.bincount(row, minlength=stop - at)
        for r in np.flatnonzero((count > 0) & (count < words)):  # the whole of a short text is its one shingle
            first = np.searchsorted(row, r)
            one = np.uint64(count[r])
            for x in h[first : first + count[r]]:
                one = mixed(np.array([one]) * np.uint64(0xA0761D6478BD642F) + x)[0]
            gram, of = np.append(gram, one), np.append(of, r)
        base = number[at]
        both = np.sort(((number[at + of] - base).astype(np.uint64) << np.uint64(54)) | (gram >> np.uint64(10)))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        docs.append((both >> np.uint64(54)).astype(np.int64) + base)
        grams.append(both & np.uint64((1 << 54) - 1))
        at = stop
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(docs), np.concatenate(grams)


class Block:
    def __init__(self, group: pa.Table, words: int):
        rows = sorted(zip(group.column("doc_id").to_pylist(), ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in group.column("text"))))
        keys = np.array([k for k, _ in rows], np.int64)
        self.doc, self.gram = shingle_sets(keys, [d for _, d in rows], words)
        self.ids = np.unique(keys)
        self.size = np.bincount(self.doc, minlength=len(self.ids))
        self.known, self.count = np.unique(self.gram, return_counts=True)


def by_bucket(grams: np.ndarray, buckets: int):
    """(bucket, places) for each bucket that has shingles; places in the order of grams."""
    at = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [(int(at[p[0]]), p) for p in np.split(order, cuts)] if len(grams) else []


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), MESSAGES)] if rows else [pa.array([], f.type) for f in MESSAGES], schema=MESSAGES)


def classes_of(sent: pa.Table) -> pa.Table:
    """For each block's shingles, in its order, 3 bits: the class of the number of documents over all blocks."""
    rows, parts = sorted(sent.to_pylist(), key=lambda r: r["block"]), []
    for r in rows:
        n = len(r["data"]) // 5
        parts.append((np.frombuffer(r["data"], "<u4", n), np.frombuffer(r["data"], np.uint8, n, 4 * n)))
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    kind = np.empty(len(keys), np.uint8)
    kind[order] = np.searchsorted(CLASSES, total)
    out, at = [], 0
    for r, (k, _) in zip(rows, parts):
        mine = kind[at : at + len(k)]
        at += len(k)
        if mine.any():
            out.append((r["bucket"], r["block"], np.packbits(np.stack([mine & 1, mine >> 1 & 1, mine >> 2]).ravel()).tobytes()))
    return messages(out)


def link_ngrams(docs: DataFrame, words: int = 5, percent: int = 80, fragments: int = 8, rounds: int = 3, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id of docs(doc_id, text), one row for each distinct doc_id.

    Words part at ASCII white space, A-Z count as a-z. A set is the distinct shingles of `words` words, the whole text
    as one shingle if it has fewer; two documents link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable by links, the document's own included. Null and empty texts have no shingles and link with
    nothing; rows that share a doc_id are one document with the shingles of all; rows without a doc_id are one row with
    null doc_id and component_id; extra columns are dropped; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-blocks // 2))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")

    once = rows.select("doc_id", F.when(F.col("text").rlike(WORD), F.sha2("text", 256)).alias("h"))
    once = once.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("h").alias("h")).where("n = 1 and h is not null").drop("n")
    first = once.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first")  # so that the join below can split what many copies of one text make large
    copies = written(once.join(first, "h").where("doc_id > first").select("doc_id", "first"), "copies")

    fresh = lambda df: df.toDF(*df.columns)
    kept = rows.withColumn("block", block)
    gone = copies.select(block.alias("block"), F.col("doc_id").alias("doc_id")).toDF("block", "doc_id")

    def alive(group: pa.Table, gone: pa.Table) -> pa.Table:
        drop = set(gone.column("doc_id").to_pylist())
        return group.filter(pa.array([d not in drop for d in group.column("doc_id").to_pylist()], pa.bool_())) if drop else group

    def send(_key, group: pa.Table, gone: pa.Table) -> pa.Table:
        group = alive(group, gone)
        if not group.num_rows:
            return messages([])
        number, b = group.column("block")[0].as_py(), Block(group, words)
        count = np.minimum(b.count, 255).astype(np.uint8)
        out = [(k, number, b.known[at].astype("<u4").tobytes() + count[at].tobytes()) for k, at in by_bucket(b.known, buckets)]
        #: what the next step is to leave out goes there with the answers
        drop = np.array(gone.column("doc_id").to_pylist(), "<i8")
        return messages([*out, (-1 - number % buckets, number, drop.tobytes())])

    def answer(group: pa.Table) -> pa.Table:
        return group.select(["bucket", "block", "data"]) if group.column("bucket")[0].as_py() < 0 else classes_of(group)

    def judge(_key, group: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("alone", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.int64())))])
        told = told.to_pylist()
        drop = [np.frombuffer(r["data"], "<i8") for r in told if r["bucket"] < 0]
        group = alive(group, pa.table({"doc_id": pa.array(np.concatenate(drop) if drop else [], pa.int64())}))
        if not group.num_rows:
            return schema.empty_table()
        b = Block(group, words)
        kind, heard = np.zeros(len(b.known), np.uint8), {r["bucket"]: r["data"] for r in told}
        for k, at in by_bucket(b.known, buckets):
            if k in heard:
                bits = np.unpackbits(np.frombuffer(heard[k], np.uint8), count=3 * len(at)).reshape(3, -1)
                kind[at] = bits[0] + 2 * bits[1] + 4 * bits[2]
        kind = kind[np.searchsorted(b.known, b.gram)]
        alone = np.bincount(b.doc, kind == 0, len(b.ids)).astype(np.int64)
        need = b.size - (b.size * percent + 99) // 100 + 1
        score = np.bincount(b.doc, kind, len(b.ids)) * 1000 // np.maximum(b.size, 1)
        ends = np.cumsum(b.size)
        prefix, parts = [None] * len(b.ids), [None] * len(b.ids)
        for i in np.flatnonzero((b.size > 0) & (alone < need)):
            mine = slice(ends[i] - b.size[i], ends[i])
            gram, rank = b.gram[mine].astype(np.int64), kind[mine]
            order = np.lexsort((gram, rank))
            prefix[i] = gram[order[alone[i] : need[i]]]
            shared = gram[rank > 0]
            #: fragments are ranges of the hash, equal in number of possible values
            parts[i] = np.split(shared, np.searchsorted(shared, [(f << 54) // fragments for f in range(1, fragments)]))
        free_memory()
        return pa.Table.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.size, pa.int64()), pa.array(score.astype(np.int64)), pa.array(alone), pa.array(prefix, schema.field(4).type), pa.array(parts, schema.field(5).type)], schema=schema)

    by = lambda df: fresh(df).groupBy("block")
    sent = by(kept).cogroup(by(gone)).applyInArrow(send, MESSAGE)
    told = sent.groupBy("bucket").applyInArrow(answer, MESSAGE)
    sets = by(kept).cogroup(by(told)).applyInArrow(judge, "doc_id long, n long, score long, alone long, prefix array<long>, parts array<array<long>>")
    sets = written(sets, "sets")

    #: rest: shingles of the document from this one on in the order. Two sets of na and nb shingles that link share at
    #: least percent * (na + nb) / (100 + percent); the first that they share leaves each with that many. So a partner
    #: has `most` shingles at most, and `least` at least.
    first_grams = sets.where("prefix is not null").select("doc_id", "n", "score", F.posexplode("prefix").alias("k", "gram"), "alone")
    first_grams = first_grams.select("gram", "doc_id", "n", "score", (F.col("n") - F.col("alone") - F.col("k")).alias("rest"))
    first_grams = first_grams.withColumns({"least": F.expr(f"({percent} * n + 99) div 100"), "most": F.least(F.expr(f"100 * n div {percent}"), F.expr(f"((100 + {percent}) * rest) div {percent} - n"))}).where("least <= most")
    pieces = sets.where("parts is not null").select("doc_id", "n", F.posexplode("parts").alias("part", "grams"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b, na, nb) that link: overlaps counted fragment by fragment, summed per pair."""
        left = pairs.join(pieces.select(F.col("doc_id").alias("a"), "part", F.col("grams").alias("ga")), "a")
        both = left.join(pieces.select(F.col("doc_id").alias("b"), "part", F.col("grams").alias("gb")), ["b", "part"])
        common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
        summed = common.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("o"))
        return summed.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")

    ordered = lambda df: df.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(F.col("a") > F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("nb")
    ).distinct()
    lists, groups, found, tried = first_grams, None, None, None

    def join_up(groups: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components of what is grouped and the links found since."""
        stars = [] if groups is None else [groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))]
        return written(connected_components(reduce(DataFrame.unionByName, stars, found)), "groups")

    def divided(lists: DataFrame, groups: DataFrame | None) -> DataFrame:
        """Members of lists that hold several components, with c, their own, and t1 and t2: the most central member of the
        list and the most central one of another component than t1's. Components are dealt to classes first, and a list
        has one best of each class, so a list of very many members is gathered nowhere; t2 is null where all are in t1's
        class, whose members are then only met from the other side."""
        plain = lists.select("gram", "doc_id", "n", "score", "least", "most")
        own = plain.withColumn("c", F.col("doc_id"))
        if groups is not None:
            own = plain.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        best = F.struct(F.struct("score", (-F.col("doc_id")).alias("minus"), "n", "least", "most").alias("best"), "c")
        of_class = own.groupBy("gram", F.pmod(F.xxhash64("c"), F.lit(16)).alias("class")).agg(F.max(best).alias("t"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        tops = of_class.groupBy("gram").agg(F.sort_array(F.collect_list("t"), asc=False).alias("t"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("c0 <> c1")
        tops = written(tops.select("gram", F.col("t")[0].alias("t1"), F.get("t", F.lit(1)).alias("t2")), "tops")  # so that the join below can split a long list
        return written(own.join(tops, "gram"), "lists")

    for _ in range(rounds):
        groups = None if found is None else join_up(groups, found)
        lists = divided(lists, groups)
        head = F.when(F.col("c") == F.col("t1.c"), F.col("t2.best")).otherwise(F.col("t1.best"))
        pairs = lists.select("doc_id", "n", "least", "most", head.alias("h")).where("h.n between least and most and n between h.least and h.most").select(F.col("doc_id").alias("a"), F.col("n").alias("na"), (-F.col("h.minus")).alias("b"), F.col("h.n").alias("nb"), F.col("h.score").alias("score")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select(F.col("a"), F.col("b")), (F.least(pairs["a"], pairs["b"]) == tried["a"]) & (F.greatest(pairs["a"], pairs["b"]) == tried["b"]), "left_anti")
        pairs = pairs.groupBy("a", "na").agg(F.max(F.struct("score", (-F.col("b")).alias("minus"), "nb")).alias("h")).select("a", "na", (-F.col("h.minus")).alias("b"), F.col("h.nb").alias("nb"))
        pairs = written(ordered(pairs), "pairs")
        found = written(alike(pairs), "links")
        tried = pairs.select("a", "b") if tried is None else written(tried.unionByName(pairs.select("a", "b")), "tried")
        if found.isEmpty():
            break

    groups = join_up(groups, found)
    lists = divided(lists, groups)
    main = F.col("t1.c")
    #: sizes in classes of a twentieth, so that a member only meets those of sizes that it can link with
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05))).cast("int")
    other = lists.where(F.col("c") != main).withColumn("k", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))))
    other = other.select("gram", "k", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("least").alias("la"), F.col("most").alias("ma"))
    each = lists.select("gram", size_class(F.col("n")).alias("k"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("least").alias("lb"), F.col("most").alias("mb"))
    fits = F.expr("ca <> cb and nb between la and ma and na between lb and mb")
    cross = other.join(each, (other["gram"] == each["gram"]) & (other["k"] == each["k"]) & fits).select("a", "b", "na", "nb")
    cross = written(ordered(cross).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = written(alike(cross), "links")
    if not more.isEmpty():
        groups = join_up(groups, more)

    known = sets.select("doc_id", "n").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    of_first = known.select(F.col("doc_id").alias("first"), "n_shingles", "component_id")
    out = known.unionByName(copies.join(of_first, "first").select("doc_id", "n_shingles", "component_id"))
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")).distinct()
    return out.unionByName(nameless)
