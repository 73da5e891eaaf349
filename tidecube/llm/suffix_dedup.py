"""Suffix-array dedup: bytes under strings of a minimum length that an earlier document has too.

The work runs over blocks of documents (dealt by a hash of doc_id and text) and buckets of strings (dealt by content):

1. Every block takes one anchor for each window of `length` bytes: the place in it whose k bytes hash lowest. Equal
   windows have equal anchors. A block sends each distinct anchor once, 5 bytes, with its number of documents.
2. A bucket of anchors tells each block which of its anchors are in two documents or more, and which in very many.
3. The block sends the windows of such anchors, as stretches of text of at most 2 * length - k bytes, each distinct
   stretch once. Windows of very frequent anchors travel one by one, dealt by their own bytes, so that no bucket
   gathers all that surrounds one frequent passage.
4. A bucket writes its distinct stretches one after another, builds their Burrows-Wheeler transform and extends its
   intervals backwards, breadth first: step l finds all common prefixes of length l, and the step of the minimum
   length ends it. The rows between two borders are equal windows; the smallest doc_id of each decides.
5. The block covers the bytes and cuts the texts.

Exact copies of a whole text are found by a hash beforehand (an aggregation with partial sums) and take no part in it;
of rows that share a doc_id, only those with that text are such copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import written

K = 24
NULL_ID = np.iinfo(np.int64).max
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the K = 16 + 8 bytes at every place that has them, by doubling."""
    h, power, size = b.astype(np.uint64) + np.uint64(1), BASE, 1
    eight = None
    while size < 16:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
        if size == 8:
            eight, shift = h, power
    n = len(b) - K + 1
    return mixed(h[:n] * np.uint64(shift) + eight[16 : 16 + n])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of w neighbours, from every place that has w."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows inside documents (which end at ends): keys of their anchors, first and last window, document."""
    w = length - K + 1
    keys, first, last = [], [], []
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        b = text[at : at + CHUNK + length - 1]
        h = gram_hashes(b)
        v = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        spot = (sliding_min(v, w) & np.uint64((1 << 20) - 1)).astype(np.int64)
        begin = np.arange(len(spot))
        doc = np.searchsorted(ends, begin + at, "right")
        inside = ends[np.minimum(doc, len(ends) - 1)] >= begin + at + length
        new = np.ones(len(spot), bool)
        new[1:] = (spot[1:] != spot[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
        new &= inside
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        outside = np.append(np.flatnonzero(~inside), len(spot))
        stop = np.minimum(np.append(starts[1:], len(spot)), outside[np.searchsorted(outside, starts)]) - 1
        keys.append(mixed(h[spot[starts]]))
        first.append(starts + at)
        last.append(stop + at)
    if not keys:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    first = np.concatenate(first)
    return np.concatenate(keys), first, np.concatenate(last), np.searchsorted(ends, first, "right")


def stretch_hashes(text: np.ndarray, first: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """A hash of text[first : first + size] for each."""
    weights = mixed(np.arange(1, longest + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty(len(first), np.uint64)
    padded = np.append(text, np.zeros(longest, np.uint8))
    for a in range(0, len(first), 8192):
        at = first[a : a + 8192, None] + np.arange(longest)
        part = np.where(np.arange(longest) < size[a : a + 8192, None], padded[at], 0).astype(np.uint64) + np.uint64(1)
        part = (part * weights) ^ ((part * weights) >> np.uint64(27))
        out[a : a + 8192] = mixed((part * weights[::-1]).sum(1, dtype=np.uint64) + size[a : a + 8192].astype(np.uint64))
    return out


class Block:
    """The documents of one block, in order of doc_id, then text."""

    def __init__(self, docs: pa.Table, length: int):
        ids = docs.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        keys = np.where(self.null, NULL_ID, np.asarray(ids.fill_null(NULL_ID)))
        data = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in docs.column("text")]
        order = sorted(range(len(data)), key=lambda i: (keys[i], data[i]))
        self.ids, self.null, self.data = keys[order], self.null[order], [data[i] for i in order]
        self.ends = np.cumsum([len(d) for d in self.data]).astype(np.int64)
        self.text = np.frombuffer(b"".join(self.data), np.uint8)
        self.length = length

    def rows_of(self, copies: set) -> np.ndarray:
        """Places of the rows whose doc_id and text are in copies, as (doc_id, SHA-256)."""
        ids = {i for i, _ in copies}
        found = [k for k, i in enumerate(self.ids.tolist()) if i in ids and not self.null[k] and (i, hashlib.sha256(self.data[k]).hexdigest()) in copies]
        return np.array(found, np.int64)

    def runs(self, copies: np.ndarray):
        """Anchor runs without those of rows that are whole copies."""
        key, first, last, doc = anchors(self.text, self.ends, self.length)
        if len(copies):
            keep = ~np.isin(doc, copies)
            key, first, last, doc = key[keep], first[keep], last[keep], doc[keep]
        return key, first, last, doc

    def distinct(self, key, doc):
        """Distinct keys and in how many doc_ids each is, 255 at most."""
        order = np.lexsort((self.ids[doc], key))
        k, d = key[order], self.ids[doc][order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        starts = np.flatnonzero(new)
        return k[starts], np.minimum(np.add.reduceat(other.astype(np.int64), starts) if len(starts) else starts, 255).astype(np.uint8)


MESSAGE = "bucket int, block int, kind int, data binary"
MESSAGES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
COPIES, KEYS, STRETCHES, COVER = 0, 1, 2, 3


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), MESSAGES)] if rows else [pa.array([], f.type) for f in MESSAGES], schema=MESSAGES)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places in keys) for each bucket that has keys; places in the order of keys."""
    at = bucket_of(keys, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [(int(at[p[0]]), p) for p in np.split(order, cuts)] if len(keys) else []


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """32 bits of each key, which within a bucket are enough: two keys that share them only cost a needless comparison."""
    return keys.astype("<u4").tobytes() + counts.tobytes()


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, np.uint8, n, 4 * n)


def judge_keys(sent: pa.Table, hot: int) -> list[tuple]:
    """For each block's keys, in its order: 0 one document, 1 several, 2 more than hot."""
    rows = sorted((r for r in sent.to_pylist() if r["kind"] == KEYS), key=lambda r: r["block"])
    out = [(r["bucket"], r["block"], COPIES, r["data"]) for r in sent.to_pylist() if r["kind"] == COPIES]
    if not rows:
        return out
    both = [unpack_keys(r["data"]) for r in rows]
    keys, counts = np.concatenate([k for k, _ in both]), np.concatenate([c for _, c in both]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    state = np.empty(len(keys), np.uint8)
    state[order] = np.where(total > hot, 2, np.where(total > 1, 1, 0))
    at = 0
    for r, (part, _) in zip(rows, both):
        mine = state[at : at + len(part)]
        at += len(part)
        if mine.any():
            out.append((r["bucket"], r["block"], KEYS, np.packbits(np.stack([mine == 1, mine == 2]).ravel()).tobytes()))
    return out


def bwt_of(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first `depth` bytes at least, and the byte before each."""
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    size = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.uint64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new) + np.uint64(1)
        if size >= depth or rank.max() == n:
            return order, text[order - 1]
        key = (rank << np.uint64(32)) | np.append(rank[size:], np.zeros(min(size, n), np.uint64))
        size *= 2


def common_prefix_borders(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For each row, whether its first `depth` bytes differ from the row's above.

    Breadth first: at step l the borders part the rows into intervals of common prefixes of length l. Extended
    backwards by every byte, an interval's rows go to the rows that begin with that byte, in order (a stable sort of
    the transform is this map); where two neighbours come from different intervals, the common prefix is l long and
    the border is set. A border once set stays, so each step looks at the undecided rows alone.
    """
    n = len(bwt)
    back = np.argsort(bwt, kind="stable")
    border = np.zeros(n, bool)
    border[0] = True
    border[1:] = bwt[back][1:] != bwt[back][:-1]
    undecided = np.flatnonzero(~border)
    for _ in range(1, depth):
        if not len(undecided):
            break
        interval = np.cumsum(border, dtype=np.int32)
        found = interval[back[undecided]] != interval[back[undecided - 1]]
        border[undecided[found]] = True
        undecided = undecided[~found]
    return border


STRETCH = np.dtype([("doc", "<i8"), ("at", "<u4"), ("size", "u1"), ("key", "<u8"), ("same", "<u8")])


def judge_stretches(sent: pa.Table, length: int) -> list[tuple]:
    """For each stretch of each block: a bit for each window, set if a smaller doc_id has the window."""
    out, heads, owners, texts = [], [], [], []
    for r in sent.to_pylist():
        if r["kind"] != STRETCHES:
            out.append((r["bucket"], r["block"], r["kind"], r["data"]))
            continue
        n = int.from_bytes(r["data"][:8], "little")
        heads.append(np.frombuffer(r["data"], STRETCH, n, 8))
        owners.append((r["block"], n))
        texts.append(np.frombuffer(r["data"], np.uint8, offset=8 + n * STRETCH.itemsize))
    if not heads:
        return out
    head, text = np.concatenate(heads), np.concatenate(texts)
    size = head["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    #: equal stretches once, with their smallest document
    order = np.lexsort((head["doc"], head["same"]))
    new = np.ones(len(head), bool)
    new[1:] = head["same"][order][1:] != head["same"][order][:-1]
    which = np.empty(len(head), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    least = np.repeat(head["doc"][one][:, None], 32, 1)
    #: an anchor with a single stretch needs no comparison
    by_key = np.argsort(head["key"][one], kind="stable")
    k = head["key"][one][by_key]
    alone = np.ones(len(k), bool)
    alone[1:] &= k[1:] != k[:-1]
    alone[:-1] &= k[1:] != k[:-1]
    many = np.sort(by_key[~alone])
    if len(many):
        s = size[one][many]
        joint = np.cumsum(s + 1)
        at = joint - s - 1
        line = np.zeros(int(joint[-1]), np.uint8)
        src = np.repeat(begin[one][many] - at, s) + (place := np.repeat(at, s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s))
        line[place] = text[src]
        stretch = np.repeat(np.arange(len(many)), s + 1)
        window = np.arange(len(line)) - np.repeat(at, s + 1)
        order, bwt = bwt_of(line, length)
        border = common_prefix_borders(bwt, length)
        doc = head["doc"][one][many][stretch[order]]
        valid = window[order] <= s[stretch[order]] - length
        doc = np.where(valid, doc, NULL_ID)
        smallest = np.minimum.reduceat(doc, np.flatnonzero(border))[np.cumsum(border) - 1]
        rows = order[valid]
        least[many[stretch[rows]], window[rows]] = smallest[valid]
    at = 0
    for block, n in owners:
        mine = slice(at, at + n)
        at += n
        windows = size[mine] - length + 1
        hit = (least[which[mine]] < head["doc"][mine][:, None]) & (np.arange(32) < windows[:, None])
        bits = (hit.astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum(1, dtype=np.uint64).astype("<u4")
        some = bits > 0
        if some.any():
            out.append((-1, block, COVER, cover(head["at"][mine][some].astype(np.int64), bits[some])))
    return out


def cover(at: np.ndarray, bits: np.ndarray) -> bytes:
    return at.astype("<u4").tobytes() + bits.astype("<u4").tobytes()


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 6 << 20, hot: int = 200) -> DataFrame:
    """docs(doc_id, text) without bytes under a string of `length` bytes that also starts in a smaller doc_id.

    Returns doc_id, n_bytes, spans (array of start, end: maximal removed runs, in bytes) and kept (binary, what is left).
    Strings never cross documents; they are judged on the texts as given. A null text is empty; texts shorter than
    `length` stay whole; a null doc_id counts as larger than any other; rows that share a doc_id are no smaller than each
    other; extra columns are dropped; an empty table gives an empty result. Anchors in more than `hot` documents are
    spread by window.
    """
    if not K < length <= K + 31:
        raise ValueError(f"length must be in {K + 1}..{K + 31}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = blocks
    wide = length + (length - K)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    copy = dealt.where(F.octet_length("text") >= length).select("block", "doc_id", F.sha2("text", 256).alias("h"))
    first = copy.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first")  # so that the join below can split what many copies of one text make large
    copy = copy.join(first, "h").where("doc_id > first").select("block", "doc_id", "h").toDF("block", "doc_id", "h")

    def send_keys(_key, group: pa.Table, copies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        number, block = group.column("block")[0].as_py(), Block(group, length)
        gone = block.rows_of(set(zip(copies.column("doc_id").to_pylist(), copies.column("h").to_pylist())))
        key, _first, _last, doc = block.runs(gone)
        key, counts = block.distinct(key, doc)
        out = [(number % buckets, number, COPIES, gone.astype("<i8").tobytes())]
        return messages(out + [(b, number, KEYS, pack_keys(key[at], counts[at])) for b, at in by_bucket(key, buckets)])

    def send_stretches(_key, group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        number, block = group.column("block")[0].as_py(), Block(group, length)
        told = told.to_pylist()
        gone = np.array([x for r in told if r["kind"] == COPIES for x in np.frombuffer(r["data"], "<i8")], np.int64)
        key, begin, end, doc = block.runs(gone)
        known, _counts = block.distinct(key, doc)
        state = np.zeros(len(known), np.uint8)
        answer = {r["bucket"]: r["data"] for r in told if r["kind"] == KEYS}
        for b, at in by_bucket(known, buckets):
            if b in answer:
                bits = np.unpackbits(np.frombuffer(answer[b], np.uint8), count=2 * len(at)).reshape(2, -1)
                state[at] = bits[0] + 2 * bits[1]
        state = state[np.searchsorted(known, key)]
        some, hot_ones = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        per = end[hot_ones] - begin[hot_ones] + 1
        single = np.repeat(begin[hot_ones], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        at = np.concatenate([begin[some], single])
        size = np.concatenate([end[some] - begin[some] + length, np.full(len(single), length)])
        owner = np.concatenate([doc[some], np.repeat(doc[hot_ones], per)])
        same = stretch_hashes(block.text, at, size, wide)
        key = np.concatenate([key[some], same[len(some) :]])
        out = [(number % buckets, number, COPIES, np.sort(gone).astype("<i8").tobytes())]
        #: of equal stretches in the block, those of larger documents are covered whole
        order = np.lexsort((block.ids[owner], same))
        new = np.ones(len(order), bool)
        new[1:] = same[order][1:] != same[order][:-1]
        least = block.ids[owner][order][new][np.cumsum(new) - 1] if len(order) else order
        later = block.ids[owner][order] > least
        covered, kept = order[later], np.sort(order[~later])
        if len(covered):
            n = (size[covered] - length + 1).astype(np.uint64)
            out.append((number % buckets, number, COVER, cover(at[covered], (np.uint64(1) << n) - np.uint64(1))))
        for b, places in by_bucket(key[kept], buckets):
            mine = kept[places]
            head = np.zeros(len(mine), STRETCH)
            head["doc"], head["at"], head["size"], head["key"], head["same"] = block.ids[owner[mine]], at[mine], size[mine], key[mine], same[mine]
            s = size[mine]
            src = np.repeat(at[mine] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            out.append((b, number, STRETCHES, len(mine).to_bytes(8, "little") + head.tobytes() + block.text[src].tobytes()))
        return messages(out)

    def cut(_key, group: pa.Table, told: pa.Table) -> pa.Table:
        rows, told = [], told.to_pylist()
        if group.num_rows:
            block = Block(group, length)
            gone = {int(x) for r in told if r["kind"] == COPIES for x in np.frombuffer(r["data"], "<i8")}
            starts = np.zeros(len(block.text) + length, bool)
            for r in told:
                if r["kind"] == COVER:
                    at, bits = np.frombuffer(r["data"], "<u4").reshape(2, -1)
                    w, k = np.nonzero((bits[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1))
                    starts[at[w].astype(np.int64) + k] = True
            removed = starts[: len(block.text)].copy()  # a byte is removed if a marked window begins at most length - 1 before
            reach = 1
            while reach < length:
                step = min(reach, length - reach)
                removed[step:] |= removed[:-step].copy()
                reach += step
            start = 0
            for i, data in enumerate(block.data):
                mask = removed[start : start + len(data)]
                start += len(data)
                key = None if block.null[i] else int(block.ids[i])
                if i in gone:
                    rows.append((key, len(data), [{"start": 0, "end": len(data)}], b""))
                elif not mask.any():
                    rows.append((key, len(data), [], data))
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    rows.append((key, len(data), spans, np.frombuffer(data, np.uint8)[~mask].tobytes()))
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "spans", "kept"])

    by_block = lambda df: df.toDF(*df.columns).groupBy("block")
    sent = by_block(dealt).cogroup(by_block(copy)).applyInArrow(send_keys, MESSAGE)
    judged = sent.groupBy("bucket").applyInArrow(lambda t: messages(judge_keys(t, hot)), MESSAGE)
    sent = by_block(dealt).cogroup(by_block(judged)).applyInArrow(send_stretches, MESSAGE)
    judged = sent.groupBy("bucket").applyInArrow(lambda t: messages(judge_stretches(t, length)), MESSAGE)
    return by_block(dealt).cogroup(by_block(judged)).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
