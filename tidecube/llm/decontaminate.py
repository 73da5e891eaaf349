"""Benchmark decontamination: rare n-grams of test items are joined with training texts, local alignment scores the pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecube.llm.collocations import bitmap
from tidecube.llm.common import free_memory, written

CODE_BASE = 0x5851F42D4C957F2D
CODE_BACK = pow(CODE_BASE, -1, 1 << 64)
MATCH, MISS, GAP = 2, -1, -1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """Numbers of bytes; what is neither an ASCII letter or digit nor beyond ASCII parts words."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64))
    apart = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
    return codes, apart


CODES, APART = byte_codes()
POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    out = POWERS.get(base)
    if out is None or len(out) < n:
        out, have = np.ones(max(n, 1 << 16), np.uint64), 1
        while have < len(out):
            out[have : 2 * have] = out[: min(have, len(out) - have)] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        POWERS[base] = out
    return out[:n]


def folded(text: str) -> bytes:
    """UTF-8 in lower case, every character as many bytes as before."""
    data, low = text.encode("utf-8", "surrogatepass"), text.lower().encode("utf-8", "surrogatepass")
    if len(low) != len(data):
        size = lambda c: len(c.encode("utf-8", "surrogatepass"))
        low = "".join(x if size(x := c.lower()) == size(c) else c for c in text).encode("utf-8", "surrogatepass")
    return low


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of the words."""
    b = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], APART[b], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(CODES[b] * powers(CODE_BASE, len(b)), out=run[1:])
    return mixed((run[ends] - run[starts]) * powers(CODE_BACK, len(b) + 1)[starts] + (ends - starts).astype(np.uint64)), starts, ends


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mixed(out)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best score, and the first and end word of the text in that alignment.

    A row at a time; a gap in the text is a running maximum along the row. The begin of an alignment is carried along.
    """
    n = len(text)
    slope = -GAP * np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(text == w, MATCH, MISS)
        up = score[1:] + GAP
        cell = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        origin = np.concatenate([[0], np.where(cell[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, begin[:-1], begin[1:]))])
        lifted = cell + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - slope
        begin = np.where(score > 0, origin[source], np.arange(n + 1))
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


def stretches(cells: list[int], pad: int, size: int, n_words: int) -> list[tuple[int, int]]:
    """Parts of a text in which an item of `size` words may lie whose begin is in one of the cells, `pad` words each; those that
    touch are one."""
    out: list[tuple[int, int]] = []
    for c in sorted(cells):
        a, b = max(0, (c - 1) * pad), min(n_words, (c + 2) * pad + size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def best_alignment(item: np.ndarray, words: np.ndarray, cells: list[int], pad: int, least: float) -> tuple[int, int, int]:
    """The item's best alignment in those parts of the text; (0, 0, 0) where none can reach `least` of the full score."""
    best, full = (0, 0, 0), MATCH * len(item)
    for a, b in stretches(cells, pad, len(item), len(words)):
        # no alignment scores more than a match of every word of the item that the stretch has
        if MATCH * np.isin(item, words[a:b]).sum() >= least * full:
            score, x, y = align(item, words[a:b])
            if score > best[0]:
                best = (score, a + x, a + y)
    return best


def lists_of(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *[p.view(np.int64) if p.dtype == np.uint64 else p for p in parts]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def with_grams(items: DataFrame, n: int) -> DataFrame:
    """item (its key), words and grams, hashes both, of items(item, text)."""

    def split(batches):
        for b in batches:
            words = [words_of(folded(t))[0] for t in b.column("text").to_pylist()]
            grams = [grams_of(w, n) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("item"), lists_of(words, pa.int64()), lists_of(grams, pa.int64())], ["item", "words", "grams"])

    return items.select("item", "text").mapInArrow(split, "item long, words array<long>, grams array<long>")


def gram_counts(docs: DataFrame, known, n: int) -> DataFrame:
    """gram, df: in how many rows of docs(text) it is, for the n-grams of the bitmap."""

    def scan(batches):
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for t in b.column("text"):
                grams = grams_of(words_of(folded(t.as_py()))[0], n)
                found.append(np.unique(grams[known.value.has(grams)]))
            grams, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "n"])
        free_memory()

    return docs.select("text").mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))


#: Texts that are looked through at one time.
TEXTS = 200


def with_hits(docs: DataFrame, known, n: int) -> DataFrame:
    """Rows whose text has an n-gram of the bitmap, with grams and places, an entry for each time."""

    def scan(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                rows, grams, places = [], [], []
                for i, t in enumerate(b.column("text")):
                    of = grams_of(words_of(folded(t.as_py()))[0], n)
                    where = np.flatnonzero(known.value.has(of))
                    if len(where):
                        rows.append(i)
                        grams.append(of[where])
                        places.append(where)
                if rows:
                    kept = b.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, lists_of(grams, pa.int64()), lists_of(places, pa.int32())], [*kept.schema.names, "grams", "places"])
        free_memory()

    return docs.mapInArrow(scan, "doc_id long, text string, k1 long, k2 long, grams array<long>, places array<int>")


def rare_seeds(items: DataFrame, frequency: DataFrame, stretch: int) -> DataFrame:
    """item, gram, place, size: for every `stretch` places in a row of an item the n-gram that the fewest texts have, by frequency(gram,
    df), of those that any text has. So every part of an item has a seed, however many texts share other parts of it."""
    grams = items.select("item", F.size("words").alias("size"), F.posexplode("grams").alias("place", "gram")).join(frequency, "gram", "left")
    following = Window.partitionBy("item").orderBy("place").rowsBetween(0, stretch - 1)
    rarest = F.min(F.when(F.col("df").isNotNull(), F.struct("df", "place", "gram"))).over(following)
    return grams.select("item", "size", rarest.alias("s")).where("s is not null").select("item", "size", "s.gram", "s.place").distinct()


def find_copies(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, max_bytes: int = 16 << 20, stretch: int = 3, salts: int = 16, log2_bits: int = 26) -> DataFrame:
    """Copies of benchmark(item_id, text) in docs(doc_id, text): doc_id, item_id, score, start, end.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. Seeds are the rarest n-gram of every
    `stretch` places of an item; texts and items that share a seed are joined, seeds that many texts have in `salts` parts.
    Around every seed in a text the item is aligned (match 2, other word -1, gap -1), unless the words there cannot reach the
    score; where the best score is at least `least` of the item's full score, the pair is returned once, with that share as
    score and its bytes in the text. A copy of which no seed is left is not found.

    Texts are read twice: n-grams of items are counted, then texts that have a seed are kept for the join. Only bitmaps of
    2 ** log2_bits bits (8 MB), of the items' n-grams and of the seeds, pass the driver; items and counts stay distributed. Fewer
    bits, or far more items, keep more texts for the join and change no result. The items of one text are aligned in groups of about max_bytes of item text. Null
    and empty texts and items of under n words have no copies; of rows that share an id each is judged; a null doc_id or item_id
    is kept; extra columns are dropped; empty tables give an empty result.
    """
    spark = docs.sparkSession
    item_id, text = F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = written(benchmark.select(item_id.alias("item_id"), text.alias("text")).withColumn("item", F.xxhash64("item_id", "text")), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = written(with_grams(rows.dropDuplicates(["item"]), n).where(F.size("grams") > 0), "items")
    keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumns(keys)
    shared = lambda grams: spark.sparkContext.broadcast(bitmap(grams.select(F.shiftrightunsigned("gram", 64 - log2_bits).alias("bucket")), log2_bits))
    known = shared(items.select(F.explode("grams").alias("gram")))
    seeds = written(rare_seeds(items, gram_counts(texts, known, n), stretch), "seeds")
    known.destroy()
    known = shared(seeds)
    texts = written(with_hits(texts, known, n), "hits")
    known.destroy()
    hits = texts.select("k1", "k2", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("k1", "k2", F.col("h.grams").alias("gram"), F.col("h.places").alias("at"))
    #: a text's pairs with items: where the item would begin, in cells of a third of its size
    split = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pad = F.floor(F.col("size") / 3) + 3
    met = hits.withColumn("salt", F.pmod("k1", F.lit(salts)).cast("int")).join(split, ["gram", "salt"])
    cell = F.floor((F.col("at") - F.col("place")) / pad)
    pairs = met.select("k1", "k2", "item", pad.alias("pad"), cell.alias("cell")).groupBy("k1", "k2", "item", "pad").agg(F.collect_set("cell").alias("cells"))
    parts = max(-(-total // max_bytes), 1)
    whole = pairs.join(items.select("item", "words"), "item").groupBy("k1", "k2", F.pmod("item", F.lit(parts)).alias("part"))
    whole = written(whole.agg(F.collect_list(F.struct("item", "pad", "cells", "words")).alias("items")), "pairs")

    def score(batches):
        for b in batches:
            found = []
            for doc, t, some in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("items")):
                words, starts, ends = words_of(folded(t.as_py()))
                for x in some.as_py():
                    item = np.array(x["words"], np.int64).view(np.uint64)
                    best, at, to = best_alignment(item, words, x["cells"], x["pad"], least)
                    if best and best >= least * MATCH * len(item):
                        found.append((doc, x["item"], best / (MATCH * len(item)), int(starts[at]), int(ends[to - 1])))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["doc_id", "item", "score", "start", "end"])
        free_memory()

    aligned = texts.select("doc_id", "text", "k1", "k2").join(whole.hint("merge"), ["k1", "k2"]).select("doc_id", "text", "items").mapInArrow(score, "doc_id long, item long, score double, start long, end long")
    return aligned.join(rows.select("item", "item_id"), "item").select("doc_id", "item_id", "score", "start", "end")
