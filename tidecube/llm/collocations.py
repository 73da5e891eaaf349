"""Phrase collocations: phrases of a few words that stand together far more often than their parts do apart.

Phrases are mined length by length, one scan of the texts each. A scan counts the candidates of its length exactly and, at
the same time, counts the phrases that are one word longer in hashed buckets. Between scans two bitmaps of a fixed size are
made: buckets that reach the least count, and phrases that reached it. A longer phrase is a candidate only if both phrases
that it consists of are frequent (Apriori) and its bucket is (PCY, DHP). Bitmaps have no false negatives and what they let
through is counted by its words, so the counts are exact whatever the hashes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecube.llm.common import free_memory, written

#: Ends of pieces, and what A-Z, these and tabs become before a text is split at spaces. No word holds a "." by then.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes.maketrans(UPPER + ENDS + b"\t", LOWER + b"." * len(ENDS) + b" ")
END = 0  # the number of "."
#: Bytes of text that are words at one time, and words that are counted together: what bounds a task's memory.
TEXT_BYTES, WORDS = 1 << 20, 500_000
#: A segment of a bitmap is 8 KB.
SEGMENT = 16
#: Rows that a task hands on at one time.
ROWS = 50_000
COUNTS = "lang string, phrase string, bucket long, n long"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32))


class Numbers(dict):
    """Words numbered as they come; "." is 0."""

    def __init__(self):
        super().__init__({b".": END})
        self.words, self.hashes = [b"."], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def stretches(texts: Iterator[bytes], most: int = TEXT_BYTES) -> Iterator[bytes]:
    """The texts put together to stretches of about `most` bytes; longer texts are cut at the next end of a piece."""
    held, size = [], 0
    for text in texts:
        text = text.translate(PLAIN)
        at = 0
        while len(text) - at > most:
            cut = text.find(b".", at + most)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        held.append(text[at:] if at else text)
        size += len(held[-1])
        if size >= most:
            yield b".".join(held)
            held, size = [], 0
    if held:
        yield b".".join(held)


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase h with one more word."""
    h = (h ^ word) * MIX[0]
    h ^= h >> MIX[2]
    h *= MIX[1]
    return h ^ (h >> MIX[2])


def phrase_hashes(lang: str, words: np.ndarray, k: int) -> np.ndarray:
    """Of each k words in a row of `words`, hashes themselves."""
    n = max(len(words) - k + 1, 0)
    h = np.full(n, xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for j in range(k):
        h = mixed(h, words[j : j + n])
    return h


class Bitmap:
    """A set of hashes, told by their first `log2` bits: a superset, never less."""

    def __init__(self, log2: int, segments: dict[int, bytes]):
        self.log2 = log2
        self.bits = np.zeros(max(1 << log2 >> 3, 1), np.uint8)
        for s, part in segments.items():
            part = np.frombuffer(part, np.uint8)
            self.bits[s * len(part) : (s + 1) * len(part)] = part

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log2)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bitmap(buckets: DataFrame, log2: int) -> Bitmap:
    """Of column bucket. At most 2 ** log2 bits ever reach the driver, whatever the data."""

    def fill(batches):
        for b in batches:
            parts = []
            for low in b.column("low"):
                bits = np.zeros(1 << SEGMENT, np.uint8)
                bits[low.values.to_numpy()] = 1
                parts.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("segment"), pa.array(parts, pa.binary())], ["segment", "bits"])

    of = buckets.select(F.shiftright("bucket", SEGMENT).alias("segment"), F.col("bucket").bitwiseAND((1 << SEGMENT) - 1).alias("low"))
    rows = of.groupBy("segment").agg(F.collect_set("low").alias("low")).mapInArrow(fill, "segment long, bits binary").collect()
    return Bitmap(log2, {r["segment"]: r["bits"] for r in rows})


def counted(lang: str, ids: np.ndarray, numbers: Numbers, k: int, log2: int, last: bool, frequent, buckets) -> Iterator[pa.RecordBatch]:
    """Counts of the candidates of k words in `ids` and, unless it is the last length, of the buckets of k + 1 words."""
    words = np.array(numbers.hashes, np.uint64)[ids]
    word = ids != END
    n = max(len(ids) - k + 1, 0)
    is_in = word[:n].copy()
    for j in range(1, k):
        is_in &= word[j : j + n]
    if k > 1:
        known = frequent.value.has(phrase_hashes(lang, words, k - 1))
        is_in &= known[:n] & known[1 : n + 1]
        at = np.flatnonzero(is_in)
        is_in[at] = buckets.value.has(phrase_hashes(lang, words, k)[at])
    at = np.flatnonzero(is_in)
    if len(at):
        #: numbers for phrases within these words, word by word: equal numbers are equal words, not equal hashes
        code = ids[at].astype(np.int64)
        for j in range(1, k):
            code = np.unique(code, return_inverse=True)[1] if j > 1 else code
            code = code * len(numbers) + ids[at + j]
        _, first, n_of = np.unique(code, return_index=True, return_counts=True)
        rows = np.stack([ids[at[first] + j] for j in range(k)], axis=1).tolist()
        texts = [b" ".join([numbers.words[i] for i in r]) for r in rows]
        phrases = pa.array(texts, pa.binary()).cast(pa.string())
        nulls = pa.nulls(len(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), phrases, nulls, pa.array(n_of.astype(np.int64))], ["lang", "phrase", "bucket", "n"])
    if not last and n > 1:
        longer = np.flatnonzero(is_in[:-1] & is_in[1:])
        found, n_of = np.unique(phrase_hashes(lang, words, k + 1)[longer] >> np.uint64(64 - log2), return_counts=True)
        if len(found):
            none = pa.nulls(len(found), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(found.astype(np.int64)), pa.array(n_of.astype(np.int64))], ["lang", "phrase", "bucket", "n"])


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def count_phrases(texts: DataFrame, k: int, log2: int, last: bool, frequent=None, buckets=None) -> DataFrame:
    """lang, phrase, bucket, n: exact counts of candidates (bucket null) and of buckets of longer ones (phrase null)."""

    def scan(batches):
        for b in batches:
            langs = b.column("lang")
            for lang in langs.unique().to_pylist():
                rows = b.column("text").filter(pc.equal(langs, lang))
                numbers, ids, n = Numbers(), [np.zeros(1, np.int32)], 0
                for part in stretches(x.as_py() for x in rows):
                    tokens = part.replace(b".", b" . ").split()
                    ids += [np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)), np.zeros(1, np.int32)]
                    n += len(tokens)
                    if n >= WORDS:
                        yield from in_parts(counted(lang, np.concatenate(ids), numbers, k, log2, last, frequent, buckets))
                        numbers, ids, n = Numbers(), [np.zeros(1, np.int32)], 0
                yield from in_parts(counted(lang, np.concatenate(ids), numbers, k, log2, last, frequent, buckets))
            free_memory()

    return texts.mapInArrow(scan, COUNTS).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))


def phrase_buckets(phrases: DataFrame, k: int, log2: int) -> DataFrame:
    """bucket of each phrase of k words, by the hash that the scans use."""

    def hashed(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            if b.num_rows:
                split = [p.encode().split(b" ") for p in b.column("phrase").to_pylist()]
                out = np.array([xxhash.xxh64_intdigest(x.encode()) for x in b.column("lang").to_pylist()], np.uint64)
                for j in range(k):
                    out = mixed(out, np.array([xxhash.xxh64_intdigest(s[j]) for s in split], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - log2)).astype(np.int64))], ["bucket"])

    return phrases.select("lang", "phrase").mapInArrow(hashed, "bucket long")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, log2_buckets: int = 26) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, k, n of all phrases of 1 to `longest` words that occur `least` times in the texts of
    their lang, and lang, n, all words of each lang.

    docs(text, lang): A-Z are lower-cased, texts are cut into pieces at ENDS and those into words at spaces and tabs; phrases
    lie within a piece and overlapping ones all count. A null text is empty, a null lang is "und"; repeated rows count each;
    other columns are left alone; empty tables and texts without words give no phrases. Texts of any length: they are cut
    at ends of pieces, and only a piece is held whole. Bitmaps take 2 ** log2_buckets / 8 bytes each (8 MB); they are all that
    passes the driver.
    """
    if not SEGMENT <= log2_buckets <= 30:
        raise ValueError(f"log2_buckets is {SEGMENT} to 30")
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    found, totals, frequent, buckets = [], None, None, None
    for k in range(1, longest + 1):
        counts = written(count_phrases(texts, k, log2_buckets, k == longest, frequent, buckets), f"phrases-{k}")
        exact = counts.where("phrase is not null")
        if k == 1:
            totals = exact.groupBy("lang").agg(F.sum("n").alias("n"))
        kept = exact.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n")
        found.append(kept)
        if k == longest:
            break
        full = counts.where((F.col("n") >= least) & F.col("bucket").isNotNull())
        for old in (frequent, buckets):
            if old is not None:
                old.unpersist()
        frequent = spark.sparkContext.broadcast(bitmap(phrase_buckets(kept, k, log2_buckets), log2_buckets))
        buckets = spark.sparkContext.broadcast(bitmap(full.select("bucket"), log2_buckets))
    phrases = found[0]
    for part in found[1:]:
        phrases = phrases.unionByName(part)
    return phrases, totals


def scored_phrases(phrases: DataFrame, totals: DataFrame, scale: int = 2_000_000, inside: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the frequent phrases of two words and more that no longer one explains.

    A cut after k words gives l and r, the counts of both parts, and floor(scale * a / (l + r)); the lowest cut counts, of
    equal ones the first. A phrase goes if it lies in a longer frequent one with 100 * count >= inside * a.
    Whole numbers throughout, of up to 38 digits.
    """
    whole = "decimal(20,0)"
    many = phrases.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cuts = many.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    count = lambda part, name: phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    cuts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast({scale} as {whole}) * cast(a as decimal(18,0))) div (cast(l as {whole}) + cast(r as {whole}))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    words = F.split("phrase", " ")
    parts = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = many.where("k > 2").withColumn("w", words).select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("most"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    explained = F.expr(f"coalesce(100 * cast(most as {whole}) >= {inside} * cast(a as {whole}), false)")
    out = best.join(longer, ["lang", "phrase"], "left").where(~explained)
    return out.join(totals, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", F.col("b.score").cast("long").alias("score"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, log2_buckets: int = 26) -> DataFrame:
    """The `top` phrases of each lang: lang, rank (from 1), phrase, a, l, r, n, score, by score and a, both falling, then by
    the phrase's bytes. What frequent_phrases and scored_phrases say about odd rows holds."""
    scored = written(scored_phrases(*frequent_phrases(docs, least, longest, log2_buckets)), "scored")
    #: a lang has few bands of scores, narrow where scores are low; those below the band of its last rank take no part
    band = F.floor(F.log(F.col("score") + 1) * 64)
    bands = scored.groupBy("lang", band.alias("band")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("band")))
    lowest = bands.withColumn("above", above - F.col("n")).where(F.col("above") < top).groupBy("lang").agg(F.min("band").alias("lowest"))
    near = written(scored.join(lowest, "lang").where(band >= F.col("lowest")), "near")  # before its langs meet
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
