"""From raw documents to packed token sequences: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents. Rows without a doc_id cannot be named in a decision about other rows: they pass the stages that drop
documents and are redacted and packed like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.llm.common import table, written
from tidecube.llm.decontaminate import find_copies
from tidecube.llm.ngram_join import link_ngrams
from tidecube.llm.packing import pack
from tidecube.llm.pii import redact_pii
from tidecube.llm.quality_rules import judge_quality


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is in dropped; columns as they are."""
    return docs.join(written(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def key_name(docs: DataFrame) -> str:
    """row_key, or that with as many _ as set it apart from the columns of docs."""
    name, taken = "row_key", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key_name(docs), a hash of doc_id and text; null without a doc_id."""
    return docs.withColumn(key_name(docs), F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows whose key is dropped.row_key: other texts of a doc_id stay."""
    key = key_name(docs)
    gone = written(dropped.where("row_key is not null").select(F.col("row_key").alias(key)).distinct(), "dropped")
    return keyed(docs).join(gone, key, "left_anti").select(*docs.columns)


def once(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id and text. Only rows whose hash is there twice are compared."""
    key = key_name(docs)
    again = written(keyed(docs).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    single, several = (keyed(docs).join(again, key, how).select(*docs.columns) for how in ("left_anti", "left_semi"))
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base limits or the learned decision list reject. Rows go through with their statistics, so that no join
    has to find them again."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    judged, _rules = judge_quality(rows, table(spark, sf_dir, "labels"), ["row"])
    return judged.where("kept or doc_id is null").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents that five-word shingles link at 0.8. All rows of a doc_id are one
    document; of rows with equal doc_id and text one stays."""
    return once(without(docs, link_ngrams(docs).where("doc_id <> component_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item, edited or not."""
    key = F.col(key_name(docs))
    rows = keyed(docs).where(key.isNotNull()).select(key.alias("doc_id"), "text")
    return without_rows(docs, find_copies(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_key")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, disguised or not, by the name of its kind; n_chars follows."""
    out = redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024."""
    return pack(docs, end_id=0, lean=True, special=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: Learned rules, alignment and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
