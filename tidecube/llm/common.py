"""What several operators share: reading tables, cutting lineage, distributed components."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share: spark.checkpoint.dir, set here only where it
    is unset and all runs on one machine. Whoever ends the application may delete it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that the driver and all executors share")
        folder = "/tmp/checkpoints/tidecube"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tidecube-{spark.sparkContext.applicationId}"


def free_memory() -> None:
    """Gives back to the system what this process has freed: workers wait for tasks of other stages with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars; DataFrame operations only.

    edges: columns a, b of one orderable type; null ends and loops are ignored, repeated edges count once.
    Returns node, component (the smallest node of the component); nodes without an edge are not in it.
    Each round is one or two shuffles of the edges that are left; the number of rounds follows the logarithm
    of the longest path, and they end when all components are stars. Every round is written to the shared folder.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = written(links.distinct(), "links")
    while True:
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if seen.where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            break  # stars: every node has one edge up, to a node that has none
        #: what is smallest is written, so that Spark can split the joins with the many edges of one node
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        links = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
