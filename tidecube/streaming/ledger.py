"""The medallion kept up to date from a folder of files: the stream's checkpoint is the ledger of files that are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.operators import cube
from tidecube.sources.versions import VersionedTable

MONTH = ["pickup_year", "pickup_month"]


def refresh_cube(table: VersionedTable, trips: DataFrame, batch: tuple[str, int] | None = None) -> list[str]:
    """Adds trips, late ones included, to a published demand cube: only the months that they are of are read and written.
    Returns those months' parts. Trips of one batch of a stream count once, however often it is tried."""
    return table.merge(cube.demand_cube(trips), MONTH, lambda both: both.groupBy(*cube.KEYS).agg(F.sum("trip_count").alias("trip_count")), batch)


class Medallion:
    """bronze (rows as they came), silver (made by to_silver) and gold (the demand cube of silver) below a folder."""

    def __init__(self, spark: SparkSession, root: str, to_silver: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.to_silver = spark, root.rstrip("/"), to_silver
        self.bronze, self.silver, self.gold = (VersionedTable(spark, f"{self.root}/{layer}") for layer in ("bronze", "silver", "gold"))

    def take(self, rows: DataFrame, n: int) -> None:
        """One batch through all layers. Each layer's version tells whether it has the batch, so a batch that broke off between
        two layers goes on there, and nothing is lost or doubled."""
        batch, part = ("files", n), [f"batch={n}"]
        self.bronze.append(rows, batch)
        self.silver.append(self.to_silver(self.bronze.read(parts=part)), batch)
        refresh_cube(self.gold, self.silver.read(parts=part), batch)

    def update(self, folder: str, schema: str, files_a_batch: int = 1000) -> list[dict]:
        """Takes all files below a folder that no earlier update took, some at a time; returns batch and rows of each batch."""
        rows = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).parquet(folder)
        run = rows.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in run.recentProgress if p["numInputRows"]]
