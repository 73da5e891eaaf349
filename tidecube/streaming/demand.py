"""The demand cube of a stream of standardised trips: hour windows with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(trips: DataFrame, late: str = "2 hours") -> DataFrame:
    """Trips by source, zone and hour window of a batch or a stream; a stream emits an hour once the watermark has passed it."""
    hours = F.window("pickup_datetime", "1 hour")
    counts = trips.withWatermark("pickup_datetime", late).groupBy(hours, "source_id", "PULocationID").agg(F.count("*").alias("trip_count"))
    return counts.select(F.col("window.start").alias("pickup_hour_ts"), "source_id", "PULocationID", "trip_count")


def keep_table(trips: DataFrame, path: str, checkpoint: str, late: str = "2 hours"):
    """Appends finished hours to Parquet, each once; returns the running query."""
    return hourly_stream(trips, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
