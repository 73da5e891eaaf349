"""How good predictions are; every table is one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecube.functions import trips as fn
from tidecube.operators.schema import rounded


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, rmse, mae and r2 (0 where the labels do not vary) of rows that have both."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    sums = df.where(y.isNotNull() & F.col(prediction).isNotNull()).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    n, sst = F.col("n"), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    return sums.select("n", rounded(F.sqrt(F.try_divide("sse", n)), 4).alias("rmse"), rounded(F.try_divide("sae", n), 4).alias("mae"), rounded(F.when(sst > 0, 1 - F.col("sse") / sst).otherwise(0.0), 4).alias("r2"))


def checked_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, float]:
    """The row of regression_metrics; an error if no row has a label and a prediction."""
    row = regression_metrics(df, label, prediction).first().asDict()
    if not row["n"]:
        raise ValueError("no rows to evaluate")
    return row


def with_errors(df: DataFrame) -> DataFrame:
    e = F.col("predicted_trip_count") - F.col("actual_trip_count")
    return df.withColumns({"prediction_error": e, "absolute_error": F.abs(e)})


def error_columns() -> list:
    e = F.col("prediction_error")
    return [F.count("*").alias("row_count"), rounded(F.avg("absolute_error"), 4).alias("mae"), rounded(F.sqrt(F.avg(e * e)), 4).alias("rmse"), rounded(F.avg(e), 4).alias("bias")]


def summary(df: DataFrame) -> DataFrame:
    return df.agg(*error_columns(), rounded(F.corr("actual_trip_count", "predicted_trip_count"), 6).alias("corr"))


def zero_actual_summary(df: DataFrame, at_least: float = 20) -> DataFrame:
    p = F.col("predicted_trip_count")
    return df.where("actual_trip_count = 0").agg(F.count("*").alias("row_count"), rounded(F.avg(p), 4).alias("avg_prediction"), F.max(p).alias("max_prediction"), rounded(F.avg((p >= at_least).cast("double")) * 100, 4).alias("pct_at_least"))


def by_bucket(df: DataFrame, bucket=fn.demand_bucket, order=fn.demand_bucket_order) -> DataFrame:
    """Errors by bucket of the actual trips; bucket and order make its name and place of them."""
    a = F.col("actual_trip_count")
    return df.groupBy(bucket(a).alias("bucket"), order(a).alias("bucket_order")).agg(*error_columns())


def by_keys(df: DataFrame, *keys: str, at_least: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(*error_columns()).where(F.col("row_count") >= at_least)


def location_ranking(by_location: DataFrame, zones: DataFrame) -> DataFrame:
    """A rank over all zones by error: the one window without partitions, over a row for each zone."""
    rows = by_location.join(zones.withColumnRenamed("location_id", "PULocationID"), "PULocationID", "left")
    return rows.withColumn("accuracy_rank", F.row_number().over(Window.orderBy("mae", "rmse", F.col("zone").asc_nulls_last(), "PULocationID")))


def best(metrics: DataFrame, *keys: str) -> DataFrame:
    """The row with the least rmse, overall or for each key; ties by config."""
    if not keys:
        return metrics.orderBy("rmse", "config").limit(1)
    return metrics.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("rmse", "config"))).where("k = 1").drop("k")
