"""Regressors of demand with Spark's own ML library."""

from __future__ import annotations

from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.operators import metrics

NUMBERS = ["pickup_hour", "pickup_day_of_week", "pickup_month", "location_avg", "location_hour_avg", "location_dow_hour_avg", "previous_month_location_hour_avg", "location_hour_zero_rate"]


def encoder(category: str = "zone", numbers: list[str] = NUMBERS) -> list:
    """Index, one-hot and vector stages; unseen zones are kept, rows with nulls skipped."""
    return [
        StringIndexer(inputCol=category, outputCol=f"{category}_index", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{category}_index"], outputCols=[f"{category}_vector"], handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, f"{category}_vector"], outputCol="features", handleInvalid="skip"),
    ]


def configurations() -> dict[str, object]:
    """Name and estimator of each configuration of a sweep."""
    out: dict[str, object] = {f"linear_{n}": LinearRegression(maxIter=30, regParam=r, elasticNetParam=e) for n, r, e in (("plain", 0.0, 0.0), ("ridge", 0.01, 0.0), ("elastic", 0.01, 0.5))}
    out |= {f"forest_{t}_{d}": RandomForestRegressor(numTrees=t, maxDepth=d, minInstancesPerNode=m, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=42) for t, d, m in ((20, 5, 5), (30, 6, 8), (40, 8, 10))}
    return out | {f"boosted_{i}_{d}": GBTRegressor(maxIter=i, maxDepth=d, minInstancesPerNode=m, subsamplingRate=0.7, seed=42) for i, d, m in ((10, 2, 20), (15, 3, 25), (20, 4, 30))}


def fit(train: DataFrame, estimator, category: str = "zone") -> PipelineModel:
    return Pipeline(stages=[*encoder(category), estimator]).fit(train)


def naive(test: DataFrame) -> DataFrame:
    """The mean of the weekday and hour as prediction."""
    return test.withColumn("prediction", F.col("location_dow_hour_avg"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. Fits are bound by computing, and the few partitions that suit its bytes would leave cores idle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def kept(*frames: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """The frames kept by executors while they are read again and again, and given up after, whatever happens."""
    try:
        yield tuple(df.persist(level) for df in frames)
    finally:
        for df in frames:
            df.unpersist()


def select_and_save(train: DataFrame, test: DataFrame, folder: str, names: list[str] | None = None, at_once: int = 4) -> DataFrame:
    """Fits every configuration on train and measures it on test: config, model, selection (baseline or trainable), n, rmse,
    mae, r2, artifact, best_of_model and best (by rmse, of what is trainable).

    Each pipeline is saved below folder/models, the best once more as folder/best_pipeline, and the rows as folder/metrics
    (CSV). Features are fitted once. at_once fits run beside each other, as a tree's levels and a boosted model's trees are short
    jobs that wait for one another; the longest begin first. An error if test has no rows.
    """
    spark = train.sparkSession
    with kept(spread(train), spread(test)) as (fit_on, measure_on):
        features = Pipeline(stages=encoder()).fit(fit_on)
        with kept(features.transform(fit_on), features.transform(measure_on)) as (x, y):
            rows = [{"config": "naive", "model": "naive", "selection": "baseline", "artifact": None, **metrics.checked_metrics(naive(y))}]

            def fitted(name: str, estimator) -> tuple[dict, PipelineModel]:
                model = estimator.fit(x)
                whole, at = PipelineModel([*features.stages, model]), f"models/{name}"
                whole.write().overwrite().save(f"{folder}/{at}")
                return {"config": name, "model": name.split("_")[0], "selection": "trainable", "artifact": at, **metrics.checked_metrics(model.transform(y))}, whole

            chosen = [(name, estimator) for name, estimator in configurations().items() if names is None or name in names]
            with ThreadPool(at_once) as pool:
                done = pool.starmap(inheritable_thread_target(spark)(fitted), chosen[::-1], chunksize=1)[::-1]
    if not done:
        raise ValueError("no configuration was fitted")
    rows += [row for row, _ in done]
    best = min(done, key=lambda d: (d[0]["rmse"], d[0]["config"]))
    best[1].write().overwrite().save(f"{folder}/best_pipeline")
    found = spark.createDataFrame([[r[c] for c in SELECTED] for r in rows], "config string, model string, selection string, n long, rmse double, mae double, r2 double, artifact string")
    trained = found.where("selection = 'trainable'")
    of_model = trained.groupBy("model").agg(F.min_by("config", F.struct("rmse", "config")).alias("of_model"))
    top = trained.agg(F.min_by("config", F.struct("rmse", "config")).alias("top"))
    out = found.join(of_model, "model", "left").crossJoin(F.broadcast(top))
    out = out.select(*SELECTED, F.coalesce(F.col("config") == F.col("of_model"), F.lit(False)).alias("best_of_model"), (F.col("config") == F.col("top")).alias("best"))
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/metrics")
    return out


SELECTED = ["config", "model", "selection", "n", "rmse", "mae", "r2", "artifact"]


def holdout(df: DataFrame, train_years: list[int], test_year: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("pickup_year").isin(train_years)), df.where(F.col("pickup_year") == test_year)


def evaluated(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, float]:
    """rmse, mae and r2 by Spark's evaluator, one pass each; metrics.regression_metrics has them in one."""
    from pyspark.ml.evaluation import RegressionEvaluator

    return {m: RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=m).evaluate(predictions) for m in ("rmse", "mae", "r2")}


def plain_forest(train: DataFrame, numbers: list[str]) -> PipelineModel:
    """A forest on plain numbers, without encoded zones."""
    parts = [VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip"), RandomForestRegressor(numTrees=30, maxDepth=8, seed=42)]
    return Pipeline(stages=parts).fit(train)


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model as written to path and loaded again."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def scored_holdout(model: PipelineModel, test: DataFrame) -> DataFrame:
    """test with actual_trip_count, predicted_trip_count, prediction_error and absolute_error."""
    rows = model.transform(test).withColumns({"actual_trip_count": F.col("label"), "predicted_trip_count": F.col("prediction")})
    return metrics.with_errors(rows).drop("features", "zone_index", "zone_vector", "prediction")
