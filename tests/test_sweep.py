"""A sweep whose fits run beside each other: overlap, the same models as one by one, and one best where errors tie."""

import random
import threading

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression

from tidecube.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    made = [(rng.choice("abc"), *(float(rng.randint(0, 9)) for _ in models.NUMBERS)) for _ in range(800)]
    schema = "zone string, " + ", ".join(f"{c} double" for c in models.NUMBERS)
    return spark.createDataFrame(made, schema).coalesce(1)


class Meets(LinearRegression):
    """Fits only while another one does."""

    def __init__(self, barrier):
        super().__init__(maxIter=2)
        self.barrier = barrier

    def _fit(self, dataset):
        self.barrier.wait(60)
        return super()._fit(dataset)


def test_fits_overlap(rows, tmp_path, monkeypatch):
    meet, df = threading.Barrier(2), rows.selectExpr("*", "pickup_hour + location_avg as label")
    monkeypatch.setattr(models, "configurations", lambda: {"linear_a": Meets(meet), "linear_b": Meets(meet)})
    found = {r.config: r for r in models.select_and_save(df, df, str(tmp_path)).collect()}
    assert found.keys() == {"naive", "linear_a", "linear_b"} and found["linear_a"].n == 800


def test_fits_beside_each_other_are_those_of_one_by_one(rows, tmp_path):
    df = rows.selectExpr("*", "pickup_hour * location_avg + location_hour_avg as label")
    names = ["linear_elastic", "forest_20_5", "boosted_10_2"]
    one, four = (sorted(map(tuple, models.select_and_save(df, df, f"{tmp_path}/{k}", names, at_once=k).collect()), key=repr) for k in (1, 4))
    assert one == four and len(one) == 4


def test_the_saved_best_is_the_best_row_where_errors_tie(rows, tmp_path):
    df, at = rows.selectExpr("*", "double(0) as label"), str(tmp_path)
    found = models.select_and_save(df, df, at, ["linear_plain", "boosted_10_2"]).collect()
    assert {r.config: r.rmse for r in found if r.artifact} == {"linear_plain": 0.0, "boosted_10_2": 0.0}
    assert [r.config for r in found if r.best] == ["boosted_10_2"]
    assert type(PipelineModel.load(f"{at}/best_pipeline").stages[-1]).__name__ == "GBTRegressionModel"
