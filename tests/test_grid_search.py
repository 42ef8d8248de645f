"""The staged grid search against a plain cross-validation of whole pipelines."""

import random
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from gridlight.operators import ml
from gridlight.operators.splits import group_bucket


def test_same_scores_as_plain_cross_validation(spark):
    rng = random.Random(6)
    rows = [(i // 6, x := rng.uniform(0, 10), z := rng.uniform(-5, 5), x * x + 3 * z + rng.gauss(0, 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "account_id long, x double, z double, y double").coalesce(1)
    models = {k: m for k, m in ml.regressors("y", trees=5).items() if k in ("Ridge", "GradientBoosting")}
    ridge, boost = models["Ridge"], models["GradientBoosting"]
    spaces = {"Ridge": ParamGridBuilder().addGrid(ridge.regParam, [0.1, 10.0]).build(),
              "GradientBoosting": ParamGridBuilder().addGrid(boost.maxIter, [2, 4]).addGrid(boost.maxDepth, [2, 3]).build()}
    assert [(len(rounds), {p.name: v for p, v in s.items()}) for s, rounds in ml.staged(spaces["GradientBoosting"])] == [(2, {"maxIter": 4, "maxDepth": 2}), (2, {"maxIter": 4, "maxDepth": 3})]
    assert len(ml.staged(spaces["Ridge"])) == 2
    found = ml.grid_search(df, ["x", "z"], "y", models, folds=2, spaces=spaces)
    data = df.withColumn("_fold", group_bucket("account_id", 2, seed=7).cast("int"))
    for name, grid in spaces.items():
        cv = CrossValidator(estimator=Pipeline(stages=[*ml.scaling_stages(["x", "z"]), models[name]]), estimatorParamMaps=grid,
                            evaluator=RegressionEvaluator(labelCol="y", metricName="mae"), numFolds=2, foldCol="_fold").fit(data)
        best = grid[min(range(len(grid)), key=cv.avgMetrics.__getitem__)]
        model, error = found[name]
        assert error == pytest.approx(min(cv.avgMetrics), rel=1e-6)
        assert all(model.stages[-1].getOrDefault(p) == v for p, v in best.items())


def test_forests_keep_node_ids_and_their_scores(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i // 6, x := rng.uniform(0, 10), z := rng.uniform(-5, 5), x * x + 3 * z + rng.gauss(0, 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "account_id long, x double, z double, y double").coalesce(1)
    models = {"RandomForest": ml.regressors("y", trees=5)["RandomForest"]}
    forest = models["RandomForest"]
    grid = ParamGridBuilder().addGrid(forest.numTrees, [3, 5]).addGrid(forest.maxDepth, [2, 12]).build()
    data = df.withColumn("_fold", group_bucket("account_id", 2, seed=7).cast("int"))
    cv = CrossValidator(estimator=Pipeline(stages=[*ml.scaling_stages(["x", "z"]), forest]), estimatorParamMaps=grid,
                        evaluator=RegressionEvaluator(labelCol="y", metricName="mae"), numFolds=2, foldCol="_fold").fit(data)
    fits, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, rows: fits.append(self.getCacheNodeIds()) or fit(self, rows))
    model, error = ml.grid_search(df, ["x", "z"], "y", models, folds=2, spaces={"RandomForest": grid})["RandomForest"]
    assert fits == [True] * (len(grid) * 2 + 1)
    assert error == pytest.approx(min(cv.avgMetrics), rel=1e-9)
    assert model.stages[-1].toDebugString.split("\n", 1)[1] == cv.bestModel.stages[-1].toDebugString.split("\n", 1)[1]
    assert not forest.getCacheNodeIds()


def test_best_settings_are_fitted_side_by_side(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2) for i in range(60)], "account_id long, x double, y double").coalesce(1)
    models = {k: m for k, m in ml.regressors("y").items() if k in ("Ridge", "Lasso")}
    spaces = {k: ParamGridBuilder().addGrid(m.regParam, [0.1, 1.0]).build() for k, m in models.items()}
    met, fit = threading.Barrier(2, timeout=60), Pipeline._fit

    def together(self, rows):
        if len(self.getStages()) == 3:    # scaling alone has two
            met.wait()
        return fit(self, rows)

    monkeypatch.setattr(Pipeline, "_fit", together)
    assert set(ml.grid_search(df, ["x"], "y", models, folds=2, spaces=spaces)) == {"Ridge", "Lasso"}
