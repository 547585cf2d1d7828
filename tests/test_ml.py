"""ML helpers: gated registry, metrics, ridge parity with the closed form, stage writes."""

import math
import os
import tempfile

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from acreage.ml import train
from acreage.ml.evaluate import MapeEvaluator, metrics
from acreage.sources import io


def _data(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1.5 * x1 - 0.7 * x2 + 3 + rng.normal(scale=0.1, size=n)
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, label double")


def test_gated_registry(spark):
    df = _data(spark)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), LinearRegression()])
    m = pipe.fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="acreage-model-"), "best")
    assert train.save_if_better(m, 0.2, path) is True
    assert train.save_if_better(m, 0.2, path) is False        # equal is not strictly lower
    assert train.save_if_better(m, 0.1, path) is True
    loaded, mape = train.load(path)
    assert mape == 0.1 and loaded.transform(df).count() == df.count()


def test_ridge_matches_closed_form(spark):
    df = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(_data(spark))
    alpha = 5.0
    model = train.ridge(df, alpha, "features", "label")
    pdf = df.select("x1", "x2", "label").toPandas()
    X = pdf[["x1", "x2"]].to_numpy()
    y = pdf.label.to_numpy()
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(2), Xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-6)


def test_metrics_and_mape_evaluator(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0)], "label double, prediction double")
    m = metrics(df, "label", "prediction").first()
    assert math.isclose(m["mae"], 15.0) and math.isclose(m["mape"], 0.1)
    assert math.isclose(MapeEvaluator().evaluate(df), 0.1)


def test_stage_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="acreage-stage-")
    df = spark.createDataFrame([("flat", 1.0), ("house", 2.0)], "property_type string, v double")
    back = io.stage(df, root, "clean", partition_by=["property_type"])
    assert sorted((r["property_type"], r["v"]) for r in back.collect()) == [("flat", 1.0), ("house", 2.0)]
    assert back.where(F.col("property_type") == "flat").count() == 1


def test_unseen_level_is_all_zeros_and_pipeline_saves(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from acreage.ml import encode
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 6.0, 5.0)], "s string, x double, k double")
    pipe, names = encode.onehot_scale_fit(df, ["x", "k"], ["s"])
    assert names == ["x", "k", "s_b", "s_c"]
    pipe.write().overwrite().save(str(tmp_path / "p"))
    new = spark.createDataFrame([("a", 3.0, 5.0), ("b", 3.0, 5.0), ("zz", 3.0, 5.0), (None, 3.0, 5.0)], "s string, x double, k double")
    for p in (pipe, PipelineModel.load(str(tmp_path / "p"))):
        got = [r.features.toArray().tolist() for r in p.transform(new).collect()]
        assert got == [[0, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    sd = np.array([1.0, 2.0, 6.0]).std()
    assert abs(pipe.transform(df).first().features[0] - (1 - 3) / sd) < 1e-12


def test_fits_use_the_reference_sizes_and_training_rows(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from acreage.ml import select
    from acreage.plans import q_ml
    rows = [(f"r{i}", float(i % 7), float(i % 3), float(i % 5) + 1, i % 4 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "rid string, a double, b double, label double, is_test boolean")
    df = df.withColumn("c", F.col("a") * F.col("b")).withColumn("d", F.col("a") + F.col("b"))
    cols = ["a", "b", "c", "d"]
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    monkeypatch.setattr(q_ml, "_holdout_frame", lambda *_: (x, cols))
    fits, searches = set(), []
    for cls, size in ((RandomForestRegressor, "numTrees"), (GBTRegressor, "maxIter")):
        def fit(self, data, params=None, size=size, real=cls.fit):
            fits.add((size, self.getOrDefault(size), data.where("is_test").count()))
            return real(self.copy({self.getParam(size): 2, self.maxDepth: 2}), data, params)
        monkeypatch.setattr(cls, "fit", fit)
    repeats, real = [], select.permutation_importance

    def importance(model, data, *args, **kw):
        repeats.append((type(model).__name__, kw["repeats"], data.where("is_test").count()))
        return real(model, data, *args, **{**kw, "repeats": 1})
    monkeypatch.setattr(select, "permutation_importance", importance)

    def search(stages, est, space, n_draws, folds, train, **kw):
        searches.append((type(est).__name__, n_draws, folds, train.where("is_test").count(), min(space.get("numTrees") or space["maxIter"])))
        for name, values in space.items():
            est.copy({est.getParam(name): values[0]})
        return est.fit(train), None, [({}, 1.0)]
    monkeypatch.setattr(q_ml.train, "random_search", search)

    def sizes(name):
        fits.clear()
        repeats.clear()
        assert getattr(q_ml, name)(spark, "").count() > 0
        return fits, repeats

    assert sizes("forest_fit") == ({("numTrees", 200, 0)}, [])
    assert sizes("gbt_fit") == ({("maxIter", 100, 0)}, [])
    assert sizes("rfe") == ({("numTrees", 200, 0)}, [])
    assert sizes("permutation") == ({("numTrees", 200, 0)}, [("RandomForestRegressionModel", 10, 0)])
    assert sizes("feature_ranking") == ({("numTrees", 200, 0), ("maxIter", 100, 0)}, [("RandomForestRegressionModel", 10, 0)])
    assert sizes("stacking") == ({("numTrees", 617, 0), ("maxIter", 961, 0)}, [])
    sizes("random_search")
    assert searches == [("RandomForestRegressor", 50, 5, 0, 400), ("GBTRegressor", 50, 5, 0, 500)]
