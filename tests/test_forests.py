"""Forests and boosting on binned cells against MLlib, and their independence of partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from semblance.operators import forests as T
from semblance.operators import models as M

COLS = ["a", "b", "c"]


def _table(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 50, n).astype(float), rng.integers(0, 9, n) / 8, rng.random(n) < 0.02
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c.astype(float), "y": 3 * np.sin(a / 8) * b + 4 * c + rng.normal(0, 0.3, n) + 100})


def _mllib(est, train, test):
    vec = VectorAssembler(inputCols=COLS, outputCol="features")
    return {r["id"]: r["prediction"] for r in est.fit(vec.transform(train)).transform(vec.transform(test)).select("id", "prediction").collect()}


def _ours(fit, train, test):
    return {r["id"]: r["prediction"] for r in fit(train)(test).select("id", "prediction").collect()}


def test_boosting_is_that_of_mllib(spark):
    df = spark.createDataFrame(_table()).repartition(3).localCheckpoint()
    fits = M.fit_regressors(COLS, "y", trees=20)
    got = _ours(fits["Gradient Boosting"], df, df)
    want = _mllib(GBTRegressor(labelCol="y", maxIter=20, stepSize=0.1, maxDepth=3, seed=42), df, df)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_forest_is_as_good_as_mllib_under_any_partitioning(spark):
    data = _table(6000)
    train, test = (spark.createDataFrame(data[data["id"] % 4 != 0]), spark.createDataFrame(data[data["id"] % 4 == 0]))
    forest = M.fit_regressors(COLS, "y", trees=30, depth=6)["Random Forest"]
    got, again = _ours(forest, train.repartition(2), test), _ours(forest, train.repartition(7), test)
    want = _mllib(RandomForestRegressor(labelCol="y", numTrees=30, maxDepth=6, featureSubsetStrategy="all", seed=42), train, test)
    truth = dict(zip(data["id"], data["y"]))
    error = lambda p: np.sqrt(np.mean([(p[i] - truth[i]) ** 2 for i in p]))
    assert max(abs(got[i] - again[i]) for i in got) < 1e-9
    assert abs(error(got) / error(want) - 1) < 0.02


def test_work_of_training_does_not_grow_with_trees_and_levels(spark):
    """MLlib reads the rows for each level; here jobs read them a fixed number of times."""
    df = spark.createDataFrame(_table(2000))
    def jobs(trees, depth):
        group = f"forest-{trees}-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        M.fit_regressors(COLS, "y", trees=trees, depth=depth)["Random Forest"](df)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)
    assert jobs(2, 2) == jobs(8, 7)


def test_hot_cells_and_copies(spark, monkeypatch):
    data = _table(3000)
    data.loc[data["id"] < 2000, COLS] = 1.0
    df = spark.createDataFrame(data)
    binned = T.bin_rows(df, COLS, "y")
    plain = T.grow_forest(binned, 5, 4, 42)
    monkeypatch.setattr(T, "HOT_CELL", 100)
    dealt = T.grow_forest(binned, 5, 4, 42)
    assert np.array_equal(plain.feature, dealt.feature) and np.allclose(plain.value, dealt.value)
    # sixty copies of every row are drawn together: weights near 60 a row
    twice = T.bin_rows(df.crossJoin(spark.range(60).select(F.col("id").alias("copy"))), COLS, "y")
    assert (twice.n == 60 * binned.n).all()
    many = T.grow_forest(twice, 5, 0, 42)
    assert abs(many.value[:, 0].mean()) < 0.05 and abs(many.offset - data["y"].mean()) < 1e-9


def test_many_values_and_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"id": np.arange(5000), "a": rng.normal(size=5000), "b": rng.normal(size=5000), "c": 0.0})
    data["y"] = data["a"] ** 2 + data["b"]
    df = spark.createDataFrame(data)
    binned = T.bin_rows(df, COLS, "y")
    assert [len(e) for e in binned.edges] == [31, 31, 0] and binned.n.sum() == 5000
    monkeypatch.setattr(T, "MOST_CELLS", 100)
    assert T.bin_rows(df, COLS, "y") is None
    got = _ours(M.fit_regressors(COLS, "y", trees=3, depth=3)["Random Forest"], df, df)
    assert len(got) == 5000


def test_missing_values_raise(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 2.0), (None, 0.0, 1.0, 2.0)], "a double, b double, c double, y double")
    with pytest.raises(Exception, match="null or NaN"):
        T.bin_rows(df, COLS, "y")


def test_poisson_draws_have_their_mean_and_variance():
    words = T.bag_words(42, np.arange(4000), 50)
    for m in (1, 7, 60, 5000):
        w = T.poisson(words, np.full(4000, m))
        assert abs(w.mean() / m - 1) < 0.02 and abs(w.var() / m - 1) < 0.03
    assert abs((T.poisson(words, np.ones(4000)) == 0).mean() - np.exp(-1)) < 0.005
