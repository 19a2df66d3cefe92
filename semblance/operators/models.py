"""Estimators for the train-here, test-there scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.operators.forests import Binned, Trees, bin_rows, grow_boosted, grow_forest, predictor
from semblance.operators.frames import shuffles_released

Predict = Callable[[DataFrame], DataFrame]
Estimator = Callable[[DataFrame], Predict]

# Estimator settings of the comparison tables.
TREES = 100
BOOST_DEPTH, BOOST_STEP = 3, 0.1
FOREST_DEPTH = 8
FOREST_MEMORY_MB = 1024
RIDGE_ALPHA = 1.0
LOGISTIC_C, LOGISTIC_ITERATIONS = 1.0, 1000
#: A partition of up to so many rows is never dealt out anew.
LOPSIDED_ROWS = 100_000


@dataclass(frozen=True)
class Ridge:
    """Linear model y = intercept + sum(coef * x)."""

    cols: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    def predict(self, df: DataFrame) -> DataFrame:
        out = F.lit(self.intercept)
        for c, b in zip(self.cols, self.coef):
            out = out + F.col(c).cast("double") * F.lit(b)
        return df.withColumn("prediction", out)


def ridge_closed_form(df: DataFrame, cols: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> Ridge:
    """Ridge with a free intercept from one pass of means and covariances.

    Only (d+1)(d+2)/2 numbers reach the driver; meant for tens of features.
    """
    cols = list(cols)
    v = [F.col(c).cast("double") for c in [*cols, target]]
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)]]
    aggs += [F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(d + 1) for j in range(i, d + 1) if i < d]
    row = df.agg(*aggs).first()
    n = row["n"]
    gram = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) * n
    xy = np.array([row[f"c{i}_{d}"] for i in range(d)]) * n
    coef = np.linalg.solve(gram + alpha * np.eye(d), xy)
    means = np.array([row[f"m{i}"] for i in range(d)])
    return Ridge(tuple(cols), tuple(float(b) for b in coef), float(row[f"m{d}"] - means @ coef))


@dataclass(frozen=True)
class Moments:
    """Row count, means and population covariances of some columns: all that linear models need, and they add up."""

    cols: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """The moments of both sets of rows together."""
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        cov = (self.n * self.cov + other.n * other.cov) / n + np.outer(gap, gap) * (self.n * other.n / n**2)
        return Moments(self.cols, n, self.mean + gap * (other.n / n), cov)

    @staticmethod
    def of(cols: Sequence[str], x: np.ndarray) -> Moments:
        """The moments of the rows of a matrix."""
        mean = x.mean(axis=0)
        centred = x - mean
        return Moments(tuple(cols), len(x), mean, centred.T @ centred / len(x))

    def at(self, cols: Sequence[str]) -> list[int]:
        return [self.cols.index(c) for c in cols]

    def ridge(self, cols: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> Ridge:
        """Ridge with a free intercept."""
        x, (y,) = self.at(cols), self.at([target])
        coef = np.linalg.solve(self.cov[np.ix_(x, x)] * self.n + alpha * np.eye(len(x)), self.cov[x, y] * self.n)
        return Ridge(tuple(cols), tuple(float(b) for b in coef), float(self.mean[y] - self.mean[x] @ coef))

    def r2(self, model: Ridge, target: str) -> float | None:
        """R2 of a linear model on these rows; null for a constant target."""
        x, (y,), b = self.at(model.cols), self.at([target]), np.array(model.coef)
        offset = self.mean[y] - model.intercept - self.mean[x] @ b
        error = self.cov[y, y] - 2.0 * b @ self.cov[x, y] + b @ self.cov[np.ix_(x, x)] @ b + offset**2
        return float(1.0 - error / self.cov[y, y]) if self.n and self.cov[y, y] > 0 else None


def keyed_moments(df: DataFrame, key: str, cols: Sequence[str]) -> dict[str, Moments]:
    """Moments of all columns for each value of ``key`` in one grouped aggregate.

    Means and covariances of a batch are matrix products; those of a partition are merged where it lies,
    so a key with most of the rows is no hot spot, and one state per key reaches the driver: for tens
    of columns and a bounded list of scenarios or seeds. Rows with a null in any column count nowhere.
    """
    cols = tuple(cols)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, n long, mean array<double>, cov array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("key", dropna=False, sort=False):
                x = part[names].to_numpy(dtype=float)
                x = x[~np.isnan(x).any(axis=1)]
                if len(x):
                    states[k] = states[k] + Moments.of(cols, x) if k in states else Moments.of(cols, x)
        if states:
            yield _state_rows(states)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _state_rows({pdf["key"].iloc[0]: reduce(add, (_state(cols, r) for r in pdf.itertuples(index=False)))})

    names = [f"v{i}" for i in range(len(cols))]
    # nulls are dropped where the numbers are read: a filter would compute drawn columns twice
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(v) for c, v in zip(cols, names)])
    with shuffles_released(df.sparkSession):
        merged = rows.mapInPandas(partial, schema).groupBy("key").applyInPandas(merge, schema)
    return {r["key"]: _state(cols, r) for r in merged.collect()}


def _state_rows(states: dict) -> pd.DataFrame:
    return pd.DataFrame([(k, m.n, m.mean, m.cov.ravel()) for k, m in states.items()], columns=["key", "n", "mean", "cov"])


def _state(cols: tuple[str, ...], row) -> Moments:
    mean = np.array(row[2], dtype=float)
    return Moments(cols, int(row[1]), mean, np.array(row[3], dtype=float).reshape(len(mean), -1))


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def ridge(cols: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> Estimator:
    return lambda train: ridge_closed_form(train, cols, target, alpha).predict


def _lopsided(df: DataFrame, width: int) -> bool:
    """Whether a partition holds many rows and more than twice an even share, as where a file has few row groups."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return max(sizes, default=0) > max(LOPSIDED_ROWS, 2 * sum(sizes) / width)


def _mllib(make, cols: Sequence[str]) -> Estimator:
    def fit(train: DataFrame) -> Predict:
        data = _vectors(train, cols)
        # training is heavy per row: use all cores even when the rows fit few partitions
        width = train.sparkSession.sparkContext.defaultParallelism
        if train.rdd.getNumPartitions() < width or _lopsided(train, width):
            data = data.repartition(width)
        model = make(data).fit(data)
        return lambda df: model.transform(_vectors(df, cols)).drop("features", "rawPrediction", "probability")

    return fit


def _binned(grow: Callable[[Binned], Trees], wide: Estimator, cols: Sequence[str], target: str) -> Estimator:
    """Trees grown on cells of binned features, or by ``wide`` where rows fill too many cells."""
    def fit(train: DataFrame) -> Predict:
        data = bin_rows(train, cols, target)
        return wide(train) if data is None else predictor(grow(data), cols)

    return fit


def fit_regressors(
    cols: Sequence[str], target: str, trees: int = TREES, depth: int = FOREST_DEPTH, alpha: float = RIDGE_ALPHA, seed: int = 42
) -> dict[str, Estimator]:
    """Random forest, gradient boosting and ridge under their report names.

    Trees are grown on cells of features in 32 bins: the rows are read a few times whatever the
    number of trees and levels. Where they fill too many cells, MLlib grows the same trees with a pass
    over the rows per level. Scores differ from those of exact-split, unlimited-depth libraries:
    features are binned and forests default to depth 8.
    """
    forest = _mllib(lambda _: RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", maxMemoryInMB=FOREST_MEMORY_MB, seed=seed), cols)
    boosting = _mllib(lambda _: GBTRegressor(labelCol=target, maxIter=trees, stepSize=BOOST_STEP, maxDepth=BOOST_DEPTH, seed=seed), cols)
    return {
        "Random Forest": _binned(lambda data: grow_forest(data, trees, depth, seed), forest, cols, target),
        "Gradient Boosting": _binned(lambda data: grow_boosted(data, trees, BOOST_DEPTH, BOOST_STEP), boosting, cols, target),
        "Ridge": ridge(cols, target, alpha),
    }


def fit_classifiers(cols: Sequence[str], target: str, trees: int = TREES, depth: int = FOREST_DEPTH, c: float = LOGISTIC_C, seed: int = 42) -> dict[str, Estimator]:
    """Logistic regression (penalty 1/C on the sum of losses) and random forest."""
    return {
        "Logistic Regression": _mllib(lambda data: LogisticRegression(
            labelCol=target, maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / (c * data.count()), standardization=False), cols),
        "Random Forest": _mllib(lambda _: RandomForestClassifier(
            labelCol=target, numTrees=trees, maxDepth=depth, maxMemoryInMB=FOREST_MEMORY_MB, seed=seed), cols),
    }
