"""Utility scores: metrics, train-on-X/test-on-real tables and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.operators.frames import cut_lineage, report
from semblance.operators.models import RIDGE_ALPHA, Estimator, Moments, Ridge, keyed_moments

# Score bands, verdict limits and names of the comparison tables.
BASELINE = "Original"
BANDS = ((0.9, "HIGH"), (0.7, "MODERATE"), (0.5, "MODERATE-LOW"))
LOWEST_BAND = "LOW"
NEAR_ORIGINAL = 0.95
LOWER_IS_BETTER = ("rmse", "mae")
SEED_STEP = 42


def regression_metrics(df: DataFrame, y: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 (may be negative; null for a constant y) per group."""
    err = F.col(y).cast("double") - F.col(prediction).cast("double")
    sse = F.sum(err * err)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - sse / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
    )


def _confusion(df: DataFrame, y: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, prediction: str = "prediction") -> DataFrame:
    """Counts with one row per true class and one column ``p_<class>`` per predicted class, all classes present."""
    cells = _confusion(df, y, prediction, [])
    classes = sorted(r[0] for r in cells.select(F.explode(F.array("y", "p"))).distinct().collect())
    wide = cells.groupBy("y").pivot("p", classes).agg(F.sum("n"))
    # one row per class
    rows = df.sparkSession.createDataFrame([(c,) for c in classes], "y int")
    full = rows.join(F.broadcast(wide), "y", "left")
    return full.select("y", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"p_{c}") for c in classes])


def _per_class(df: DataFrame, y: str, prediction: str, by: Sequence[str]) -> DataFrame:
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    tall = _confusion(df, y, prediction, by).select(*by, F.inline(sides))
    out = tall.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumn("precision", zero("hits", "predicted")).withColumn("recall", zero("hits", "support"))
    f1 = F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def classification_metrics(df: DataFrame, y: str, prediction: str = "prediction", positive: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1 of the positive class and support-weighted F1 per group."""
    per = _per_class(df, y, prediction, by)
    n = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("hits") / n).alias("accuracy"),
        F.coalesce(F.max(F.when(F.col("class") == positive, F.col("f1"))), F.lit(0.0)).alias("f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("n"),
    )


def classification_report(df: DataFrame, y: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    per = _per_class(df, y, prediction, [])
    rows = per.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    acc = F.sum("hits") / n
    accuracy = per.agg(acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support")).select(F.lit("accuracy").alias("row"), "*")
    macro = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support")).select(F.lit("macro avg").alias("row"), "*")
    heavy = per.agg(*[weighted(c) for c in ("precision", "recall", "f1")], n.alias("support")).select(F.lit("weighted avg").alias("row"), "*")
    return rows.unionByName(accuracy).unionByName(macro).unionByName(heavy)


def tstr(scenarios: dict[str, DataFrame], test: DataFrame, estimators: dict[str, Estimator], y: str, task: str = "regression") -> DataFrame:
    """Scores of every (model, scenario): train on the scenario, test on one real test set.

    Each scenario is written once, since every estimator reads it several times; the predictions
    on the test set are scored together.
    """
    preds = None
    for name, train in scenarios.items():
        data = cut_lineage(train)
        for model, fit in estimators.items():
            one = fit(data)(test).select(
                F.lit(model).alias("model"), F.lit(name).alias("scenario"), F.col(y).alias("y"), F.col("prediction")
            )
            preds = one if preds is None else preds.unionByName(one)
    score = regression_metrics if task == "regression" else classification_metrics
    return score(preds, "y", by=["model", "scenario"])


@dataclass(frozen=True)
class LinearSpec:
    """A ridge model by its features and penalty."""

    cols: tuple[str, ...]
    alpha: float = RIDGE_ALPHA


def scenario_moments(parts: dict[str, DataFrame], scenarios: dict[str, Sequence[str]], cols: Sequence[str]) -> dict[str, Moments]:
    """Moments of scenarios that are made of parts: one pass over every part, then sums."""
    tagged = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), *cols)
        tagged = one if tagged is None else tagged.unionByName(one)
    found = keyed_moments(tagged, "part", cols)
    empty = Moments(tuple(cols), 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols))))
    return {s: reduce(add, [found.get(p, empty) for p in members], empty) for s, members in scenarios.items()}


def score_linear(test: DataFrame, fits: dict[tuple[str, str], Ridge], y: str) -> DataFrame:
    """(model, scenario, n, rmse, mae, r2) of many linear models in one pass over the test rows."""
    target = F.col(y).cast("double")
    aggs, rows = [F.count("*").alias("n"), F.var_pop(target).alias("var")], []
    for i, ((model, scenario), fit) in enumerate(fits.items()):
        out = F.lit(fit.intercept)
        for c, b in zip(fit.cols, fit.coef):
            out = out + F.col(c).cast("double") * F.lit(b)
        aggs += [F.avg((target - out) * (target - out)).alias(f"s{i}"), F.avg(F.abs(target - out)).alias(f"a{i}")]
        rows.append({"model": F.lit(model), "scenario": F.lit(scenario), "n": F.col("n"), "rmse": F.sqrt(f"s{i}"), "mae": F.col(f"a{i}"), "r2": F.lit(1.0) - F.col(f"s{i}") / F.nullif(F.col("var"), F.lit(0.0))})
    return report(test.agg(*aggs), rows)


def tstr_linear(parts: dict[str, DataFrame], scenarios: dict[str, Sequence[str]], test: DataFrame, models: dict[str, LinearSpec], y: str) -> DataFrame:
    """Scores of every (model, scenario) of linear models: one pass over the parts and one over the test rows.

    A scenario is a list of parts (real rows, copies, ...), whose moments are summed; all models of a
    scenario are solved from them. ``tstr`` does the same for any estimator, with a job for each fit.
    """
    cols = list(dict.fromkeys([c for m in models.values() for c in m.cols] + [y]))
    moments = scenario_moments(parts, scenarios, cols)
    fits = {(m, s): moments[s].ridge(spec.cols, y, spec.alpha) for s in scenarios for m, spec in models.items()}
    return score_linear(test, fits, y)


def tidy(scores: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model", "scenario")) -> DataFrame:
    """One row per (model, scenario, metric)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return scores.select(*keys, F.inline(cells))


def delta_table(scores: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Against the baseline scenario: difference, percent change, percent of baseline (not below 0) and whether it is better.

    ``scores`` is (model, scenario, metric, value).
    """
    w = Window.partitionBy("model", "metric")
    base = F.max(F.when(F.col("scenario") == baseline, F.col("value"))).over(w)
    out = scores.withColumn("baseline", base).where(F.col("scenario") != baseline)
    delta = F.col("value") - F.col("baseline")
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), delta < 0).otherwise(delta > 0)
    return out.select(
        "model", "scenario", "metric", "value", "baseline", delta.alias("delta"),
        F.try_divide(delta * 100.0, F.abs("baseline")).alias("percent"),
        F.greatest(F.try_divide(F.col("value") * 100.0, F.col("baseline")), F.lit(0.0)).alias("percent_of_baseline"),
        better.alias("better"),
    )


def method_summary(scores: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Mean R2 over models per method and use, with best/worst marks and the 95 % flag.

    ``scores`` is (method, use, model, r2); a missing use stays missing.
    """
    mean = scores.groupBy("method", "use").agg(F.avg("r2").alias("mean_r2"), F.count("r2").alias("n_models"))
    every = Window.partitionBy(F.lit(0))
    original = F.max(F.when(F.col("method") == baseline, F.col("mean_r2"))).over(every)
    out = mean.withColumn("original_r2", original).where(F.col("method") != baseline)
    # one row per method and use
    in_use = Window.partitionBy("use")
    return out.select(
        "method", "use", "mean_r2", "n_models",
        (F.col("method") == F.max_by("method", "mean_r2").over(in_use)).alias("best"),
        (F.col("method") == F.min_by("method", "mean_r2").over(in_use)).alias("worst"),
        (F.col("mean_r2") >= F.col("original_r2") * NEAR_ORIGINAL).alias("near_original"),
    )


def win_count(scores: DataFrame, a: str, b: str) -> DataFrame:
    """On how many models scenario ``a`` has a lower RMSE than ``b``; ties go to ``b``. ``scores`` is (model, scenario, rmse)."""
    per = scores.groupBy("model").agg(
        F.max(F.when(F.col("scenario") == a, F.col("rmse"))).alias("a"), F.max(F.when(F.col("scenario") == b, F.col("rmse"))).alias("b")
    ).where("a IS NOT NULL AND b IS NOT NULL")
    wins, losses = F.count_if(F.col("a") < F.col("b")), F.count_if(F.col("a") >= F.col("b"))
    out = per.agg(wins.alias("wins"), losses.alias("losses"))
    verdict = F.when(F.col("wins") > F.col("losses"), a).when(F.col("wins") == F.col("losses"), "mixed").otherwise(b)
    return out.withColumn("verdict", verdict)


def best_baseline(scores: DataFrame, candidate: str, baselines: Sequence[str]) -> DataFrame:
    """Per model the baseline scenario with the lowest RMSE and whether the candidate beats it."""
    base = scores.where(F.col("scenario").isin(*baselines)).groupBy("model").agg(
        F.min_by("scenario", "rmse").alias("best_baseline"), F.min("rmse").alias("baseline_rmse"))
    cand = scores.where(F.col("scenario") == candidate).select("model", F.col("rmse").alias("candidate_rmse"))
    # one row per model
    out = base.join(F.broadcast(cand), "model")
    return out.withColumn("status", F.when(F.col("candidate_rmse") < F.col("baseline_rmse"), "BETTER").otherwise("WORSE"))


def bidirectional(real_train: DataFrame, real_test: DataFrame, syn: DataFrame, estimator: Estimator, y: str) -> DataFrame:
    """R2 for real/real, synthetic/real, real/synthetic and synthetic/synthetic train and test tables."""
    data = {"real": cut_lineage(real_train), "synthetic": cut_lineage(syn)}
    tests = {"real": real_test, "synthetic": data["synthetic"]}
    preds = None
    for src, train in data.items():
        predict = estimator(train)
        for dst, test in tests.items():
            one = predict(test).select(F.lit(src).alias("trained_on"), F.lit(dst).alias("tested_on"), F.col(y).alias("y"), "prediction")
            preds = one if preds is None else preds.unionByName(one)
    return regression_metrics(preds, "y", by=["trained_on", "tested_on"]).select("trained_on", "tested_on", "r2")


def bidirectional_linear(parts: dict[str, DataFrame], tests: dict[str, str], spec: LinearSpec, y: str) -> DataFrame:
    """(trained_on, tested_on, r2) of one linear model, all from the moments of the parts: no pass beyond the first.

    ``tests`` names the part that each training part's counterpart is tested on.
    """
    spark = next(iter(parts.values())).sparkSession
    moments = scenario_moments(parts, {p: [p] for p in parts}, [*spec.cols, y])
    rows = [(a, b, moments[t].r2(moments[a].ridge(spec.cols, y, spec.alpha), y)) for a in tests for b, t in tests.items()]
    return spark.createDataFrame(rows, "trained_on string, tested_on string, r2 double")


def seeds(n_runs: int = 5) -> list[int]:
    return [run * SEED_STEP for run in range(n_runs)]


def multi_seed(make: Callable[[int], DataFrame], test: DataFrame, estimator: Estimator, y: str, n_runs: int = 5) -> DataFrame:
    """(run, r2): train on ``make(seed)`` for each seed, test on one table."""
    preds = None
    for run, seed in enumerate(seeds(n_runs)):
        one = estimator(cut_lineage(make(seed)))(test).select(F.lit(run).alias("run"), F.col(y).alias("y"), "prediction")
        preds = one if preds is None else preds.unionByName(one)
    return regression_metrics(preds, "y", by=["run"]).select("run", "r2")


def multi_seed_linear(make: Callable[[int], DataFrame], test: DataFrame, spec: LinearSpec, y: str, n_runs: int = 5) -> DataFrame:
    """(run, r2) like ``multi_seed`` from moments: a pass over the test rows and one for each run, so that shuffles of one run lie on disk at a time."""

    def moments(df: DataFrame) -> Moments:
        return scenario_moments({"one": df}, {"one": ["one"]}, [*spec.cols, y])["one"]

    held = moments(test)
    rows = [(run, held.r2(moments(make(seed)).ridge(spec.cols, y, spec.alpha), y)) for run, seed in enumerate(seeds(n_runs))]
    return test.sparkSession.createDataFrame(rows, "run int, r2 double")


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean, population std, min and max of R2 over runs."""
    return runs.agg(F.count("*").alias("n_runs"), F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"),
                    F.min("r2").alias("min"), F.max("r2").alias("max"))


def band_of(r2: Column, with_moderate_low: bool = True) -> Column:
    out = None
    for limit, name in BANDS if with_moderate_low else BANDS[:2]:
        out = F.when(r2 > limit, name) if out is None else out.when(r2 > limit, name)
    return out.otherwise(LOWEST_BAND)


def baseline_band(scores: DataFrame, with_moderate_low: bool = True) -> DataFrame:
    """Best R2 over models and its band: how much room augmentation has."""
    out = scores.agg(F.max("r2").alias("best_r2"), F.max_by("model", "r2").alias("best_model"))
    return out.withColumn("band", band_of(F.col("best_r2"), with_moderate_low))
