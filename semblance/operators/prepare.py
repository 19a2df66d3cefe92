"""Preprocessing: fit with one aggregation, apply as Column expressions, invert."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.special import CDF_EDGE, normal_cdf, probit
from semblance.functions.text import MISSING, OTHER
from semblance.operators.frames import lookup, pin
from semblance.operators.layout import label_decode
from semblance.operators.ranks import exact_quantiles, hash_cut

MIN_CATEGORY_COUNT = 50
KNOTS = 1000
BOUND = 3.0


@dataclass(frozen=True)
class Params:
    """Fitted numbers per column: (p1, p2), or quantile knots for ``quantile``."""

    kind: str
    values: dict[str, tuple[float, ...]]
    mode: str = ""

    def frame(self, spark) -> DataFrame:
        rows = [(self.kind, self.mode, c, [float(x) for x in v]) for c, v in sorted(self.values.items())]
        return spark.createDataFrame(rows, "kind string, mode string, column string, p array<double>")

    @staticmethod
    def from_frame(df: DataFrame) -> Params:
        rows = df.collect()
        return Params(rows[0]["kind"], {r["column"]: tuple(r["p"]) for r in rows}, rows[0]["mode"])

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "mode": self.mode, "values": self.values})


# ---- missing values and categories -----------------------------------------------------


def fit_median(df: DataFrame, cols: Sequence[str]) -> Params:
    q = exact_quantiles(df, cols, [0.5])
    return Params("median", {c: (q[c][0],) for c in cols if q[c][0] is not None})


def impute(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v[0])) for c, v in params.values.items()})


def fill_missing_category(df: DataFrame, cols: Sequence[str], label: str = MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c in cols})


def fit_frequent(df: DataFrame, cols: Sequence[str], min_freq: int = MIN_CATEGORY_COUNT) -> DataFrame:
    """(column, value) pairs seen at least ``min_freq`` times."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counted = df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    return pin(counted.where(F.col("n") >= min_freq).select("column", "value"))


def group_rare(df: DataFrame, frequent: DataFrame, cols: Sequence[str], other: str = OTHER) -> DataFrame:
    """Values outside the frequent list become ``Other``."""
    out = df
    for c in cols:
        known = frequent.where(F.col("column") == c).select(F.col("value").alias(c), F.lit(True).alias("_known"))
        out = lookup(out.withColumn(c, F.col(c).cast("string")), known, [c])
        out = out.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise(other)).drop("_known")
    return out


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Categorical columns with at most one distinct value (min = max, no distinct shuffle)."""
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def drop_constant_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, cols))


# ---- numeric scaling -------------------------------------------------------------------


def fit_clip(df: DataFrame, cols: Sequence[str], lo: float = 1.0, hi: float = 99.0) -> Params:
    q = exact_quantiles(df, cols, [lo / 100.0, hi / 100.0])
    return Params("clip", {c: tuple(q[c]) for c in cols})


def clip(df: DataFrame, params: Params) -> DataFrame:
    """Limit to [p1, p2]; null stays null."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo)))
        for c, (lo, hi) in params.values.items()
    })


def _one_row(df: DataFrame, cols: Sequence[str], *fns) -> dict[str, tuple[float, ...]]:
    row = df.agg(*[fn(F.col(c).cast("double")).alias(f"a{i}_{j}") for i, c in enumerate(cols) for j, fn in enumerate(fns)]).first()
    return {c: tuple(row[f"a{i}_{j}"] for j in range(len(fns))) for i, c in enumerate(cols)}


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Params:
    return Params("minmax", _one_row(df, cols, F.min, F.max))


def fit_standard(df: DataFrame, cols: Sequence[str], bounded: bool = False) -> Params:
    """Mean and population std; ``bounded`` clips to +-3 and divides by 3."""
    return Params("standard", _one_row(df, cols, F.avg, F.stddev_pop), "bounded" if bounded else "")


def fit_quantile_normal(df: DataFrame, cols: Sequence[str], mode: str = "bounded", knots: int = KNOTS) -> Params:
    """Quantile knots for the map to a normal shape; ``mode`` is bounded, raw or clip3."""
    if mode not in ("bounded", "raw", "clip3"):
        raise ValueError("mode is bounded, raw or clip3")
    n = df.count()
    m = max(2, min(knots, n))
    q = exact_quantiles(df, cols, [i / (m - 1) for i in range(m)])
    return Params("quantile", {c: tuple(q[c]) for c in cols}, mode)


def _bounded(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(BOUND)), F.lit(-BOUND)) / F.lit(BOUND)


def empirical_cdf(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Interpolated rank of x among sorted knots; ties take the mean of both sides."""
    refs = np.linspace(0.0, 1.0, len(knots))
    up = np.interp(x, knots, refs)
    down = -np.interp(-x, -knots[::-1], -refs[::-1])
    return 0.5 * (up + down)


def _quantile_forward(x: Column, knots: tuple[float, ...], mode: str) -> Column:
    grid = np.asarray(knots, dtype=float)

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        v = s.to_numpy(dtype=float)
        p = np.clip(empirical_cdf(v, grid), CDF_EDGE, 1.0 - CDF_EDGE)
        z = probit(p)
        if mode != "raw":
            z = np.clip(z, -BOUND, BOUND)
        if mode == "bounded":
            z = z / BOUND
        return pd.Series(z).where(s.notna(), None)

    return apply(x)


def _quantile_inverse(z: Column, knots: tuple[float, ...], mode: str, clip_first: bool) -> Column:
    grid = np.asarray(knots, dtype=float)

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        v = s.to_numpy(dtype=float)
        if mode == "bounded":
            v = (np.clip(v, -1.0, 1.0) if clip_first else v) * BOUND
        p = normal_cdf(v)
        p = np.where(p <= CDF_EDGE, 0.0, np.where(p >= 1.0 - CDF_EDGE, 1.0, p))
        return pd.Series(np.interp(p, np.linspace(0.0, 1.0, len(grid)), grid)).where(s.notna(), None)

    return apply(z)


def scale(df: DataFrame, params: Params) -> DataFrame:
    """Apply a fitted scaler; values outside the fitted range are not cut (except in bounded modes)."""
    out = {}
    for c, p in params.values.items():
        x = F.col(c).cast("double")
        if params.kind == "minmax":
            span = (p[1] - p[0]) or 1.0
            out[c] = (x - F.lit(p[0])) / F.lit(span) * F.lit(2.0) - F.lit(1.0)
        elif params.kind == "standard":
            z = (x - F.lit(p[0])) / F.lit(p[1] or 1.0)
            out[c] = _bounded(z) if params.mode == "bounded" else z
        elif params.kind == "quantile":
            out[c] = _quantile_forward(x, p, params.mode)
        else:
            raise ValueError(params.kind)
    return df.withColumns(out)


def unscale(df: DataFrame, params: Params, clip_first: bool = True) -> DataFrame:
    """Inverse of :func:`scale`."""
    out = {}
    for c, p in params.values.items():
        z = F.col(c).cast("double")
        if params.kind == "minmax":
            span = (p[1] - p[0]) or 1.0
            out[c] = (z + F.lit(1.0)) / F.lit(2.0) * F.lit(span) + F.lit(p[0])
        elif params.kind == "standard":
            z = z * F.lit(BOUND) if params.mode == "bounded" else z
            out[c] = z * F.lit(p[1] or 1.0) + F.lit(p[0])
        elif params.kind == "quantile":
            out[c] = _quantile_inverse(z, p, params.mode, clip_first)
        else:
            raise ValueError(params.kind)
    return df.withColumns(out)


# ---- splits ----------------------------------------------------------------------------


def split_random(df: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * n) rows, chosen by hash."""
    return hash_cut(df, seed, key, share)


def split_threshold(df: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> DataFrame:
    """One-pass split: ``is_test`` when the row's uniform is below the share (size varies slightly)."""
    from semblance.functions.rand import uniform

    return df.withColumn("is_test", uniform(seed, key) < share)


def split_stratified(df: DataFrame, key: Column, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: ceil(share * class size) rows of every class."""
    return hash_cut(df, seed, key, share, by=label)


# ---- moments and decoding --------------------------------------------------------------


def match_moments(gen: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Give generated columns the mean and population std of train, then clip to [-1, 1]."""
    g, t = _one_row(gen, cols, F.avg, F.stddev_pop), _one_row(train, cols, F.avg, F.stddev_pop)
    out = {}
    for c in cols:
        z = (F.col(c) - F.lit(g[c][0])) / F.lit(g[c][1] + 1e-8)
        out[c] = F.greatest(F.least(z * F.lit(t[c][1]) + F.lit(t[c][0]), F.lit(1.0)), F.lit(-1.0))
    return gen.withColumns(out)


def decode_synthetic(df: DataFrame, scaler: Params, target_scaler: Params | None, dictionary: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Generated scaled rows with category codes back to original units and category values."""
    out = unscale(df, scaler)
    if target_scaler:
        out = unscale(out, target_scaler)
    return label_decode(out, dictionary, cats)


__all__ = [
    "KNOTS", "Params", "clip", "constant_columns", "decode_synthetic", "drop_constant_categories", "empirical_cdf",
    "fill_missing_category", "fit_clip", "fit_frequent", "fit_median", "fit_minmax",
    "fit_quantile_normal", "fit_standard", "group_rare", "impute", "match_moments", "scale", "split_random",
    "split_stratified", "split_threshold", "unscale",
]
