"""Does the synthetic table look like the real one? Column and pair comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from semblance.functions.special import chi2_tail, ks_exact_tail
from semblance.operators.frames import melt, report
from semblance.operators.ranks import cdf_distances

# Acceptance limits and smoothing of the comparison reports.
P_LIMIT = 0.05
CORR_TOLERANCE = 0.1
SHARE_FLOOR = 1e-10
EXACT_ROWS = 10_000
KS_TERMS = 100
BINS = 20


def _moments(df: DataFrame, cols: Sequence[str], tag: str) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = [
        {"column": F.lit(c), f"{tag}_mean": F.col(f"m{i}"), f"{tag}_std": F.col(f"s{i}"),
         f"{tag}_min": F.col(f"l{i}"), f"{tag}_max": F.col(f"h{i}")}
        for i, c in enumerate(cols)
    ]
    return report(df.agg(*aggs), rows)


def compare_moments(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population std, min and max per column, real beside synthetic."""
    # both sides have one row per column
    return _moments(real, cols, "real").join(F.broadcast(_moments(syn, cols, "syn")), "column")


def kolmogorov_tail(lam: Column) -> Column:
    """Asymptotic two-sided tail of the Kolmogorov distribution."""
    ks = F.sequence(F.lit(1), F.lit(KS_TERMS))
    series = F.aggregate(
        ks, F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


@F.pandas_udf(DoubleType())
def _ks_exact_p(m: pd.Series, n: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(g) else ks_exact_tail(int(a), int(b), int(g)) for a, b, g in zip(m, n, gap)], dtype=float)


def ks_two_sample(real: DataFrame, syn: DataFrame, cols: Sequence[str], method: str = "auto", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Largest CDF gap per column, its p-value and the verdict at 0.05.

    ``method`` is auto (the exact law where both sides have at most ``exact_rows`` values, else the
    asymptotic one), exact or asymptotic. The exact law counts lattice paths, O(n_real n_syn) for one number per column.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError("method is auto, exact or asymptotic")
    limit = {"auto": exact_rows, "exact": 1 << 31, "asymptotic": -1}[method]
    # one row per column
    rows = [(r["column"], r["ks"], r["n_real"], r["n_syn"], r["cross"] if max(r["n_real"], r["n_syn"]) <= limit else None)
            for r in cdf_distances(real, syn, cols)]
    out = real.sparkSession.createDataFrame(rows, "column string, ks double, n_real bigint, n_syn bigint, _gap bigint")
    a, b = F.col("n_real").cast("double"), F.col("n_syn").cast("double")
    n = a * b / (a + b)
    p = kolmogorov_tail(F.col("ks") * F.sqrt(n))
    if method != "asymptotic":
        p = F.coalesce(_ks_exact_p("n_real", "n_syn", "_gap"), p)
    out = out.withColumn("p_value", p).drop("_gap")
    return out.withColumn("verdict", F.when(F.col("p_value") > P_LIMIT, "PASS").otherwise("FAIL"))


def category_shares(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts and shares of every category in either table."""
    def tall(df, real_side):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        return df.select(F.inline(cells), F.lit(real_side).alias("r")).where(F.col("value").isNotNull())

    counted = tall(real, 1).unionByName(tall(syn, 0)).groupBy("column", "value").agg(
        F.sum("r").alias("n_real"), F.sum(1 - F.col("r")).alias("n_syn")
    )
    sizes = counted.groupBy("column").agg(F.sum("n_real").alias("total_real"), F.sum("n_syn").alias("total_syn"))
    # sizes has one row per column
    return counted.join(F.broadcast(sizes), "column").select(
        "column", "value", "n_real", "n_syn",
        F.coalesce(F.try_divide("n_real", "total_real"), F.lit(0.0)).alias("share_real"),
        F.coalesce(F.try_divide("n_syn", "total_syn"), F.lit(0.0)).alias("share_syn"), "total_syn",
    )


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(float(a), int(d)) for a, d in zip(x, dof)])


def chi_square(real: DataFrame, syn: DataFrame, cols: Sequence[str], on: str = "counts") -> DataFrame:
    """Chi-square of synthetic against real category shares.

    ``on='counts'`` (default) scales shares by the synthetic row count, as the test requires;
    ``on='shares'`` keeps plain shares, which understates the statistic by that factor.
    """
    if on not in ("counts", "shares"):
        raise ValueError("on is 'counts' or 'shares'")
    size = F.col("total_syn") if on == "counts" else F.lit(1.0)
    seen = (F.col("share_syn") + SHARE_FLOOR) * size
    expected = (F.col("share_real") + SHARE_FLOOR) * size
    out = category_shares(real, syn, cols).groupBy("column").agg(
        F.sum((seen - expected) * (seen - expected) / expected).alias("chi2"), F.count("*").alias("n_categories")
    )
    out = out.withColumn("p_value", _chi2_p("chi2", F.col("n_categories") - 1))
    return out.withColumn("verdict", F.when(F.coalesce(F.col("p_value"), F.lit(1.0)) > P_LIMIT, "PASS").otherwise("FAIL"))


def corr_matrix(df: DataFrame, cols: Sequence[str], name: str = "r") -> DataFrame:
    """Pearson r of every ordered pair of columns, diagonal included, from one pass over the pairs."""
    cols = list(cols)
    pairs = list(combinations(range(len(cols)), 2))
    num = [F.col(c).cast("double") for c in cols]
    aggs = [F.corr(num[i], num[j]).alias(f"r{i}_{j}") for i, j in pairs] or [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = F.lit(1.0) if i == j else F.col(f"r{min(i, j)}_{max(i, j)}")
            rows.append({"col_a": F.lit(a), "col_b": F.lit(b), name: v})
    return report(df.agg(*aggs), rows)


def corr_pairs(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both matrices cell by cell with the absolute difference."""
    # both sides have one row per pair of columns
    both = corr_matrix(real, cols, "r_real").join(F.broadcast(corr_matrix(syn, cols, "r_syn")), ["col_a", "col_b"])
    return both.withColumn("diff", F.abs(F.col("r_real") - F.col("r_syn")))


def corr_matrix_diff(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean absolute difference over all cells and Frobenius norm of the difference."""
    return corr_pairs(real, syn, cols).agg(
        F.avg("diff").alias("mean_abs_diff"), F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("frobenius")
    )


def corr_preservation(real: DataFrame, syn: DataFrame, cols: Sequence[str], target: str, tol: float = CORR_TOLERANCE) -> DataFrame:
    """Feature-target correlations in both tables with PASS/FAIL, and feature-feature differences."""
    pairs = corr_pairs(real, syn, [*cols, target]).where(F.col("col_a") < F.col("col_b"))
    with_target = (F.col("col_a") == target) | (F.col("col_b") == target)
    feature = F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a"))
    other = F.when(with_target, F.lit(target)).otherwise(F.col("col_b"))
    return pairs.select(
        feature.alias("feature"), other.alias("against"), "r_real", "r_syn", "diff",
        F.when(with_target, F.when(F.col("diff") < tol, "PASS").otherwise("FAIL")).alias("verdict"),
    )


def corr_preserved(real: DataFrame, syn: DataFrame, cols: Sequence[str], target: str, tol: float = CORR_TOLERANCE) -> DataFrame:
    """One flag: every feature-target correlation is kept within the tolerance."""
    rows = corr_preservation(real, syn, cols, target, tol).where(F.col("verdict").isNotNull())
    return rows.agg(F.bool_and(F.col("verdict") == "PASS").alias("all_preserved"), F.max("diff").alias("max_diff"))


def histogram_overlay(real: DataFrame, syn: DataFrame, cols: Sequence[str], bins: int = BINS, shared_range: bool = False) -> DataFrame:
    """Count and density per equal-width bin for both tables; every bin is listed.

    Each table is binned over its own range unless ``shared_range``.
    """
    spans = {}
    for side, df in (("real", real), ("syn", syn)):
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("l", F.min), ("h", F.max))]).first()
        for i, c in enumerate(cols):
            spans[side, c] = (row[f"l{i}"], row[f"h{i}"])
    if shared_range:
        for c in cols:
            lo, hi = min(spans["real", c][0], spans["syn", c][0]), max(spans["real", c][1], spans["syn", c][1])
            spans["real", c] = spans["syn", c] = (lo, hi)
    spark = real.sparkSession
    table = spark.createDataFrame(
        [(s, c, float(lo), float(hi if hi > lo else lo + 1.0)) for (s, c), (lo, hi) in spans.items()],
        "side string, column string, lo double, hi double",
    )
    def placed(df: DataFrame, side: str) -> DataFrame:
        cells = []
        for c in cols:
            lo, hi = (float(x) for x in spans[side, c])
            v, w = F.col(c).cast("double"), F.lit(((hi if hi > lo else lo + 1.0) - lo) / bins)
            cells.append(F.struct(F.lit(c).alias("column"), F.least(F.floor((v - F.lit(lo)) / w), F.lit(bins - 1)).cast("int").alias("bin"), v.alias("value")))
        return df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("count")).withColumn("side", F.lit(side))

    width = (F.col("hi") - F.col("lo")) / bins
    counted = placed(real, "real").unionByName(placed(syn, "syn"))
    frame = table.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    sizes = counted.groupBy("side", "column").agg(F.sum("count").alias("n"))
    full = frame.join(counted, ["side", "column", "bin"], "left").join(F.broadcast(sizes), ["side", "column"])
    count = F.coalesce(F.col("count"), F.lit(0))
    return full.select(
        "column", "side", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), count.alias("count"),
        (count / (F.col("n") * width)).alias("density"),
    )


def column_distance(real: DataFrame, syn: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """Mean and std difference, KS, Wasserstein-1 and binned KL(real || syn) per column."""
    rows = [(r["column"], r["ks"], r["area"]) for r in cdf_distances(real, syn, cols, area=True)]
    by_cdf = real.sparkSession.createDataFrame(rows, "column string, ks double, wasserstein double")
    moments = compare_moments(real, syn, cols).select(
        "column", F.abs(F.col("real_mean") - F.col("syn_mean")).alias("mean_diff"),
        F.abs(F.col("real_std") - F.col("syn_std")).alias("std_diff"),
    )
    bars = histogram_overlay(real, syn, cols, bins, shared_range=True)
    share = bars.groupBy("column", "bin").agg(
        F.sum(F.when(F.col("side") == "real", F.col("count"))).alias("r"), F.sum(F.when(F.col("side") == "syn", F.col("count"))).alias("s")
    )
    totals = share.groupBy("column").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    p, q = F.col("r") / F.col("tr") + SHARE_FLOOR, F.col("s") / F.col("ts") + SHARE_FLOOR
    kl = share.join(F.broadcast(totals), "column").groupBy("column").agg(F.sum(p * F.ln(p / q)).alias("kl"))
    # every side has one row per column
    return by_cdf.join(F.broadcast(moments), "column").join(F.broadcast(kl), "column")


def category_distance(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total variation and Jensen-Shannon divergence (nats) per categorical column."""
    p, q = F.col("share_real"), F.col("share_syn")
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)
    return category_shares(real, syn, cols).groupBy("column").agg(
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"), (F.sum(part(p) + part(q)) / 2).alias("js_divergence")
    )
