"""Flagship plan: prepare line items, copy them with noise, compare the copy with the original."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.operators.fidelity import compare_moments, ks_two_sample
from semblance.operators.prepare import clip, fit_clip, fit_minmax, scale, split_random
from semblance.operators.sampling import noise_relative
from semblance.plans.inputs import CATS, NUMERIC, TARGET, lines, rounded


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, clip, scale, noise copy, then moments and KS per column."""
    dims = [*NUMERIC, TARGET]
    split = split_random(lines(spark, sf_dir).select("k", *dims, *CATS), F.col("k"))
    train = split.where("NOT is_test").drop("is_test")
    clipped = clip(train, fit_clip(train, dims))
    prepared = scale(clipped, fit_minmax(clipped, dims))
    copy = noise_relative(prepared, F.col("k"), NUMERIC, TARGET)
    ks = ks_two_sample(prepared, copy, dims)
    # both sides have one row per column
    return rounded(compare_moments(prepared, copy, dims).join(F.broadcast(ks), "column"))
