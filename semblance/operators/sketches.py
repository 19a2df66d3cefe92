"""Mergeable column profiles: states kept as small tables, merged with those of appended data.

Distinct counts keep HyperLogLog registers, quantiles keep counts of logarithmic buckets. Both are
pure functions of the set or multiset of values, so the state of two parts merged equals the state of the
whole, in any order, and SQL can recompute it. ``save``/``load`` are plain Parquet tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.operators.frames import melt

# Register bits of the distinct count (12 bits: 1.6 % standard error), its bias constant, value accuracy of quantiles.
BITS = 12
ALPHA_NUMERATOR, ALPHA_SLOPE = 0.7213, 1.079
ACCURACY = 0.01


def distinct_state(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, register, rank): the largest position of the first one bit among the hashes of each register.

    Values are told apart by their text. At most 4,096 rows per column, whatever the table; nulls do not count.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    tall = df.select(F.inline(cells)).where("value IS NOT NULL").select("column", F.md5("value").alias("h"))
    digits = BITS // 4
    word = F.conv(F.substring("h", digits + 1, 13), 16, 10).cast("bigint")
    rank = 53 - F.when(word > 0, F.length(F.bin(word))).otherwise(0)
    return tall.select("column", F.conv(F.substring("h", 1, digits), 16, 10).cast("int").alias("register"), rank.cast("int").alias("rank")).groupBy("column", "register").agg(F.max("rank").alias("rank"))


def merge_distinct(*states: DataFrame) -> DataFrame:
    return _union(states).groupBy("column", "register").agg(F.max("rank").alias("rank"))


def distinct_estimates(state: DataFrame) -> DataFrame:
    """(column, n_distinct) with a standard error of 1.04 / sqrt(4096) = 1.6 %; small sets by counting empty registers."""
    m = 1 << BITS
    filled, inverse = F.count("*"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + (m - F.count("*"))
    raw = F.lit(ALPHA_NUMERATOR / (1.0 + ALPHA_SLOPE / m) * m * m) / F.col("inverse")
    empty = F.lit(m) - F.col("filled")
    small = (raw <= 2.5 * m) & (empty > 0)
    sums = state.groupBy("column").agg(filled.alias("filled"), inverse.alias("inverse"))
    return sums.select("column", F.when(small, F.lit(float(m)) * F.ln(F.lit(float(m)) / empty)).otherwise(raw).alias("n_distinct"))


def quantile_state(df: DataFrame, cols: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """(column, side, bucket, n): how many values fall into each logarithmic bucket; side is the sign.

    Buckets grow by (1 + a) / (1 - a), so a value is known within the relative error a; the whole range of
    doubles takes some 70,000 buckets at 1 %.
    """
    growth = math.log((1.0 + accuracy) / (1.0 - accuracy))
    tall = melt(df, cols).where("NOT isnan(value)")
    side = F.signum("value").cast("int")
    bucket = F.when(side != 0, F.ceil(F.ln(F.abs("value")) / F.lit(growth))).otherwise(0)
    return tall.select("column", side.alias("side"), bucket.cast("int").alias("bucket")).groupBy("column", "side", "bucket").agg(F.count("*").alias("n"))


def merge_quantiles(*states: DataFrame) -> DataFrame:
    return _union(states).groupBy("column", "side", "bucket").agg(F.sum("n").alias("n"))


def quantile_estimates(state: DataFrame, probs: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """(column, prob, value): the value at rank floor(p (n - 1)) within a relative error of ``accuracy``."""
    order = Window.partitionBy("column").orderBy(F.col("side") * F.col("bucket") + F.col("side") * F.lit(1 << 20))
    ranked = state.select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("column")).alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    spots = ranked.select("column", "side", "bucket", "n", "upto", "total", wanted).withColumn("spot", F.floor(F.col("prob") * (F.col("total") - 1)))
    growth = (1.0 + accuracy) / (1.0 - accuracy)
    value = F.col("side") * F.pow(F.lit(growth), F.col("bucket")) * F.lit(2.0 / (growth + 1.0))
    return spots.where("spot < upto AND spot >= upto - n").select("column", "prob", value.alias("value"))


def _union(states: Sequence[DataFrame]) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out
