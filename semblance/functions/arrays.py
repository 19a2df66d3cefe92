"""One-hot blocks and log-probability blocks as array Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; plain reuse of a Column repeats its work."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_hot(code: Column, k: int) -> Column:
    """0/1 block of length k; no level is dropped."""
    levels = F.sequence(F.lit(0), F.lit(k - 1))
    return bind(code, lambda c: F.transform(levels, lambda i: (i == c).cast("double")))


def argmax(block: Column) -> Column:
    """0-based position of the first maximum."""
    return bind(block, lambda b: (F.array_position(b, F.array_max(b)) - 1).cast("int"))


def total(block: Column) -> Column:
    return F.aggregate(block, F.lit(0.0), lambda a, x: a + x)


def log_one_hot(code: Column, k: int) -> Column:
    """log of a one-hot block with zeros clamped to 1e-30."""
    levels = F.sequence(F.lit(0), F.lit(k - 1))
    floor = F.lit(math.log(TINY))
    return bind(code, lambda c: F.transform(levels, lambda i: F.when(i == c, F.lit(0.0)).otherwise(floor)))


def log_sum_exp(block: Column) -> Column:
    def shifted(b: Column) -> Column:
        return bind(F.array_max(b), lambda top: top + F.ln(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.exp(x - top))))

    return bind(block, shifted)


def log_normalize(block: Column) -> Column:
    return bind(block, lambda b: bind(log_sum_exp(b), lambda z: F.transform(b, lambda x: x - z)))


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) of finite values."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
