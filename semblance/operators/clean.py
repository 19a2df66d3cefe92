"""Row filters and target parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.text import KEYWORDS, has_keyword, parse_locale_number


def filter_keywords(df: DataFrame, col: str, words: Sequence[str] = KEYWORDS) -> DataFrame:
    """Rows whose text holds any of the words, ignoring case; null text is dropped."""
    return df.where(has_keyword(F.col(col), words))


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def keep_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every listed column above zero (negative or zero marks an invalid reading)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > 0)
    return df.where(cond)


def parse_target(df: DataFrame, col: str) -> DataFrame:
    """Target as double (text is parsed as a locale number); rows without a target are dropped."""
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    value = parse_locale_number(F.col(col)) if is_text else F.col(col).cast("double")
    return df.withColumn(col, value).where(F.col(col).isNotNull())
