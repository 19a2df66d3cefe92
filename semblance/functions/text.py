"""Text parsing and classification as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns and labels of the source data formats.
DIMS = r"^M(\d+(?:[.,]\d+)?)[xX](\d+(?:[.,]\d+)?)"
DIMS_PITCH = r"^[MØ]?(\d+(?:[.,]\d+)?)[xX]\d+[.,]\d+[xX](\d+(?:[.,]\d+)?)"
DIMS_PLAIN = r"^[MØ]?(\d+(?:[.,]\d+)?)[xX](\d+(?:[.,]\d+)?)"
DIGIT_LIKE = r"^[.,-]*[0-9][0-9.,-]*$"
DIGIT_LIKE_SPACED = r"^[., -]*[0-9][0-9., -]*$"
MAX_LENGTH = 500.0
KEYWORDS = ("özel", "ozel")
PROCESS_TOKENS = ("FT", "HT")
PROCESS_DEFAULT = "Belirsiz"
GRADE_EXACT = "OZEL"
GRADE_PREFIXES = ("OZEL+A", "OZEL+R", "OZEL+T")
OTHER = "Other"
MISSING = "Missing"


def parse_locale_number(c: Column, thousands: str = ".", decimal: str = ",") -> Column:
    """Text such as ``1.234,56`` to double; anything unparseable is null."""
    plain = F.replace(F.replace(F.trim(c), F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    return plain.try_cast("double")


def has_keyword(c: Column, words: Sequence[str] = KEYWORDS) -> Column:
    """True when the lower-cased text contains any word; null text is false."""
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return F.coalesce(hit, F.lit(False))


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.replace(F.regexp_extract(c, pattern, group), F.lit(","), F.lit(".")).try_cast("double")


def extract_dims_simple(c: Column) -> tuple[Column, Column]:
    """``M8x25,5`` to (8.0, 25.5); no match gives nulls."""
    return _number(c, DIMS, 1), _number(c, DIMS, 2)


def extract_dims_pitch(c: Column) -> tuple[Column, Column]:
    """Diameter and length, skipping a thread pitch (which has decimals).

    A length above 500 without a pitch is a parse error: diameter stays, length is null.
    """
    pitched = F.rlike(c, F.lit(DIMS_PITCH))
    plain_len = _number(c, DIMS_PLAIN, 2)
    size = F.when(pitched, _number(c, DIMS_PITCH, 1)).otherwise(_number(c, DIMS_PLAIN, 1))
    length = F.when(pitched, _number(c, DIMS_PITCH, 2)).when(plain_len <= MAX_LENGTH, plain_len)
    return size, length


def classify_token(c: Column, tokens: Sequence[str] = PROCESS_TOKENS, default: str = PROCESS_DEFAULT) -> Column:
    """First token that stands as a word after a blank; null text is the default."""
    up = F.upper(c)
    out = None
    for t in tokens:
        cond = F.contains(up, F.lit(f" {t} ")) | F.endswith(up, F.lit(f" {t}"))
        out = F.when(cond, t) if out is None else out.when(cond, t)
    return F.lit(default) if out is None else out.otherwise(default)


def simplify_size(c: Column, other: str = OTHER) -> Column:
    """Keep undotted M-series sizes, everything else is ``Other``."""
    v = F.trim(c)
    return F.when(F.startswith(v, F.lit("M")) & ~F.contains(v, F.lit(".")), v).otherwise(other)


def prefix_bucket(
    c: Column, exact: str = GRADE_EXACT, prefixes: Sequence[str] = GRADE_PREFIXES, other: str = OTHER
) -> Column:
    v = F.upper(F.trim(c))
    out = F.when(v == exact, exact)
    for p in prefixes:
        out = out.when(F.startswith(v, F.lit(p)), p)
    return out.otherwise(other)


def binary_target(c: Column, positive) -> Column:
    """1 for the positive literal, 0 for everything else (null included)."""
    return F.coalesce((c == F.lit(positive)).cast("int"), F.lit(0))
