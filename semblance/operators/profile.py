"""Column profiles, frequency tables, target reports and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.text import DIGIT_LIKE, DIGIT_LIKE_SPACED, parse_locale_number
from semblance.operators.frames import melt, report
from semblance.operators.ranks import exact_quantiles

# Name patterns and thresholds of the column rules.
DATE_NAMES = ("date", "tarih")
NUMERIC_MODE_EXCLUDED = ("id", "no", "numara", "kod", "tarih", "date")
FULL_MODE_EXCLUDED = ("id", "numara", "kod", "tarih", "date", "tanım", "malzeme")
TEXT_NUMBER_DISTINCT = 20
PARSE_SHARE = 0.5
NUMERIC_FILL = 0.3
FULL_FILL = 0.5
NUMERIC_DISTINCT = 10
DIGIT_SHARE = 0.8
CATEGORY_DISTINCT = 50


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Exact numbers of distinct non-null values of several columns.

    Rows become (column, value) cells that are made distinct with a partial aggregate first, so no row is
    copied once per column. Texts beyond 64 bytes, binaries and nested values go by their digest.
    """
    cells = []
    for i, c in enumerate(cols):
        v, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            text = (v + F.lit(0.0)).cast("string")  # one zero
        elif isinstance(kind, T.StringType):
            text = F.when(F.octet_length(v) <= 64, F.concat(F.lit("="), v)).otherwise(F.sha2(v, 256))
        elif isinstance(kind, T.BinaryType):
            text = F.sha2(v, 256)
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            text = F.when(v.isNotNull(), F.sha2(F.to_json(F.struct(v)), 256))
        else:
            text = v.cast("string")
        cells.append(F.struct(F.lit(i).alias("c"), text.alias("v")))
    if not cells:
        return {}
    found = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL").distinct().groupBy("c").agg(F.count("*").alias("n")).collect()
    sizes = {r["c"]: r["n"] for r in found}
    return {c: sizes.get(i, 0) for i, c in enumerate(cols)}


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Position, name, type, filled count, row count and distinct count of every column.

    ``approx`` takes the built-in sketch (5 % standard error) for the distinct counts; ``sketches.distinct_state`` keeps one to merge.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(f.name).alias(f"f{i}") for i, f in enumerate(fields)]]
    if approx:
        aggs += [F.approx_count_distinct(f.name).alias(f"d{i}") for i, f in enumerate(fields)]
    known = {} if approx else distinct_counts(df, df.columns)
    rows = [
        {
            "position": F.lit(i + 1), "column": F.lit(f.name), "type": F.lit(f.dataType.simpleString()),
            "non_null": F.col(f"f{i}"), "n_rows": F.col("n"), "n_distinct": F.col(f"d{i}") if approx else F.lit(known[f.name]).cast("bigint"),
        }
        for i, f in enumerate(fields)
    ]
    return report(df.agg(*aggs), rows)


def type_summary(df: DataFrame) -> DataFrame:
    """Per type: kind, number of columns, their names and how many cells are filled."""
    groups: dict[str, list[str]] = {}
    kinds = {}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        groups.setdefault(t, []).append(f.name)
        kinds[t] = kind_of(f.dataType)
    rows = [
        {
            "type": F.lit(t), "kind": F.lit(kinds[t]), "n_columns": F.lit(len(names)).cast("bigint"),
            "columns": F.lit(",".join(names)), "n_values": sum((F.col(c) for c in names[1:]), F.col(names[0])),
        }
        for t, names in groups.items()
    ]
    return report(df.agg(*[F.count(c).alias(c) for c in df.columns]), rows)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, max and missing count per numeric column, in one pass."""
    cols = list(cols or [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = [
        {"column": F.lit(c), "count": F.col(f"c{i}"), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}"),
         "min": F.col(f"l{i}"), "max": F.col(f"h{i}"), "missing": F.col("n") - F.col(f"c{i}")}
        for i, c in enumerate(cols)
    ]
    return report(df.agg(*aggs), rows)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of every non-null value of one column."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("count"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column with their percent of all rows (nulls included)."""
    n = df.count()
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("count"))
    # the limit on the rank lets Spark drop all but k rows of a column before the window's shuffle
    first = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    ranked = counts.withColumn("_rank", first).where(F.col("_rank") <= k)
    return ranked.select("column", "value", "count", (F.col("count") * 100.0 / F.lit(n)).alias("percent"))


def missing_report(df: DataFrame, k: int = 15) -> DataFrame:
    """Columns with nulls, most nulls first; ``n_more`` says how many columns are beyond the first k."""
    tall = report(
        df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]),
        [{"column": F.lit(c), "n_missing": F.col(c), "percent": F.try_divide(F.col(c) * 100.0, F.col("_n"))} for c in df.columns],
    ).where("n_missing > 0")
    # tall has one row per column of the schema, so an unpartitioned window is bounded
    every = Window.partitionBy(F.lit(0))
    tall = tall.withColumn("n_more", F.greatest(F.count("*").over(every) - k, F.lit(0)))
    return tall.orderBy(F.desc("n_missing"), "column").limit(k)


def head_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First n rows by a stated key."""
    return df.orderBy(*order).limit(n)


def target_stats(df: DataFrame, col: str) -> DataFrame:
    """Count, missing, min, max, mean, exact median and sample std of the target."""
    median = exact_quantiles(df, [col], [0.5])[col][0]
    v = F.col(col).cast("double")
    return df.agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_samp(v).alias("std"),
    )


def target_percentiles(df: DataFrame, col: str, percents: Sequence[int] = (10, 25, 50, 75, 90, 95)) -> DataFrame:
    """Exact percentiles of the target, one row each."""
    vals = exact_quantiles(df, [col], [p / 100 for p in percents])[col]
    return df.sparkSession.createDataFrame(list(zip([int(p) for p in percents], vals)), "percent int, value double")


def fill_report(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Filled count and percent of each named target column, or NOT FOUND."""
    there = [c for c in targets.values() if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in dict.fromkeys(there)])
    rows = []
    for name, c in targets.items():
        ok = c in df.columns
        rows.append({
            "target": F.lit(name), "column": F.lit(c), "status": F.lit("found" if ok else "NOT FOUND"),
            "filled": F.col(c) if ok else F.lit(None).cast("bigint"),
            "percent": F.try_divide(F.col(c) * 100.0, F.col("_n")) if ok else F.lit(None).cast("double"),
        })
    return report(agg, rows)


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson r of each feature with the target over pairwise complete rows, one pass."""
    y = F.col(target).cast("double")
    agg = df.agg(*[F.corr(F.when(y.isNotNull(), F.col(c).cast("double")), F.when(F.col(c).isNotNull(), y)).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    return report(agg, [{"column": F.lit(c), "r": F.col(f"r{i}")} for i, c in enumerate(cols)])


def target_by_category(df: DataFrame, cat: str, target: str, k: int | None = None) -> DataFrame:
    """Mean, sample std and count of the target per category, most frequent first."""
    v = F.col(target).cast("double")
    out = (
        df.where(F.col(cat).isNotNull()).groupBy(F.col(cat).cast("string").alias("category"))
        .agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count"))
    )
    ordered = out.orderBy(F.desc("count"), "category")
    return ordered.limit(k) if k else ordered


def extraction_coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many rows gave a value for each extracted column, with its range."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
    rows = [
        {"column": F.lit(c), "parsed": F.col(f"c{i}"), "percent": F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")),
         "min": F.col(f"l{i}").cast("double"), "max": F.col(f"h{i}").cast("double")}
        for i, c in enumerate(cols)
    ]
    return report(df.agg(*aggs), rows)


def compare_splits(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, mean and sample std of each column, train beside test."""
    both = melt(train, cols, [F.lit("train").alias("split")]).unionByName(melt(test, cols, [F.lit("test").alias("split")]))
    tall = both.groupBy("column").pivot("split", ["train", "test"])
    return tall.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
                    F.stddev_samp("value").alias("std"))


def _text_rates(df: DataFrame, cols: Sequence[str], pattern: str, sample: tuple[str, int] | None) -> dict[str, tuple[int, int]]:
    """(non-null, digit-like) per text column, over all rows or the first rows by a key."""
    if not cols:
        return {}
    if sample is None:
        row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.count_if(F.rlike(F.col(c), F.lit(pattern))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return {c: (row[f"n{i}"], row[f"m{i}"]) for i, c in enumerate(cols)}
    key, n = sample
    out = {}
    for c in cols:
        first = df.where(F.col(c).isNotNull()).orderBy(key).limit(n)
        row = first.agg(F.count(c).alias("n"), F.count_if(F.rlike(F.col(c), F.lit(pattern))).alias("m")).first()
        out[c] = (row["n"], row["m"])
    return out


def infer_kinds(df: DataFrame, sample: tuple[str, int] | None = None) -> DataFrame:
    """Semantic kind per column: date by name, numeric by type, ``numeric*`` for numbers kept as text.

    ``sample=(key, 10)`` looks at the first ten non-null values by key instead of all.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rates = _text_rates(df, text, DIGIT_LIKE, sample)
    known = distinct_counts(df, df.columns)
    rows = []
    for i, f in enumerate(df.schema.fields):
        low, d = f.name.lower(), F.lit(known[f.name]).cast("bigint")
        if any(p in low for p in DATE_NAMES):
            kind = F.lit("date")
        elif isinstance(f.dataType, T.NumericType):
            kind = F.lit("numeric")
        elif f.name in rates:
            n, m = rates[f.name]
            kind = F.when(F.lit(n == m) & (d > TEXT_NUMBER_DISTINCT), "numeric*").otherwise("categorical")
        else:
            kind = F.lit(f.dataType.simpleString())
        rows.append({"position": F.lit(i + 1), "column": F.lit(f.name), "kind": kind,
                     "filled_percent": F.try_divide(F.col(f"f{i}") * 100.0, F.col("n")), "n_distinct": d})
    return report(df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"f{i}") for i, c in enumerate(df.columns)]), rows)


def select_columns(df: DataFrame, target: str, mode: str = "full", sample: tuple[str, int] | None = None) -> DataFrame:
    """Decision table (column, decision, reason) for the numeric-only or the full preparation."""
    if mode not in ("numeric", "full"):
        raise ValueError("mode is 'numeric' or 'full'")
    fields = [f for f in df.schema.fields if f.name != target]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    digit = _text_rates(df, text, DIGIT_LIKE_SPACED, sample) if mode == "full" else {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.count(f.name).alias(f"f{i}"))
        if mode == "numeric" and f.name in text:
            aggs.append(F.count(parse_locale_number(F.col(f.name))).alias(f"p{i}"))
    known = distinct_counts(df, [f.name for f in fields]) if mode == "full" else {}
    rows = []
    for i, f in enumerate(fields):
        low = f.name.lower()
        names = NUMERIC_MODE_EXCLUDED if mode == "numeric" else FULL_MODE_EXCLUDED
        hit = next((p for p in names if p in low), None)
        fill = F.col(f"f{i}") / F.col("n")
        if hit:
            decision, reason = F.lit("drop"), F.lit(f"name contains {hit}")
        elif mode == "numeric":
            if isinstance(f.dataType, T.NumericType):
                ok, why = fill >= NUMERIC_FILL, F.lit("numeric type")
            elif f.name in text:
                rate = F.col(f"p{i}") / F.col("n")
                ok, why = (rate > PARSE_SHARE) & (rate >= NUMERIC_FILL), F.lit("parseable text")
            else:
                ok, why = F.lit(False), F.lit("not numeric")
            decision = F.when(ok, "numeric").otherwise("drop")
            reason = F.when(ok, why).otherwise("not numeric or too empty")
        else:
            d = F.lit(known[f.name])
            if isinstance(f.dataType, T.NumericType):
                kind = F.when(d > NUMERIC_DISTINCT, "numeric").otherwise("categorical")
            elif f.name in text:
                n, m = digit[f.name]
                like = F.lit(m > n * DIGIT_SHARE)
                kind = (F.when(like & (d > TEXT_NUMBER_DISTINCT), "numeric")
                        .when(d <= CATEGORY_DISTINCT, "categorical").otherwise("drop"))
            else:
                kind = F.lit("drop")
            decision = F.when(fill < FULL_FILL, "drop").otherwise(kind)
            reason = (F.when(fill < FULL_FILL, "too empty").when(kind == "drop", "no usable type")
                      .otherwise("kept"))
        rows.append({"column": F.lit(f.name), "decision": decision, "reason": reason})
    return report(df.agg(*aggs), rows)


__all__ = [
    "compare_splits", "corr_with_target", "describe_numeric", "distinct_counts", "extraction_coverage", "fill_report", "head_rows",
    "infer_kinds", "kind_of", "missing_report", "profile_columns", "select_columns", "target_by_category",
    "target_percentiles", "target_stats", "top_values", "type_summary", "value_counts",
]
