"""Named row layout: numeric columns, target, categories and their dictionary."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.arrays import argmax, one_hot
from semblance.operators.frames import cut_lineage, lookup, pin


@dataclass(frozen=True)
class Layout:
    """Order of dimensions in a hybrid row: numeric..., target, then one block per category."""

    numeric: tuple[str, ...]
    target: str | None = None
    categorical: tuple[str, ...] = ()
    cardinality: dict[str, int] = field(default_factory=dict)

    @property
    def dims(self) -> list[str]:
        """Numeric dimensions, target last."""
        return [*self.numeric, *([self.target] if self.target else [])]

    def offset(self, cat: str) -> int:
        """0-based start of a category block inside the hybrid row."""
        at = len(self.dims)
        for c in self.categorical:
            if c == cat:
                return at
            at += self.cardinality[c]
        raise KeyError(cat)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Layout:
        d = json.loads(text)
        return Layout(tuple(d["numeric"]), d["target"], tuple(d["categorical"]), d["cardinality"])


def fit_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, idx): idx is the 0-based rank of the value in text order.

    Distinct values are dealt out by range; ranks come from a window inside a range plus the sizes of
    the ranges before it, so a column of very many values fills no task.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    distinct = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(distinct.repartitionByRange(ranges, "column", "value").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("column", "_range").agg(F.count("*").alias("_n"))
    # at most columns + ranges rows
    starts = sizes.select("column", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("column", "_range").orderBy("value")
    rank = F.col("_start") + F.row_number().over(inside) - 1
    return pin(dealt.join(F.broadcast(starts), ["column", "_range"]).select("column", "value", rank.cast("int").alias("idx")))


def cardinalities(dictionary: DataFrame) -> dict[str, int]:
    return {r["column"]: r["k"] for r in dictionary.groupBy("column").agg((F.max("idx") + 1).alias("k")).collect()}


def label_encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], suffix: str = "_code", unseen: str = "error") -> DataFrame:
    """Add ``<col>_code``; an unseen value is an error (or null with ``unseen='null'``)."""
    out = df
    for c in cols:
        codes = dictionary.where(F.col("column") == c).select(F.col("value").alias(c), F.col("idx").alias(f"{c}{suffix}"))
        out = lookup(out.withColumn(c, F.col(c).cast("string")), codes, [c])
        if unseen == "error":
            code = F.col(f"{c}{suffix}")
            bad = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.coalesce(F.col(c), F.lit("null")))).cast("int")
            out = out.withColumn(f"{c}{suffix}", F.when(code.isNull(), bad).otherwise(code))
    return out


def label_decode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Replace ``<col>_code`` by the dictionary value."""
    out = df
    for c in cols:
        values = dictionary.where(F.col("column") == c).select(F.col("idx").alias(f"{c}{suffix}"), F.col("value").alias(c))
        out = lookup(out, values, [f"{c}{suffix}"]).drop(f"{c}{suffix}")
    return out


def assemble(df: DataFrame, layout: Layout, out: str = "hybrid", suffix: str = "_code", keep: Sequence[str] = ()) -> DataFrame:
    """Hybrid array [numeric..., target, one-hot blocks...] from named columns."""
    nums = F.array(*[F.col(c).cast("double") for c in layout.dims])
    blocks = [one_hot(F.col(f"{c}{suffix}"), layout.cardinality[c]) for c in layout.categorical]
    return df.select(*keep, F.concat(nums, *blocks).alias(out))


def block(hybrid: Column, layout: Layout, cat: str) -> Column:
    return F.slice(hybrid, layout.offset(cat) + 1, layout.cardinality[cat])


def disassemble(df: DataFrame, layout: Layout, hybrid: str = "hybrid", suffix: str = "_code", keep: Sequence[str] = ()) -> DataFrame:
    """Named columns back from a hybrid array; each block decodes to its first maximum."""
    h = F.col(hybrid)
    nums = [h[i].alias(c) for i, c in enumerate(layout.dims)]
    codes = [argmax(block(h, layout, c)).alias(f"{c}{suffix}") for c in layout.categorical]
    return df.select(*keep, *nums, *codes)
