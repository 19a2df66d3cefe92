"""Small shared helpers: reshaping, size-checked lookups, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1_000
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def melt(df: DataFrame, cols: Sequence[str], keep: Iterable[str | Column] = (), name: str = "column") -> DataFrame:
    """Numeric columns to rows (name, value); nulls are dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in cols])
    keep = list(keep)
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())


def const_array(values: Sequence[float] | Sequence[int], kind: str) -> Column:
    """Literal array of numbers, sent as one text literal that the optimizer folds."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def report(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into a tidy report with one row per dict."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return df.select(F.inline(F.array(*structs)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="semblance-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files when an action on them ends: for frames with one action only."""
    was = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if was is None else spark.conf.set(RELEASE, was)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that later stages do not recompute and survive lost executors; its shuffle files are dropped once it is written."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        once = df.select("*")
    return once.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut_lineage`` made, once nothing reads it any more."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when df has at most ``limit`` rows; looks at no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when df has at most ``limit`` rows and ``size`` bytes of JSON text; looks at no more than limit + 1 rows."""
    text = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(limit + 1).select(text.alias("_b")).agg(F.count("*").alias("n"), F.sum("_b").alias("b")).first()
    return seen["n"] <= limit and (seen["b"] or 0) <= size


def pin(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Fitted table computed once: kept as a literal table up to ``limit`` rows, else checkpointed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return cut_lineage(df)
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema)


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int = BROADCAST_ROWS, how: str = "left") -> DataFrame:
    """Join with a table that is unique on ``on``.

    Up to ``limit`` rows and 64 MB the table is broadcast. Beyond that the keys that are hot in
    ``left`` (more than 1/1000 of its rows, hence fewer than 1000 keys) are joined by
    broadcast and only the cool rest is shuffled, so no single key fills one task. Rows with a
    null key match nothing and stay out of the shuffle.
    """
    on = list(on)
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), on, how)
    complete = F.lit(True)
    for c in on:
        complete = complete & F.col(c).isNotNull()
    nulls = left.where(~complete).join(F.broadcast(right.where(F.lit(False))), on, how)
    left = left.where(complete)
    sizes = left.groupBy(*on).agg(F.count("*").alias("_n"))
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.where(F.col("_n") > max(n // HOT_SHARE, 10_000)).select(*on, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    hot_part = marked.where("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(hot.drop("_hot")), on, "left_semi")), on, how)
    cool_part = marked.where("_hot is null").drop("_hot").join(right, on, how)
    out = hot_part.unionByName(cool_part)
    return out.unionByName(nulls) if how == "left" else out
