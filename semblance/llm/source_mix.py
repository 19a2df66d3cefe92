"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, packed, words

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKET_ROWS = 512
HASH_BITS = 60


def digest_bits(key: Column) -> Column:
    """60 hash bits of a key as a long, which SQL engines can recompute."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))


def size_class(size: Column) -> Column:
    """Sixteenths of an octave."""
    return F.floor(F.log2(size + F.lit(1.0)) * 16).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(source, source_size, target, rate, start): one row per source.

    Weights repeat over the sources in code point order, null last. The excess of sources that
    reach ``most`` times their size goes to the others by weight; in order of saturation that has a
    closed form, so two windows over the list of sources replace the rounds. The list of sources is
    the mix's own configuration and small beside the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", F.element_at(F.lit(list(weights)), place + 1).alias("weight"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = by.select("*", F.sum("source_size").over(total).alias("whole"), F.sum("weight").over(total).alias("weights"), F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum("weight").over(upto), F.lit(0)).alias("spent"))
    # what each unit of weight gets if exactly the sources before this one are full
    share = (F.col("whole") - most * F.col("before")).cast("double") / (F.col("weights") - F.col("spent")).cast("double")
    open_here = share * F.col("weight") <= (most * F.col("source_size")).cast("double")
    level = level.select("*", share.alias("share"), open_here.alias("open_here"))
    final = F.min(F.when(F.col("open_here"), F.struct("spent", "share"))).over(total)["share"]
    target = F.least(final * F.col("weight"), (most * F.col("source_size")).cast("double"))
    start = digest_bits(F.concat_ws(":", F.lit(seed), source_key())).cast("double") / F.lit(float(1 << HASH_BITS))
    level = level.select("source", "source_size", F.when(F.col("whole") > 0, target).otherwise(F.lit(0.0)).alias("target"), start.alias("start"))
    return level.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), "start")


def mix_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per input row: id, th, source, size, source_size, target, copies, taken.

    Size is the number of words (null: 0). Every document of a source expects target / source_size
    copies. The documents of a source stand in order of size class, hash of the id, id, size and
    text hash; their expected copies are summed up in that order, one random start per source is
    added, and a document is emitted once per integer that its step crosses. Ordering by size
    class stratifies, so the words taken come near the target though sizes differ much. Sources of
    no words and empty tables take nothing; null is a source of its own; equal rows are dealt like
    others and may get different copies. No row gets more than ``most`` copies, as no rate exceeds it.

    Prefix sums are in two steps: (source, class) is cut into ranges of the hash of about 512
    documents, counts of the ranges are summed up per source, and ranks inside a range come from a
    window over that range. So a source with a third of all rows fills no task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = packed(docs, ident, text)
    sizes = scratch.keep(base.select("id", "th", F.col("row")[source].alias("source"), F.size(words(F.col("text"))).cast("long").alias("size")))
    goals = source_targets(sizes, weights, most, seed)
    keyed = sizes.select("*", size_class(F.col("size")).alias("class"), digest_bits(F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("h"), source_key().alias("skey"))
    strata = keyed.groupBy("skey", "class").agg(F.count("*").alias("n")).select("skey", "class", F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("ranges"))
    strata = scratch.keep(strata)  # a table of its own, so that Spark can split the rows of a hot class
    cut = keyed.join(strata, ["skey", "class"]).withColumn("range", F.floor(F.col("h").cast("double") / F.lit(float(1 << HASH_BITS)) * F.col("ranges")).cast("long")).drop("ranges")
    cut = scratch.keep(cut)
    before = Window.partitionBy("skey").orderBy("class", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("skey", "class", "range").agg(F.count("*").alias("n"))
    offsets = ranges.select("skey", "class", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(goals.withColumn("skey", source_key()).drop("source"), "skey")
    inside = Window.partitionBy("skey", "class", "range").orderBy("h", F.col("id").asc_nulls_last(), "size", "th")
    ranked = cut.join(offsets, ["skey", "class", "range"]).select("*", (F.row_number().over(inside) + F.col("offset")).alias("rank"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("start")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("start"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return ranked.select("id", "th", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix itself: every input row as often as it is taken, with ``mix_copy`` from 1 in place of a column of that name."""
    base = packed(docs, ident, text)
    counts = mix_counts(docs, ident, text, **how).where("copies > 0").groupBy("id", "th").agg(F.array_sort(F.collect_list("copies")).alias("all_copies"))
    joined = base.join(counts, base["id"].eqNullSafe(counts["id"]) & (base["th"] == counts["th"])).select("row", base["id"], base["th"], "all_copies")
    # rows equal in id and text share a list of counts; each takes its own entry
    number = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(1)))
    return joined.select("row", F.element_at(F.concat("all_copies", F.array_repeat(F.lit(0).cast("long"), 1)), F.least(number, F.size("all_copies") + 1)).alias("copies")).where("copies > 0").select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix_copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy"))
