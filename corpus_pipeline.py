"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, packed, same_key
from semblance.llm.decontaminate import leaks
from semblance.llm.lang_id import fit_language_model, held_out, identify
from semblance.llm.line_dedup import line_dedup
from semblance.llm.near_dedup import near_duplicates
from semblance.llm.source_mix import mixed_rows

#: Near-duplicate stage: five-word shingles, 100 * intersection >= 80 * union.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: null or letterless texts, and texts that fit no learned language."""
    learn = docs.where(~held_out(F.col("doc_id"), 3) & F.col("lang").isNotNull())
    model = fit_language_model(learn.select(F.col("doc_id").alias("id"), "text", "lang"))
    judged = identify(docs.select(F.struct("*").alias("row"), "text"), model, keep=("row",))
    return judged.where("NOT rejected").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows; n_chars follows; documents that lose every word go."""
    out = line_dedup(docs).where((F.size("covered") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.size("covered") > 0
    text, n_chars = F.col("clean_text"), F.when(changed, F.char_length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, once where it is told several times."""
    found = Scratch(spark).keep(near_duplicates(docs, size=SHINGLE, percent=PERCENT).groupBy("id", "th").agg(F.first("kept").alias("kept"), F.count("*").alias("n")))
    base = packed(docs, "doc_id", "text")
    gone, again = found.where("NOT kept").select("id", "th"), found.where("kept AND n > 1").select("id", "th")
    left = base.join(gone, same_key(base, gone), "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, same_key(left, again), "left_semi").groupBy("id", "th").agg(F.first("row").alias("row"))
    return left.join(again, same_key(left, again), "left_anti").select("row.*").unionByName(once.select("row.*"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("id", "th").distinct()
    base = packed(docs, "doc_id", "text")
    return base.join(found, same_key(base, found), "left_anti").select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with mix_copy from 1."""
    return mixed_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("source_mix", mix_stage),
]
#: SQL can't express the language models and the near-duplicate groups; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
