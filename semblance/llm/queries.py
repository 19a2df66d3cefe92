"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm import oracle
from semblance.llm.compression_rules import quality_rules
from semblance.llm.decontaminate import leaks
from semblance.llm.lang_id import fit_language_model, held_out, identify
from semblance.llm.license_scan import license_scan
from semblance.llm.line_dedup import line_dedup
from semblance.llm.lm_score import lm_scores
from semblance.llm.near_dedup import near_duplicates
from semblance.llm.phrase_mining import phrase_scores, top_phrases
from semblance.llm.secret_scan import BASE_RULES, secret_scan
from semblance.llm.source_mix import mix_counts
from semblance.llm.spelling_variants import counted_words, variant_groups
from semblance.llm.token_files import token_digests, token_folder, write_tokens
from semblance.llm.url_filter import url_filter
from semblance.plans.registry import table

__all__ = ["ORACLE", "QUERIES"]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("clean_text").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.size("covered").cast("long").alias("n_removed"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["dice"].alias("dice"), h["license"].alias("license"))))
    return out.select(F.col("id").alias("doc_id"), F.size("hits").cast("long").alias("n_hits"), best["license"].alias("license"), best["dice"].alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_counts(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The block list of the query: URLs of pages on hosts that advertise (a name part of the host)."""
    return pages.select("url").where(F.col("url").rlike(r"^[a-z]+://([^/?#]*\.)?(spam-farm|cheap-pills)\."))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(pages, listed_urls(pages))
    return out.select("row.page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    return out.select(F.col("id").alias("doc_id"), *[number(r.kind) for r in BASE_RULES], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op6_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "share", F.col("covered_tokens").cast("long").alias("covered_tokens"), "same_slots")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scores(docs, trains=~held_out(F.col("doc_id"), 5))
    return out.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where(~held_out(F.col("doc_id"), 3) & F.col("lang").isNotNull())
    model = fit_language_model(learn.withColumnRenamed("doc_id", "id"))
    out = identify(docs, model, keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(phrase_scores(table(spark, sf_dir, "documents").select("lang", "text")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_folder(spark)
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, folder).withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variant_groups(counted_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_license_scan, op3_source_mix, op4_url_filter, op5_secret_scan, op6_compression_rules, op7_near_dedup, op8_decontaminate, op9_lm_score, op10_language_id, op11_phrase_mining, op12_token_files, op13_spelling_variants,
)}
ORACLE: dict[str, str] = dict(oracle.SQL)
