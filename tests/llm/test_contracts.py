"""Contracts at the edges: ids of any size, letters of any script, column names of any kind, copies without id."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from semblance.llm.lang_id import fit_language_model, identify, letters
from semblance.llm.near_dedup import near_duplicates
from tests.llm.test_text_operators import PROSE, SF, docs

BIG = (1 << 62) + 3


def test_ids_of_any_size(spark):
    other = PROSE.replace("cat", "dog").replace("roof", "barn").replace("rain", "snow")
    rows = docs(spark, [(BIG, PROSE, None, None), (BIG + 10, PROSE, None, None), (-5, other, None, None), (BIG + 20, other, None, None), (None, PROSE, None, None), (None, "one two three four", None, None), (None, "one two three four", None, None), (BIG + 30, "x y z w", None, None)])
    got = sorted(((r.id or 0, r.component_id, r.kept) for r in near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(BIG, BIG, True), (BIG + 10, BIG, False), (-5, -5, True), (BIG + 20, -5, False), (0, BIG, False), (0, None, True), (0, None, True), (BIG + 30, BIG + 30, True)], key=repr)


def test_letters_of_any_script(spark):
    assert [letters(t) for t in ("½ ½", "² ³", "③", "१२", "́ ́", "Ⅷ", "🙂", None)] == [""] * 8
    assert letters("नमस्ते, दुनिया!") == "नमस्ते दुनिया" and letters("สวัสดี 5") == "สวัสดี" and letters("ªº µ½𝒳") == "ªº µ 𝒳"
    model = fit_language_model(spark.createDataFrame([(i, f"{PROSE} {i}", "en") for i in range(40)] + [(i, "नमस्ते दुनिया यह एक वाक्य है " * 3, "hi") for i in range(40, 80)], "id long, text string, lang string"))
    got = {r.id: r.lang_pred for r in identify(spark.createDataFrame([(1, "½ ½"), (2, "③"), (3, "दुनिया वाक्य"), (4, "the old roof")], "id long, text string"), model, keep=("id",)).collect()}
    assert got == {1: "und", 2: "und", 3: "hi", 4: "en"}


def test_stages_keep_columns_of_any_name(spark):
    odd = ["page url", "n-tok", "a.b", "tick`s", "Row", "ID", "mix_copy", "text2"]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    table = base.select("*", *[F.lit(7).alias(c) for c in odd], F.struct(F.lit(1).alias("in ner"), F.lit("x").alias("y.z")).alias("nested one"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert out.columns == ([c for c in table.columns if c != "mix_copy"] + ["mix_copy"] if name == "source_mix" else table.columns)
        assert out.count() > 0


def test_one_document_of_each_group_stays(spark):
    rows = [(None, PROSE, "en", "a")] * 4 + [(5, PROSE + " and so on for ever and a day after that", "en", "a")] * 3 + [(None, None, "en", "a")] * 2 + [(7, "", "en", "b"), (8, "", "en", "b")]
    out = corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), SF)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["5", "7", "8", "None", "None"]
    assert out.where(F.col("text") == PROSE).count() == 1
