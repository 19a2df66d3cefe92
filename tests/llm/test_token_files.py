"""Token files: exact round trip against whole texts, order, bases, odd rows."""

from __future__ import annotations

import glob
import os
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from semblance.llm.queries import QUERIES
from semblance.llm.token_files import END_ID, Encoder, read_tokens, token_folder, write_tokens

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_query_against_whole_texts(spark):
    plain, at = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in QUERIES["op12_token_files"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in sorted((r.doc_id, r.text or "") for r in rows):
        ids = plain.encode(text, add_special_tokens=False).ids + [END_ID]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows(spark):
    long = "the quick " * 50_000 + "x" * 20_000
    rows = [(None, None), (None, "b a"), (None, "b a"), (2, ""), (2, " \n\t "), (1, "It's <|endoftext|> İΣ é ́x  y"), (3, long), (3, long)]
    docs = spark.createDataFrame([(i, t, "f", "p", "t") for i, t in rows], "doc_id long, text string, file string, place string, told string")
    for tokenizer, by_word in ((WORDS, True), (WORDS, False), (BYTES, False)):
        folder, plain = token_folder(spark), Tokenizer.from_file(tokenizer)
        write_tokens(docs, folder, tokenizer, by_word=by_word, keep=4)
        found = sorted((r.start, r.id, list(r.ids)) for r in read_tokens(spark, folder).collect())
        want = sorted(((i, [*plain.encode(t or "", add_special_tokens=False).ids, END_ID]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [x[1] for x in found] == [x[0] for x in want]
        assert sorted(map(repr, (x[1:] for x in found))) == sorted(map(repr, want))
        assert [x[0] for x in found] == list(np.cumsum([0, *[len(x[2]) for x in found]]))[:-1]
        # the files alone hold the ids on end
        flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted(glob.glob(f"{folder.removeprefix('file://')}/*.ids"))])
        assert list(flat) == [i for x in found for i in x[2]]
    empty = token_folder(spark)
    assert write_tokens(docs.where(F.lit(False)), empty, WORDS).count() == 0
    assert read_tokens(spark, empty).count() == 0
    assert not [f for f in os.listdir(empty.removeprefix("file://")) if f.endswith(".ids")]


def test_hot_id_spreads_and_wide_ids(spark):
    docs = spark.range(900).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text"))
    parts = write_tokens(docs, token_folder(spark), WORDS, end_id=70_000).collect()
    assert len(parts) > 4 and max(p.n_docs for p in parts) < 400
    assert {p.id_bytes for p in parts} == {4}


def test_word_cache_changes_nothing():
    import pyarrow as pa

    texts = pa.array(["a b c d e f", "", "f e d c  b a", "a"])
    small, whole = Encoder(WORDS, keep=2)(texts), Encoder(WORDS, by_word=False)(texts)
    assert [list(x) for x in small] == [list(x) for x in whole]
