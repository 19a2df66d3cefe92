"""LM scores: counts and base scores by brute force, normalisation over all words, no influence of partitions."""

from __future__ import annotations

from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.llm import lm_score
from semblance.llm.lang_id import held_out
from semblance.llm.lm_score import END_WORD, LogBilinear, contexts, count_words, lm_scores, normalisers, tokens, vocabulary

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by id."""
    train = Counter()
    for i, t in rows:
        if crc32(str(i).encode()) % 5 != 1:
            train.update([*tokens(t), END_WORD.encode()])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        words = [*tokens(t), END_WORD.encode()]
        base = sum(log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i] = (crc32(str(i).encode()) % 5 == 1, len(words), sum(train[w] > 0 for w in words), n, base)
    return out


@pytest.mark.parametrize("known", [65_536, 50])
def test_counts_and_base_scores_by_brute_force(spark, known, monkeypatch):
    monkeypatch.setattr(lm_score.vocabulary, "__defaults__", (lm_score.NAMED, lm_score.FORMS, known))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_001, None), (10_002, ""), (10_003, "neverseen words éé x"), (10_004, "UPPER upper \x0b tab\there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r.id: r for r in lm_scores(docs, trains=~held_out(F.col("doc_id"), 5)).collect()}
    assert len(got) == len(rows)
    for i, (held, n, known_words, total, base) in want.items():
        r = got[i]
        assert (not r.trains, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known_words, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and np.isfinite(r.score)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 60_000)  # several shards per round
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    runs = [lm_scores(docs.repartition(n), trains=~held_out(F.col("doc_id"), 5)).toPandas().sort_values("id") for n in (2, 64)]
    assert np.allclose(runs[0].score, runs[1].score, rtol=1e-5) and np.allclose(runs[0].base_score, runs[1].base_score)
    held = runs[0][~runs[0].trains]
    assert held.score.sum() > held.base_score.sum()


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b c a b d e f g"), (2, "a b a c zz yy xx ww vv uu")], "id long, text string")
    counts = count_words(docs)
    v = vocabulary(counts, named=4, forms=5)
    table = {r.word.encode(): r.n for r in counts.collect()}
    m = LogBilinear.start(v.class_counts)
    z = normalisers(spark, m)
    a, b = v.ids([b"a", b"uu"])
    p = np.exp((m.near[a] + m.far[b]) @ m.out.T + m.bias - z[a, b])
    assert abs(p.sum() - 1) < 1e-5 and len(p) == v.classes.first + 5
    share = np.zeros(len(p))
    for w, n in table.items():
        c = v.classes[w]
        share[c] += 1.0 if c < v.classes.first else (n + 0.5) / v.mass[c]
    share[v.classes.first :] += 0.5 / v.mass[v.classes.first :]  # one unseen word of each class
    assert np.allclose(share, 1)
    assert v.class_counts.sum() == v.total and list(contexts(v.ids([b"a"]))[0]) == [v.classes[b"a"], 0]


def test_rare_tokens_gain_too(spark):
    """The gain over the base on held-out texts, split by whether a word has a class of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = lm_scores(docs, trains=~held_out(F.col("doc_id"), 5)).where("NOT trains").toPandas()
    table = Counter(w for r in docs.where(~held_out(F.col("doc_id"), 5)).collect() for w in tokens(r.text))
    named = {w for w, _ in table.most_common(lm_score.NAMED)}
    share = {r.doc_id: np.mean([w not in named for w in tokens(r.text)] or [0.0]) for r in docs.collect()}
    out["rare"] = out.id.map(share)
    gain = (out.score - out.base_score) / out.n_tokens
    assert gain[out.rare > 0.5].mean() > 0 and gain.mean() > 0.02
