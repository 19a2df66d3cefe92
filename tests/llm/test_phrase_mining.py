"""Phrase mining against brute force: counts over many shards and ranges, scores, covered phrases, transducers."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semblance.llm import phrase_mining
from semblance.llm.phrase_mining import CountTransducer, border_places, names, phrase_counts, phrase_scores, summed, top_phrases, united, word_stream


def brute_counts(rows):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i : i + m])] += 1
    return f, {k: v for k, v in n.items() if v}


def brute_scores(rows, least):
    f, n = brute_counts(rows)
    out = {}
    for (lang, p), a in f.items():
        w = p.split(" ")
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        held = any(b >= a and lang == other and len(q.split(" ")) > len(w) and f" {p} " in f" {q} " for (other, q), b in f.items() if b >= least)
        out[lang, p] = (len(w), a, k, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score, not held)
    return out


def corpus(seed=5, docs=60):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "a", "naïve", "x-y", "Über", "data\x01", "rain", "falls", "on", "new", "york", "ÄB", "z"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 120)):
            words.append(rnd.choice(["new york", "the rain falls on new york", *vocab, *vocab]) + rnd.choice(["", "", "", "", ",", ".", "\n", " \t", "\x0b", "!? "]))
        rows.append((rnd.choice(["en", "en", "de", None]), " ".join(words)))
    return rows + [(None, None), ("en", ""), ("fr", " .,\n"), ("en", "the rain " * 3000), ("und", "new york")] * 2


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, f long, phrase string")


@pytest.mark.parametrize("range_windows", [1_500_000, 300])
def test_counts(spark, range_windows, monkeypatch):
    rows = corpus()
    f, n = brute_counts(rows)
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(phrase_mining, "SHARD_WINDOWS", 500)
    got = phrase_counts(frame(spark, rows), least=4, range_windows=range_windows).collect()
    assert {(r.lang, r.phrase): r.f for r in got if r.n_words} == {k: v for k, v in f.items() if v >= 4}
    assert {r.lang: r.f for r in got if not r.n_words} == n
    assert len({(r.lang, r.phrase, r.n_words) for r in got}) == len(got)


@pytest.mark.parametrize("range_phrases", [100_000, 130])
def test_scores(spark, range_phrases):
    rows = corpus(6)
    want = brute_scores(rows, 5)
    scores = phrase_scores(frame(spark, rows), least=5, range_phrases=range_phrases)
    got = {(r.lang, r.phrase): tuple(r)[2:] for r in scores.collect()}
    assert got == want
    for top, bucket in ((2_000, 100_000), (7, 20)):
        ranks = [(r.lang, r.rank, r.phrase) for r in top_phrases(scores, top, bucket).collect()]
        order = collections.defaultdict(list)
        for (lang, p), x in want.items():
            if x[-1]:
                order[lang].append((-x[6], -x[1], p.encode()))
        assert sorted(ranks) == sorted((lang, i + 1, p.decode()) for lang, v in order.items() for i, (_, _, p) in enumerate(sorted(v)[:top]))


def test_empty_table(spark):
    assert top_phrases(phrase_scores(frame(spark, corpus()).where(F.lit(False)))).count() == 0


def test_large_products_stay_exact(spark):
    """Counts whose products pass 64 bits, through the same expression."""
    a, n, left, right = 10**13 + 7, 10**14 + 9, 10**13 + 8, 10**13 + 11
    got = spark.sql(f"SELECT (cast({1000 * a} AS decimal(19,0)) * cast({n} AS decimal(18,0))) div (cast({left} AS decimal(18,0)) * cast({right} AS decimal(18,0))) AS s").first().s
    assert got == 1000 * a * n // (left * right)


def test_transducer_round_trip_union_and_prefixes():
    rnd = np.random.default_rng(3)
    words, two = names(sorted({f"w{i}" for i in range(30)} | {"é", "\x01"})), names(["de", "en"])

    def some(n):
        p = np.zeros((n, 6), np.int32)
        p[:, 0] = rnd.integers(1, 3, n)
        for j in range(1, 6):
            p[:, j] = np.where((j == 1) | (p[:, j - 1] > 0), rnd.integers(j > 1 and 0 or 1, len(words) + 1, n), 0)
        return summed(p, rnd.integers(1, 4, n))

    parts = [CountTransducer.unpack(CountTransducer(two, words, *some(n)).pack()) for n in (4000, 1, 700)]
    for t in parts:
        again = CountTransducer(two, words, *t.paths())
        assert [x.tolist() for layer in t.layers for x in layer] == [x.tolist() for layer in again.layers for x in layer]
    langs, known, paths, weight = united([(t.langs, t.words, *t.paths()) for t in parts])
    want = collections.Counter()
    for t in parts:
        for p, w in zip(*(x.tolist() for x in t.paths())):
            want[(t.langs[p[0] - 1].as_py(), *(t.words[i - 1].as_py() if i else "" for i in p[1:]))] += w
    text = [(langs[p[0] - 1].as_py(), *(known[i - 1].as_py() if i else "" for i in p[1:])) for p in paths.tolist()]
    assert dict(zip(text, weight.tolist())) == dict(want) and text == sorted(text)
    whole = CountTransducer(langs, known, paths, weight)
    assert sum(len(layer[1]) for layer in whole.layers) < sum(len(np.unique(paths[:, : d + 1], axis=0)) for d in range(6))
    sums = collections.Counter()
    for p, w in want.items():
        for k in range(1, 7):
            sums[p[:k]] += w
    found = whole.prefixes(paths)
    assert all(found[i, k - 1] == sums[t[:k]] for i, t in enumerate(text) for k in range(1, 7))
    borders = sorted({text[7], text[500], ("de", "w0zz", "", "", "", ""), ("aa", "", "", "", "", ""), ("zz", "", "", "", "", "")})
    assert border_places(borders, langs, known, paths) == [sum(t < b for t in text) for b in borders]


def test_word_stream_of_a_slice():
    texts = pa.array(["zz", "A b\tC.d", None, "", " é  É,", "x"])
    for part in (texts, texts.slice(1, 4)):
        words, piece, text = word_stream(part)
        want = [(w, i) for i, t in enumerate(part.to_pylist()) for w in re.findall(r"[^\s.,]+", (t or "").replace("A", "a").replace("C", "c"))]
        assert list(zip(words.to_pylist(), text.tolist())) == want
        assert len(set(zip(piece.tolist(), text.tolist()))) == len(set(piece.tolist()))
