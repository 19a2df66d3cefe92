"""Spelling variants against brute force: all pairs of small vocabularies, damage by checksum, chains of forms."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from semblance.llm.spelling_variants import FMIndex, best_near, counted_words, variant_groups


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(vocabulary: dict[str, int], ratio: int = 2) -> dict[str, tuple]:
    out = {}
    for w, n in vocabulary.items():
        near = sorted((-m, v) for v, m in vocabulary.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [n, len(near), form, vocabulary.get(form)]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def some_words(seed: int, letters: str, n: int, low: int, high: int) -> dict[str, int]:
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))): rnd.choice([3, 3, 4, 7, 20, 90]) for _ in range(n)}


def test_one_block_of_random_words():
    for seed, letters, low, high in ((1, "ab", 1, 7), (2, "abcé", 3, 6), (3, "aÿz", 1, 9)):
        vocabulary = some_words(seed, letters, 300, low, high)
        words = sorted(vocabulary)
        counts = [vocabulary[w] for w in words]
        near, best = collections.Counter(), {}
        for backward in (False, True):
            keys = [w[::-1] for w in words] if backward else words
            for w, k, n, form in best_near(FMIndex(keys), keys, counts, [*keys, "zzzzzzz"], backward):
                near[w] += k
                best[w] = min(best.get(w, (0, "")), (-n, form))
        want = brute(vocabulary)
        assert {w: near[w] for w in words} == {w: want[w][1] for w in words}
        for w in words:
            if want[w][2]:
                assert best[w][1] == want[w][2]


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_many_blocks(spark, block_words):
    vocabulary = some_words(4, "abcdeé", 1500, 4, 7) | {"x" * 3000: 5, "x" * 2999: 50, "x" * 1500 + "y" + "x" * 1500: 9}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert found(variant_groups(df, block_words=block_words)) == brute(vocabulary)


def test_ties_chains_and_odd_rows(spark):
    vocabulary = {"aaaaa": 1000, "aaaab": 400, "aaabb": 150, "aabbb": 60, "zaaab": 400, "qqqqq": 3, "qqqqp": 5, "ÿaaaa": 1000, "éaaaa": 5}
    rows = [(w, n - 1, "f") for w, n in vocabulary.items()] + [(w, 1, "f") for w in vocabulary] + [(None, 4, "f"), ("nulln", None, "f"), ("", 9, "f")]
    df = spark.createDataFrame(rows, "word string, n long, form string")
    got = found(variant_groups(df))
    assert got == brute(vocabulary)
    assert got["aabbb"][4] == "aaaaa" and got["aaaab"][2] == "aaaaa" and got["qqqqq"][2] is None
    assert variant_groups(df.where(F.lit(False))).count() == 0


def brute_counts(rows, damage=97):
    c = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            c[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def test_counts_with_damage(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, None), (None, "Éclair Straße straße STRASSE " * 40), (5, ""), (6, "wordy_wordy1wordy ×÷×÷×")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for damage in (97, 3):
        got = {r.word: r.n for r in counted_words(df, damage=damage).collect()}
        assert got == brute_counts(rows, damage)
    assert counted_words(df.where(F.lit(False))).count() == 0
