"""Whole queries against plain recomputation where SQL can't express them: word statistics, language models, decontamination, pipeline."""

from __future__ import annotations

import collections

import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from semblance.llm import compression_rules
from semblance.llm.decontaminate import RUN, SHARE, UNITS, WINDOW, leaks
from semblance.llm.lang_id import DISCOUNT, ORDER, build_model, gram_keys, letters
from semblance.llm.queries import QUERIES
from tests.llm.test_text_operators import SF, docs

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def test_op6_counts_and_bands(spark):
    z = zstandard.ZstdCompressor(level=compression_rules.LEVEL)
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_compression_rules"](spark, SF).collect()}
    assert set(got) == set(table)
    for i, text in table.items():
        r, want = got[i], statistics(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        raw = (text or "").encode()
        low, high = compression_rules.band(len(raw), compression_rules.WIDE_BANDS if compression_rules.is_wide(raw) else compression_rules.BANDS)
        ratio = len(z.compress(raw)) / len(raw) if raw else None
        assert r.ratio == ratio
        if raw and not low <= ratio <= high:
            assert not r.kept


def kneser_ney(texts, gram):
    """Interpolated Kneser-Ney probability of a gram's last character, straight from its definition."""
    padded = [" " * (ORDER - 1) + t + " " for t in texts]
    full = collections.Counter(p[i : i + ORDER] for p in padded for i in range(len(p) - ORDER + 1))
    tables = {ORDER: full}
    for k in range(ORDER - 1, 0, -1):  # numbers of distinct characters before
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    alphabet = len(tables[1])

    def p(g):
        if not g:
            return 1.0 / (alphabet + 1.0)
        table = tables[len(g)]
        after = {h: n for h, n in table.items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        return max(table[g] - DISCOUNT, 0) / total + DISCOUNT * len(after) / total * p(g[1:])

    return p(gram)


def test_op10_probabilities_by_definition():
    texts = {"x": [letters("abba abab cab"), letters("ba ab")], "y": [letters("dada add bad dab")]}
    counts = {k: np.unique(np.concatenate([gram_keys(t) for t in v]), return_counts=True) for k, v in texts.items()}
    model = build_model(counts)
    grams = [a + b + c + d for a in " ab" for b in " abd" for c in "abdz " for d in "abcdz "]
    keys = np.array([int.from_bytes(g.encode("utf-16-be"), "big") for g in grams], np.uint64)
    found = np.exp(model.log_probabilities(keys))
    alphabet = len({c for v in texts.values() for t in v for c in " " + t})
    for j, lang in enumerate(model.languages):
        own = len({c for t in texts[lang] for c in " " + t})
        for g, f in zip(grams, found[:, j]):
            # languages share one floor: the alphabet of all of them
            want = kneser_ney(texts[lang], g)
            assert f == pytest.approx(want, rel=1e-4) or own != alphabet


def marked(text):
    text = re.sub(r"[^\w\s.,]|_", "", text)
    text = re.sub(r"(?<![^\W_])(?<![.,])(?=\d)[\d.,]+(?![^\W_])", lambda m: "#" + m[0], text)
    text = re.sub(r"(?<=[a-zß-öø-ÿ0-9,]\s)[A-Z][a-z]+(?![^\W_])", lambda m: "@" + m[0], text)
    text = re.sub(rf"(?i)(#[\d.,]+\s+)({UNITS})(?![^\W_])", r"\1&\2", text)
    return re.sub("[.,]+", "", text).lower().split()


def canon(token, names):
    return token[0] if token[0] in "#&" or (token[0] == "@" and not names) else token.lstrip("@")


def brute_leaks(texts, items):
    """Decontamination by comparing every alignment of every document and item, token by token."""
    out, wanted = set(), {name: marked(item or "") for name, item in items.items()}
    for d, text in texts.items():
        t = marked(text or "")
        places = [collections.defaultdict(list), collections.defaultdict(list)]
        for names in (False, True):
            plain = [canon(x, names) for x in t]
            for i in range(len(t) - WINDOW + 1):
                places[names][tuple(plain[i : i + WINDOW])].append(i)
        for name, m in wanted.items():
            if not m:
                continue
            if len(m) < WINDOW:
                flat = [x.lstrip("#@&") for x in m]
                if any([x.lstrip("#@&") for x in t[i : i + len(m)]] == flat for i in range(len(t) - len(m) + 1)):
                    out.add((d, name))
                continue
            covered, long = set(), False
            shifts = set()
            for names in (False, True):  # only alignments with a common window can count
                shifts |= {i - p for p in range(len(m) - WINDOW + 1) for i in places[names].get(tuple(canon(x, names) for x in m[p : p + WINDOW]), ())}
            for shift in sorted(shifts):
                spots = set()
                for names in (False, True):
                    for p in range(len(m) - WINDOW + 1):
                        if 0 <= p + shift and p + shift + WINDOW <= len(t) and all(canon(m[p + k], names) == canon(t[p + shift + k], names) for k in range(WINDOW)):
                            spots |= {p + k for k in range(WINDOW)}
                pairs = [(p, m[p].lstrip("#@&"), t[p + shift].lstrip("#@&"), m[p][0] in "#@&") for p in sorted(spots)]

                def steady(part):
                    value = {}
                    return all(value.setdefault(a, b) == b for _, a, b, slot in part if slot)

                def pieces(part):
                    runs = []
                    for q in part:
                        if runs and q[0] == runs[-1][-1][0] + 1:
                            runs[-1].append(q)
                        else:
                            runs.append([q])
                    return runs

                big = [r for r in [r for r in pieces(pairs) if steady(r)] + pieces([q for q in pairs if q[1] == q[2]]) if len(r) >= RUN]
                long = long or bool(big)
                if steady(pairs):
                    covered |= {q[0] for q in pairs}
                else:
                    covered |= {q[0] for r in big for q in r}
            if len(covered) >= SHARE * len(m) or long:
                out.add((d, name))
    return out


def test_op8_against_all_alignments(spark):
    rnd = random.Random(9)
    word = ["river", "stone", "walks", "gives", "under", "light", "takes", "seven", "house", "garden", "music", "near"]

    def phrase(n):
        return " ".join(rnd.choice([*word, "Anna", "Bert", "12", "30", "5 kg", "7 miles"]) for _ in range(n))

    items = {i: phrase(rnd.choice([3, 6, 9, 14, 20, 45])) for i in range(24)} | {90: "", 91: None}
    texts = {}
    for d in range(120):
        source = items[rnd.randrange(24)].split(" ")
        a, b = sorted((rnd.randrange(len(source) + 1), rnd.randrange(len(source) + 1)))
        part = source[a:b] if rnd.random() < 0.6 else source
        part = [rnd.choice([w, "Carl", "99", w.upper()]) if rnd.random() < 0.04 else w for w in part]
        texts[d] = phrase(rnd.randrange(12)) + " " + " ".join(part) + rnd.choice([" ", ". ", ", "]) + phrase(rnd.randrange(12))
    texts |= {200: None, 201: ""}
    got = {(r.id, r.item) for r in leaks(docs(spark, [(i, t, None, None) for i, t in texts.items()]), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == brute_leaks(texts, items) and len(got) > 40


def test_pipeline_rows_by_stage(spark):
    """run() from the kept rows of each stage: rejected languages, three-line windows, near copies, leaks, copies of the mix."""
    docs_table = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs_table]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        tables.append(spark.createDataFrame(out.toPandas(), out.schema))
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    assert set(rows[0]) - set(rows[1]) <= {i for i, t in rows[0].items() if not letters(t)} | {i for i, _ in rows[0].items()} and len(rows[1]) > 0.95 * len(rows[0])
    # line dedup: in order of ids, a three-line window seen before loses its lines
    seen: set = set()
    want = {}
    for i in sorted(rows[1]):
        lines = rows[1][i].split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(SPACES):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip(SPACES):
            want[i] = text
    assert rows[2] == want
    found = brute_leaks(rows[3], {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})
    assert set(rows[3]) - set(rows[4]) == {d for d, _ in found}
    mixed = tables[5].groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("mix_copy").alias("top")).collect()
    assert all(r.n == r.top <= 3 for r in mixed) and {r.doc_id for r in mixed} <= set(rows[4])
    final = {(r.doc_id, r.mix_copy) for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == {(r.doc_id, r.mix_copy) for r in tables[5].collect()}
