"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import map_texts

ORDER = 4
DISCOUNT = 0.75
SAMPLE = 2_000
CALIBRATE = 0.2
LANGUAGES = 100
GRAMS = 200_000
GAP_SHARE, LONE_GAP, DEVIATIONS = 0.75, 2.0, 6.0
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """By Unicode category: characters that plain regex classes take wrongly, and runs of neither letters nor marks after a letter."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))

    def ranges(kind: str) -> str:
        return "".join(f"{chr(m.start())}-{chr(m.end() - 1)}" for m in re.finditer(f"{kind}+", kinds))

    marks, known = ranges("M"), ranges("[LM]")
    wrong = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl"))
    # one class of the basic plane is a table look-up; characters beyond it always take the second pattern
    odd = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "M") + "".join(c for c in wrong if c < "\U00010000")
    return re.compile(f"[{odd}]"), re.compile(f"(?:[^{known}]|(?<![{known}])[{marks}]+)+")


def letters(text: str | None) -> str:
    """Lower-cased letters, with the marks that follow them, and single spaces between; empty if there are none."""
    text = text or ""
    if not text.isascii():
        odd, other = _patterns()
        if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) or odd.search(text):
            return other.sub(" ", text).strip().lower()
    return _OTHER.sub(" ", text).strip().lower()


def gram_keys(text: str) -> np.ndarray:
    """Packed character 4-grams of letters(): one for each character, spaces before the first."""
    units = np.frombuffer((" " * (ORDER - 1) + text + " ").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    n = len(units) - ORDER + 1
    keys = units[:n].copy()
    for k in range(1, ORDER):
        keys = (keys << np.uint64(16)) | units[k : k + n]
    return keys


def _tail(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of packed grams."""
    return keys & np.uint64((1 << 16 * order) - 1) if order < 4 else keys


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class LanguageModel:
    """Per order: sorted grams with log probabilities, sorted contexts with log back-off weights, by language."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    gap: float = LONE_GAP
    sharpness: float = 8.0

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """One row per gram, one column per language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            part = _tail(keys[left], order)
            at, hit = _find(self.grams[order - 1], part)
            out[left[hit]] += self.logp[order - 1][at[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            at, hit = _find(self.contexts[order - 1], part >> np.uint64(16))
            out[left[hit]] += self.backoff[order - 1][at[hit]]
        out[left] += self.floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of letters() texts in each language, and their numbers of characters; none may be empty."""
        ce, sizes = [], []
        for t in texts:
            total, n = np.zeros(len(self.languages)), 0
            keys = gram_keys(t)
            for i in range(0, len(keys), _PIECE):
                piece = self.log_probabilities(keys[i : i + _PIECE])
                total, n = total - piece.sum(axis=0, dtype=np.float64), n + len(piece)
            ce.append(total / n), sizes.append(n)
        return np.array(ce).reshape(-1, len(self.languages)), np.array(sizes)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=values, minlength=len(unique))


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> LanguageModel:
    """From counts of packed 4-grams by language.

    Counts of lower orders are numbers of distinct characters before the gram. Each order takes
    ``discount`` from every count and gives it to the next lower one, down to a uniform floor.
    """
    languages = sorted(counts)
    typed: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for name in languages:
        keys, n = counts[name]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        typed[ORDER - 1].append((keys, n))
        for k in range(ORDER - 1, 0, -1):
            keys, n = _grouped(_tail(keys, k), np.ones(len(keys)))
            typed[k - 1].append((keys, n))
    alphabet = len(np.unique(np.concatenate([k for k, _ in typed[0]])))
    floor = -np.log(alphabet + 1.0)
    grams, probs, contexts, backoff = [], [], [], []
    for k in range(ORDER):
        mine = np.unique(np.concatenate([x for x, _ in typed[k]]))
        ctx = np.unique(mine >> np.uint64(16))
        p, g = np.zeros((len(mine), len(languages))), np.ones((len(ctx), len(languages)))
        for j, (keys, n) in enumerate(typed[k]):
            own, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, weights=n), np.bincount(at)
            g[np.searchsorted(ctx, own), j] = discount * kinds / total
            p[np.searchsorted(mine, keys), j] = np.maximum(n - discount, 0) / total[at]
        lower = np.exp(floor) if k == 0 else probs[k - 1][np.searchsorted(grams[k - 1], _tail(mine, k))]
        p += g[np.searchsorted(ctx, mine >> np.uint64(16))] * lower
        grams.append(mine), probs.append(p), contexts.append(ctx), backoff.append(g)
    return LanguageModel(languages, grams, [np.log(p).astype(np.float32) for p in probs], contexts, [np.log(g).astype(np.float32) for g in backoff], float(floor))


def sampled(labelled: DataFrame, per_language: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text, calibrates): about ``per_language`` rows of each of the ``languages`` most frequent ones, by hash."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return labelled.select("lang", "text", F.lit(False).alias("calibrates")).limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["n"]))])
    bits = F.xxhash64("id", "text")
    draw = F.shiftrightunsigned(bits, 33) / F.lit(float(1 << 31))
    side = bits.bitwiseAND(F.lit((1 << 20) - 1)) / F.lit(float(1 << 20))
    return labelled.where(draw < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text", (side < CALIBRATE).alias("calibrates"))


def fit_language_model(labelled: DataFrame, per_language: int = SAMPLE, languages: int = LANGUAGES, grams: int = GRAMS) -> LanguageModel | None:
    """From (id, text, lang); None without a labelled letter.

    The classifier is fitted on a documented bounded sample: at most ``languages`` languages, about
    ``per_language`` whole texts of each by hash, and the ``grams`` most frequent 4-grams of each. A
    fifth of the sample is held aside to calibrate confidence and rejection.
    """
    rows = sampled(labelled, per_language, languages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = [x for x in map(letters, part["text"]) if x]
                if texts:
                    keys, n = np.unique(np.concatenate([gram_keys(x) for x in texts]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    counted = rows.where("NOT calibrates AND text IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    table = counted.withColumn("rank", rank).where(F.col("rank") <= grams).select("lang", "gram", "n").toPandas()
    if not len(table):
        return None
    model = build_model({k: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for k, g in table.groupby("lang")})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(lang, x) for lang, x in zip(pdf["lang"], map(letters, pdf["text"]), strict=True) if x]
            if pairs:
                ce, n = model.cross_entropies([x for _, x in pairs])
                yield pd.DataFrame({"lang": [x for x, _ in pairs], "ce": ce.tolist(), "n": n})

    aside = rows.where("calibrates AND text IS NOT NULL").select("lang", "text").mapInPandas(measure, "lang string, ce array<double>, n long").toPandas()
    calibrate(model, aside)
    return model


def calibrate(model: LanguageModel, aside: pd.DataFrame) -> None:
    """Mean and spread of a language's own cross-entropies, mean gap to the next language, and the sharpness with the least log loss."""
    size = len(model.languages)
    ce = np.array(aside["ce"].tolist()).reshape(-1, size)
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in aside["lang"]], int)
    n = aside["n"].to_numpy()
    ce, n, own = ce[own >= 0], n[own >= 0], own[own >= 0]
    self_ce = ce[np.arange(len(own)), own] if len(own) else np.empty(0)
    mean, spread = np.full(size, np.median(self_ce) if len(own) else np.inf), np.zeros(size)
    for j in range(size):
        mine = own == j
        if mine.any():
            mean[j] = np.average(self_ce[mine], weights=n[mine])
            spread[j] = np.sqrt(np.mean((self_ce[mine] - mean[j]) ** 2 * n[mine]))
    model.mean, model.spread = mean, spread
    if len(own) and size > 1:
        model.gap = float(np.mean(np.partition(ce, 1, axis=1)[:, 1] - self_ce))
    if len(own):
        def loss(s):
            z = -s * (ce - ce.min(axis=1, keepdims=True))
            return np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own])
        model.sharpness = min(SHARPNESS, key=loss)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with lang_pred, score, cross_entropy and rejected, by whole texts only.

    The language with the least cross-entropy per character wins; equal ones go to the first by
    name. score is its share of the languages' sharpened likelihoods per character, the sharpness
    being calibrated. rejected: the cross-entropy exceeds that of the held-aside texts of this
    language by three quarters of their mean gap to the next language and six deviations for its
    length, so a text mixed of learned languages is kept. Null texts and those without a letter
    are `und`, score 0, rejected; so is everything if nothing could be learned.
    """
    names = ("lang_pred", "score", "cross_entropy", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            clean = [letters(t) for t in texts]
            out = [(UNKNOWN, 0.0, None, True)] * len(clean)
            some = [i for i, t in enumerate(clean) if t] if m else []
            if some:
                ce, n = m.cross_entropies([clean[i] for i in some])
                best = ce.argmin(axis=1)
                least = ce[np.arange(len(some)), best]
                score = 1 / np.exp(-m.sharpness * (ce - least[:, None])).sum(axis=1)
                limit = m.mean[best] + GAP_SHARE * m.gap + DEVIATIONS * m.spread[best] / np.sqrt(n)
                for i, b, s, c, r in zip(some, best, score, least, least > limit, strict=True):
                    out[i] = (m.languages[b], float(s), float(c), bool(r))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            return {x: pa.array([r[i] for r in out], kinds[i]) for i, x in enumerate(names)}

        return work

    return map_texts(docs.select(*keep, F.col(text).alias("text")), make, "lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(ident: Column, parts: int) -> Column:
    """crc32 of the id as text leaves remainder 1; false for a null id."""
    return F.coalesce(F.crc32(ident.cast("string")) % parts == 1, F.lit(False))
