"""LM scoring: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log10
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, map_texts, same_key

#: Frequent words that are classes of their own, and classes of all other words by their last letters.
NAMED, FORMS, FORM_BYTES = 768, 512, 3
KNOWN = 65_536
DIM = 32
NOISE = 64
BATCH = 2_048
RATE = 0.15
FLUSH = 300_000
#: Tokens of a training shard: documents are dealt to shards by hash, and each trains a copy of the model.
SHARD_TOKENS = 2_000_000
END = 0
END_WORD = " "  # no word has a space


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over whole texts, the end token as a single space; counts are combined before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out():
            words = [w.decode("utf-8", "surrogatepass") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
                held[END_WORD.encode()] += 1
                if len(held) > FLUSH:
                    yield out()
                    held = Counter()
        yield out()

    return train.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes(dict):
    """Class of each word: frequent words and the end have their own, the others that of their last bytes."""

    def __init__(self, named: dict[bytes, int], forms: int):
        super().__init__(named)
        self.first, self.forms = len(named), forms

    def __missing__(self, word: bytes) -> int:
        return self.first + crc32(word[-FORM_BYTES:]) % self.forms

    def __reduce__(self):
        return Classes, (dict(self), self.forms)


@dataclass
class Vocabulary:
    """Bounded: the classes, counts of the ``KNOWN`` most frequent words, and per class the count and the mass that its words share."""

    classes: Classes
    counts: dict[bytes, int]
    class_counts: np.ndarray
    total: int
    kinds: int
    mass: np.ndarray

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Classes of the words of a text."""
        return np.fromiter(map(self.classes.__getitem__, words), np.int64, len(words))


def vocabulary(counts: DataFrame, named: int = NAMED, forms: int = FORMS, known: int = KNOWN) -> Vocabulary:
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = whole["n"] or 0, whole["v"]
    # whole classes of counts from the top, as many as fit into the bound: what is collected is bounded by it
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes, least, held = counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect(), None, 0
    for r in sizes:
        held += r["m"]
        if held > known:
            break
        least = r["step"]
    top = [] if least is None else sorted(counts.where(step >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    table = {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in top}
    end = END_WORD.encode()
    table[end] = table.get(end) or (counts.where(F.col("word") == END_WORD).agg(F.sum("n")).first()[0] or 0)
    own = [end, *[w for w in table if w != end][: named - 1]]
    classes = Classes({w: i for i, w in enumerate(own)}, forms)
    n, v = np.zeros(len(own) + forms), np.zeros(len(own) + forms)
    # all words by form in one aggregate; those with a class of their own are taken off again
    tail = F.substring(F.col("word").cast("binary"), -FORM_BYTES, FORM_BYTES)
    for r in counts.groupBy((F.crc32(tail) % forms).cast("int").alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[len(own) + r["form"]], v[len(own) + r["form"]] = r["n"], r["v"]
    for i, w in enumerate(own):
        form = len(own) + crc32(w[-FORM_BYTES:]) % forms
        n[form], v[form], n[i], v[i] = n[form] - table[w], v[form] - (table[w] > 0), table[w], 1
    return Vocabulary(classes, table, n, total, kinds, n + 0.5 * (v + 1))


@dataclass
class LogBilinear:
    """score(w | a, b) = (near[a] + far[b]) . out[w] + bias[w] for the words a before and b before that."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, class_counts: np.ndarray, dim: int = DIM) -> LogBilinear:
        rng = np.random.default_rng(11)
        k = len(class_counts)
        p = (class_counts + 0.5) / (class_counts + 0.5).sum()
        return cls(*[rng.normal(0, 0.1, (k, dim)).astype(np.float32) for _ in range(3)], np.log(p).astype(np.float32))

    def rows(self) -> np.ndarray:
        return np.hstack([self.near, self.far, self.out, self.bias[:, None]])

    @classmethod
    def from_rows(cls, rows: np.ndarray, dim: int = DIM) -> LogBilinear:
        rows = np.ascontiguousarray(rows, np.float32)
        return cls(rows[:, :dim].copy(), rows[:, dim : 2 * dim].copy(), rows[:, 2 * dim : 3 * dim].copy(), rows[:, -1].copy())


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets (the end last) with the classes one and two places before; the end class stands before the first."""
    target = np.append(ids, END)
    padded = np.concatenate([[END, END], target])
    return target, padded[1:-1], padded[:-2]


def _add(sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """sums[at] += values, repeated places included."""
    width = sums.shape[1]
    cells = (at[:, None] * width + np.arange(width)).ravel()
    sums += np.bincount(cells, weights=values.ravel(), minlength=sums.size).reshape(sums.shape)


class Trainer:
    """Noise-contrastive estimation in batches with common noise words and per-value step sizes."""

    def __init__(self, model: LogBilinear, class_counts: np.ndarray, seed: int, noise: int = NOISE, rate: float = RATE):
        self.m, self.noise, self.rate, self.rng = model, noise, rate, np.random.default_rng(seed)
        p = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.cum, self.shift = np.cumsum(p), np.log(noise * p).astype(np.float32)
        self.squares = [np.full_like(x, 1e-3) for x in (model.near, model.far, model.out, model.bias)]

    def step(self, target: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        m, size = self.m, len(target)
        drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(self.noise)), len(self.cum) - 1)
        h = m.near[a] + m.far[b]
        q, qn = m.out[target], m.out[drawn]
        data = 1 / (1 + np.exp((h * q).sum(axis=1) + m.bias[target] - self.shift[target]))
        false = -1 / (1 + np.exp(-(h @ qn.T + (m.bias - self.shift)[drawn])))
        dh = data[:, None] * q + false @ qn
        grads = [np.zeros_like(x) for x in (m.near, m.far, m.out, m.bias)]
        _add(grads[0], a, dh)
        _add(grads[1], b, dh)
        _add(grads[2], target, data[:, None] * h)
        np.add.at(grads[2], drawn, false.T @ h)
        grads[3] += np.bincount(target, weights=data, minlength=len(m.bias)) + np.bincount(drawn, weights=false.sum(axis=0), minlength=len(m.bias))
        for x, g, s in zip((m.near, m.far, m.out, m.bias), grads, self.squares, strict=True):
            g /= size
            s += g * g
            x += self.rate * g / np.sqrt(s)


def train_round(train: DataFrame, model: LogBilinear, vocab: Vocabulary, seed: int, shards: int) -> LogBilinear:
    """Every shard trains a copy on all its tokens, in an order by hash; Spark averages the copies, weighted by tokens.

    Shards are a number of documents by hash, not partitions, so the model doesn't depend on how the input is cut.
    What reaches the driver is the averaged model, whose size does not depend on the corpus.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((model, vocab))
    width = 3 * model.near.shape[1] + 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, voc = shared.value
        trainer, here, seen, parts, held = None, None, 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                _train(trainer, parts)
            if seen + held:
                rows = trainer.m.rows()
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), pa.float32()), width).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(seen + held))), values], names=["row", "weight", "v"])

        for b in batches:
            for shard, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != here:
                    yield from done()
                    trainer = Trainer(LogBilinear.from_rows(start.rows(), start.near.shape[1]), voc.class_counts, seed * 1_000_003 + shard)
                    here, seen, parts, held = shard, 0, [], 0
                parts.append(contexts(voc.ids(tokens(t))))
                held += len(parts[-1][0])
                if held >= 8 * BATCH:
                    seen += held
                    _train(trainer, parts)
                    parts, held = [], 0
        yield from done()

    order = F.xxhash64("th", "id")
    dealt = train.select(F.pmod(F.xxhash64("id", "th", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), order.alias("o"), "th", "text")
    width_parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(width_parts, "shard").sortWithinPartitions("shard", "o", "th").select("shard", "text")
    parts = ordered.mapInArrow(fit, "row long, weight double, v array<float>")
    mean = [(F.sum(F.col("v")[i] * F.col("weight")) / F.sum("weight")).alias(f"v{i}") for i in range(width)]
    table = parts.groupBy("row").agg(*mean).orderBy("row").toPandas()
    return LogBilinear.from_rows(table.drop(columns="row").to_numpy(), model.near.shape[1]) if len(table) else model


def _train(trainer: Trainer, parts: list[tuple[np.ndarray, ...]]) -> None:
    target, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = trainer.rng.permutation(len(target))
    for i in range(0, len(order), BATCH):
        at = order[i : i + BATCH]
        trainer.step(target[at], a[at], b[at])


def normalisers(spark, model: LogBilinear) -> np.ndarray:
    """log sum of exp(score) for every pair of context classes, by batched matrix products on the executors."""
    k = len(model.bias)
    shared = spark.sparkContext.broadcast(model)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for a in pdf["id"]:
                s = (m.near[a] + m.far) @ m.out.T + m.bias
                top = s.max(axis=1, keepdims=True)
                z = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
                yield pd.DataFrame({"a": [a], "z": [z.astype(np.float32).tobytes()]})

    rows = spark.range(0, k, 1, 32).mapInPandas(table, "a long, z binary").collect()
    return np.frombuffer(b"".join(r["z"] for r in sorted(rows, key=lambda r: r["a"])), np.float32).reshape(k, k)


def score_texts(base: DataFrame, model: LogBilinear, log_z: np.ndarray, vocab: Vocabulary) -> DataFrame:
    """Per row: n_tokens, the parts of base and model score that the known words decide, and the words beyond them."""
    shared = base.sparkSession.sparkContext.broadcast((model, log_z, vocab))

    def make():
        m, z, voc = shared.value
        end = END_WORD.encode()
        by_near, by_far = m.near @ m.out.T + m.bias, m.far @ m.out.T  # scores of every class after each context class
        parts, named, ends = {w: log10(c + 0.5) for w, c in voc.counts.items()}, voc.classes, voc.counts[end]
        get, share = parts.get, np.log10(voc.mass)
        own = voc.classes.first

        def work(texts):
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_part", "model_part")}
            rest_words, rest_counts, offsets = [], [], [0]
            for t in texts:
                words = tokens(t)
                target, a, b = contexts(voc.ids(words))
                s = by_near[a, target] + by_far[b, target] - z[a, b]
                others = target[target >= own]
                model_part, base_part, unknown = float(s.sum(dtype=np.float64)) / log(10) - float(share[others].sum()), parts[end], 0
                for w, f in Counter(words).items():
                    part = get(w)
                    if part is None:
                        rest_words.append(w.decode("utf-8", "surrogatepass")), rest_counts.append(f)
                        unknown += f
                        continue
                    base_part += f * part
                    if w not in named:
                        model_part += f * part
                offsets.append(len(rest_words))
                cols["n_tokens"].append(len(words) + 1), cols["n_known"].append(len(words) - unknown + (ends > 0))
                cols["base_part"].append(base_part), cols["model_part"].append(model_part)
            rest = pa.StructArray.from_arrays([pa.array(rest_words, pa.string()), pa.array(rest_counts, pa.int64())], names=["word", "f"])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return {k: pa.array(v, kind) for (k, v), kind in zip(cols.items(), kinds, strict=True)} | {"rest": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)}

        return work

    return map_texts(base, make, "n_tokens long, n_known long, base_part double, model_part double, rest array<struct<word:string,f:bigint>>")


def lm_scores(docs: DataFrame, ident: str = "doc_id", text: str = "text", trains=None, rounds: int = 2) -> DataFrame:
    """One row per input row: id, th, trains, n_tokens, n_known, train_tokens, base_score, score.

    ``trains`` (a column, by default all true) marks the documents to learn from. Tokens are words in
    lower case (A-Z) and one end per text; null texts are empty. base_score is the smoothed unigram
    log10 probability. score is that of the log-bilinear model over classes, as context and as
    target: the ``NAMED`` most frequent words and the end are classes of their own, all others, unseen
    ones too, go by their last bytes to one of ``FORMS`` classes, inside which words follow the smoothed unigram with one
    more for all unseen words of the class. So it is normalised over all words.

    Word counts cover all training texts. The classes and the 65,536 most frequent words are
    known to every task (a bound on what is broadcast); other words, at most a few counts each, are
    joined with their counts by a shuffle. Every training token is trained on once, half of the
    documents in each of two rounds, in shards of about ``SHARD_TOKENS`` tokens by hash: scores do not depend on partitions. Nothing to learn from: all words are unseen. Rows equal in id
    and text get equal scores; null ids are values like others.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    trains = F.lit(True) if trains is None else trains
    base = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col(text).alias("text"))
    learn = base.where("trains")
    counts = scratch.keep(count_words(learn))
    vocab = vocabulary(counts)
    model = LogBilinear.start(vocab.class_counts)
    shards = max(1, ceil(vocab.total / rounds / SHARD_TOKENS))
    for r in range(rounds):
        model = train_round(learn.where(F.pmod(F.xxhash64("id", "th"), F.lit(rounds)) == r), model, vocab, r, shards)
    scored = scratch.keep(score_texts(base, model, normalisers(spark, model), vocab))
    rest = scored.select("id", "th", F.posexplode("rest").alias("pos", "entry")).select("id", "th", "pos", "entry.*")
    asked = rest.join(counts, "word", "left")
    more = asked.groupBy("id", "th").agg(F.sum(F.when(F.col("n") > 0, F.col("f")).otherwise(0)).alias("known"), F.sum(F.col("f") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("part"), F.sum(F.when(F.col("pos") == 0, 1)).alias("copies"))
    more = more.select("id", "th", (F.col("known") / F.col("copies")).cast("long").alias("known"), (F.col("part") / F.col("copies")).alias("part"))
    joined = scored.join(more, same_key(scored, more), "left").select(scored["*"], F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("part", F.lit(0.0)).alias("part"))
    norm = float(np.log10(vocab.total + 0.5 * (vocab.kinds + 1)))
    return joined.select(
        "id", "th", "trains", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(int(vocab.total)).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.col("part") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model_part") + F.col("part")).alias("score"),
    )
