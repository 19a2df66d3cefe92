"""Collocations from weighted acyclic automata.

Each shard of documents sorts the windows of up to five words that start at its words and builds
count transducers of them, one for each prefix range: acyclic automata whose arcs carry the number
of windows below and whose equal states are stored once. A range unites the transducers of all
shards, summing weights, so the weight of an arc is the count of the phrase that leads to it. The
frequent phrases, an automaton in reading order and one in reversed order, are then composed with
themselves: the first part of a phrase is a prefix of its path in the one, the rest in the other.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import Scratch
from semblance.llm.token_files import chunks, gathered

BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
MOST_WORDS, LEAST, TOP = 5, 100, 2_000
#: Text bytes and windows of a shard, expected windows of a prefix range, phrases of a range of the composition.
SHARD_BYTES, SHARD_WINDOWS, RANGE_WINDOWS, RANGE_PHRASES = 5 << 20, 1_000_000, 1_000_000, 100_000
#: Windows that a union holds beside those already united.
HELD_WINDOWS = 300_000
#: Documents and stride of the sample that decides where ranges end (never what is counted).
SAMPLE_DOCS, SAMPLE_STRIDE = 4_000, 64
WORD_BYTES = 6
NO_LANG = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANK)], _KIND[list(BREAK)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_stream(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts on end, A-Z lower-cased, with the number of the piece and of the text of each."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True  # a text's first byte, and one past its last
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[start]
    text = np.searchsorted(ends, start, side="right") - 1
    return words_of(stop - start, raw[inside].tobytes()), piece, text


def words_of(size: np.ndarray, text: bytes) -> pa.Array:
    """Words from their sizes in bytes and their text on end."""
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(text))


def text_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Sizes in bytes, in a small type, and the text on end."""
    upto = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(upto)
    return size.astype(np.min_scalar_type(int(size.max(initial=0)))), words.buffers()[2].slice(int(upto[0]), int(upto[-1] - upto[0])).to_pybytes() if len(words) else b""


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in UTF-8 order, and the place of each word among them, from 1."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(order).cast(pa.large_string()), place[coded.indices.to_numpy(zero_copy_only=False)]


def place_of(words: pa.Array, name: str) -> tuple[int, bool]:
    """Where a name belongs among sorted words, from 1, and whether it is there."""
    at = bisect_left(range(len(words)), name, key=lambda i: words[i].as_py())
    return at + 1, at < len(words) and words[at].as_py() == name


def windows_at(code: np.ndarray, piece: np.ndarray, size: int = MOST_WORDS) -> np.ndarray:
    """The words from each word on inside its piece, filled up with 0: one row per word."""
    out = np.zeros((len(code), size), np.int32)
    for j in range(min(size, len(code))):
        same = piece[j:] == piece[: len(piece) - j]
        out[: len(code) - j, j] = np.where(same, code[j:], 0)
    return out


def summed(paths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order with their weights added up; paths have six columns."""
    if not len(paths):
        return paths, weight
    base = int(paths.max()) + 1
    keys = [paths[:, a].astype(np.int64) * base + paths[:, a + 1] for a in range(0, paths.shape[1] - 1, 2)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(paths), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    del keys, k
    first = np.flatnonzero(new)
    return paths[order[first]], np.add.reduceat(weight[order], first)


class CountTransducer:
    """Weighted acyclic automaton of paths (language, word, ..., word), 0 where a path ends early.

    Built from sorted distinct paths, last layer first; a layer's states that have the same arcs
    (label, target, weight) are registered once. Layers hold the first arc of each state, and
    label, target and weight of each arc; an arc's weight is the total of the paths through it.
    """

    def __init__(self, langs: pa.Array, words: pa.Array, paths: np.ndarray, weight: np.ndarray):
        self.langs, self.words, self.layers = langs, words, []
        depth, n = paths.shape[1], len(paths)
        first = [np.zeros(min(n, 1), np.int64)]
        new = np.zeros(n, bool)
        new[:1] = True
        for d in range(depth):
            new = new.copy()
            new[1:] |= paths[1:, d] != paths[:-1, d]
            first.append(np.flatnonzero(new))
        target = np.zeros(n, np.int64)
        for d in range(depth - 1, -1, -1):
            arcs = first[d + 1]
            label = paths[arcs, d].astype(np.int64)
            total = np.add.reduceat(weight, arcs) if n else weight
            at = np.searchsorted(arcs, first[d])
            size = np.diff(np.append(at, len(arcs)))
            with np.errstate(over="ignore"):
                marks = [np.add.reduceat(_mixed(label, target, total, seed), at) if n else np.zeros(0, np.uint64) for seed in (1, 2)]
            order = np.lexsort(marks)
            fresh = np.ones(len(order), bool)
            fresh[1:] = (marks[0][order][1:] != marks[0][order][:-1]) | (marks[1][order][1:] != marks[1][order][:-1])
            state = np.empty(len(order), np.int64)
            state[order] = np.cumsum(fresh) - 1
            kept = order[fresh]
            own = gathered(np.arange(len(arcs)), at[kept], size[kept])
            self.layers.append((np.concatenate([[0], np.cumsum(size[kept])]), label[own], target[own], total[own]))
            target = state
        self.layers.reverse()
        self.root = int(target[0]) if n else -1

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order with their weights."""
        state, weight = np.full(min(self.root + 1, 1), self.root), np.zeros(0, np.int64)
        columns: list[np.ndarray] = []
        for start, label, target, total in self.layers:
            start = start.astype(np.int64)
            size = start[state + 1] - start[state]
            arc = gathered(np.arange(len(label), dtype=np.int32), start[state], size)
            columns = [np.repeat(c, size) for c in columns] + [label[arc].astype(np.int32)]
            state, weight = target[arc].astype(np.int64), total[arc].astype(np.int64)
        return np.stack(columns, axis=1), weight

    def prefixes(self, paths: np.ndarray) -> np.ndarray:
        """The weight of each prefix of each path (0: not in the automaton), by walking all paths at once."""
        out = np.zeros(paths.shape, np.int64)
        state, alive = np.full(len(paths), self.root), np.full(len(paths), self.root >= 0)
        base = max(len(self.langs), len(self.words)) + 1
        for d, layer in enumerate(self.layers):
            start, label, target, total = (x.astype(np.int64) for x in layer)
            keys = np.repeat(np.arange(len(start) - 1), np.diff(start)) * base + label
            want = state * base + paths[:, d]
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            alive = alive & (keys[at] == want) if len(keys) else np.zeros(len(paths), bool)
            out[alive, d] = total[at[alive]]
            state = np.where(alive, target[at] if len(keys) else 0, 0)
        return out

    def pack(self) -> bytes:
        layers = [tuple(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in layer) for layer in self.layers]
        data = pickle.dumps((self.langs.to_pylist(), *text_of(self.words), self.root, layers), protocol=5)
        return zstandard.ZstdCompressor(level=1).compress(data)

    @classmethod
    def unpack(cls, data: bytes) -> CountTransducer:
        out = cls.__new__(cls)
        langs, size, text, out.root, out.layers = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        out.langs, out.words = names(langs), words_of(size, text)
        return out


def _mixed(label: np.ndarray, target: np.ndarray, total: np.ndarray, seed: int) -> np.ndarray:
    """64 hash bits of each arc."""
    h = np.full(len(label), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for x in (label, target, total):
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def names(words: Sequence[str]) -> pa.Array:
    return pa.array(words, pa.large_string())


def narrowed(langs: pa.Array, words: pa.Array, paths: np.ndarray, weight: np.ndarray) -> CountTransducer:
    """The transducer of paths that use few of the words: only those are stored."""
    seen = np.zeros(len(words) + 1, bool)
    seen[paths[:, 1:]] = True
    seen[0] = False
    used, lang = np.flatnonzero(seen), np.unique(paths[:, 0])
    place = np.zeros(max(len(words), len(langs)) + 1, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    out = place[paths]
    out[:, 0] = np.searchsorted(lang, paths[:, 0]) + 1
    return CountTransducer(langs.take(pa.array(lang - 1)), words.take(pa.array(used - 1)), out, weight)


Paths = tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]


def united(parts: Sequence[Paths]) -> Paths:
    """Union of sets of paths (languages, words, paths, weights) with the weights of equal paths summed."""
    langs, lang = ranked(pa.concat_arrays([p[0] for p in parts]))
    words, word = ranked(pa.concat_arrays([p[1] for p in parts]))
    stacked, at, lang_at, word_at = np.empty((sum(len(p[2]) for p in parts), MOST_WORDS + 1), np.int32), 0, 0, 0
    for p in parts:
        rows = stacked[at : at + len(p[2])]
        rows[:, 0] = lang[lang_at : lang_at + len(p[0])][p[2][:, 0] - 1]
        rows[:, 1:] = np.append(np.int32(0), word[word_at : word_at + len(p[1])])[p[2][:, 1:]]
        at, lang_at, word_at = at + len(rows), lang_at + len(p[0]), word_at + len(p[1])
    return langs, words, *summed(stacked, np.concatenate([p[3] for p in parts]))


def border_places(borders: Sequence[tuple[str, ...]], langs: pa.Array, words: pa.Array, paths: np.ndarray) -> list[int]:
    """Where each border (a path in text, '' for its end) falls among sorted paths."""
    out, columns = [], [np.ascontiguousarray(paths[:, d]) for d in range(paths.shape[1])] if borders else []
    for border in borders:
        lo, hi = 0, len(paths)
        for d, name in enumerate(border):
            at, known = place_of(words if d else langs, name) if name or not d else (0, True)
            left = lo + int(np.searchsorted(columns[d][lo:hi], at))
            hi = lo + int(np.searchsorted(columns[d][lo:hi], at, side="right")) if known else left
            lo = left
            if lo == hi:
                break
        out.append(lo)
    return out


# ---- counting ----------------------------------------------------------------------------


def _told(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Languages, words and one path per word, for slices of a batch of (lang, text); memory that Arrow holds on to is given back."""
    at = 0
    for texts in chunks(batch.column(1), SHARD_BYTES):
        langs, lang = ranked(batch.column(0).slice(at, len(texts)))
        at += len(texts)
        stream, piece, text = word_stream(texts)
        words, code = ranked(stream)
        windows = windows_at(code, piece)
        for s in range(0, len(code), SHARD_WINDOWS):
            e = min(s + SHARD_WINDOWS, len(code))
            yield langs, words, np.concatenate([lang[text[s:e], None], windows[s:e]], axis=1)
        del stream, piece, text, words, code, windows
        pa.default_memory_pool().release_unused()


def range_borders(docs: DataFrame, n_docs: int, n_bytes: int, range_windows: int) -> list[tuple[str, ...]]:
    """First paths of the prefix ranges after the first, from a sample: about SAMPLE_DOCS documents by hash, every 64th window."""
    ranges = math.ceil(n_bytes / WORD_BYTES / range_windows)
    if ranges <= 1:
        return []
    rate = max(1, n_docs // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, words, paths in _told(b):
                rows = [_names(langs, words, p) for p in paths[::SAMPLE_STRIDE]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["path"])

    sample = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(rate)) == 0).mapInArrow(run, "path array<string>")
    paths = sorted(tuple(r.path) for r in sample.collect())
    return sorted({paths[i * len(paths) // ranges] for i in range(1, ranges)} if paths else set())


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """(lang, phrase, n_words, f): all phrases of one to five words with f >= least, and one row of no words per language: n.

    Words are joined by a blank. Null texts are empty, a null language is ``und``; repeated rows
    count again; an empty table gives nothing. Only windows' distinct forms leave a shard, so a
    passage or pair that fills a third of the text costs one path per shard; a hot prefix is cut
    into as many ranges as its windows need, and phrases that reach over a border are added up.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    borders = range_borders(base, size["n"], size["b"] or 0, range_windows)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, words, paths in _told(b):
                paths, weight = summed(paths, np.ones(len(paths), np.int64))
                cuts = [0, *border_places(borders, langs, words, paths), len(paths)]
                for r, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    if e > s:
                        data = narrowed(langs, words, paths[s:e], weight[s:e]).pack()
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([data], pa.binary())], names=["range", "part"])

    def counted(place: int, parts: list[Paths]) -> Iterator[pa.RecordBatch]:
        """Arcs of the union that are frequent, or lie on the path of a border so that other ranges may hold more of them."""
        langs, words, paths, weight = united(parts)
        edge = borders[max(place - 1, 0) : place + 1]
        new, rows = np.zeros(len(paths), bool), []
        new[:1] = True
        for d in range(paths.shape[1]):
            new[1:] |= paths[1:, d] != paths[:-1, d]
            first = np.flatnonzero(new)
            total = np.add.reduceat(weight, first)
            wanted = np.ones(len(first), bool) if d == 0 else total >= least
            for border in edge if d else ():
                lo, hi = border_places([border[: d + 1]], langs, words, paths)[0], len(paths)
                at = np.searchsorted(first, lo)
                wanted[at : at + 1] |= lo < hi and tuple(_names(langs, words, paths[lo, : d + 1])) == border[: d + 1]
            if d:
                wanted &= paths[first, d] > 0
            for i, f in zip(first[wanted].tolist(), total[wanted].tolist()):
                name = _names(langs, words, paths[i, : d + 1])
                rows.append((name[0], " ".join(name[1:]), d, f))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "n_words", "f"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, held = None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                r, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if r != place:
                    if parts:
                        yield from counted(place, parts)
                    place, parts, held = r, [], 0
                part = CountTransducer.unpack(data)
                parts.append((part.langs, part.words, *part.paths()))
                held += len(parts[-1][2])
                if held > HELD_WINDOWS:
                    parts, held = [united(parts)], 0
        if parts:
            yield from counted(place, parts)

    built = base.mapInArrow(shards, "range int, part binary").repartition(max(width, 1), "range").sortWithinPartitions("range")
    counts = built.mapInArrow(unite, "lang string, phrase string, n_words int, f long")
    return counts.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n_words") == 0))


def _names(langs: pa.Array, words: pa.Array, path: np.ndarray) -> list[str]:
    return [langs[int(path[0]) - 1].as_py(), *(words[i - 1].as_py() if i else "" for i in path[1:].tolist())]


# ---- parts -------------------------------------------------------------------------------


def prefix_counts(phrases: DataFrame, backward: bool, range_phrases: int = RANGE_PHRASES) -> DataFrame:
    """(lang, phrase, parts): the counts of all prefixes of each phrase (backward: of the ends of one, two, ... words).

    The phrases are cut into ranges of neighbours; each builds the transducer of its own and is composed
    with it. Prefixes that a border shares with the range before it are handed to both: five per border.
    """
    step = -1 if backward else 1
    width = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def path_of(lang: str, phrase: str) -> tuple[str, ...]:
        return (lang, *phrase.split(" ")[::step])

    n = phrases.count()
    rate = max(1, range_phrases // SAMPLE_STRIDE)
    sample = phrases.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(rate)) == 0).select("lang", "phrase").collect() if n > range_phrases else []
    borders = sorted({path_of(*r) for r in sample})[SAMPLE_STRIDE::SAMPLE_STRIDE]
    shared = sorted({b[:k] for b in borders for k in range(2, len(b) + 1)})
    known = {}
    if shared:
        asked = phrases.sparkSession.createDataFrame([(p[0], " ".join(p[1:][::step])) for p in shared], "lang string, phrase string")
        known = {path_of(r.lang, r.phrase): r.f for r in phrases.join(F.broadcast(asked), ["lang", "phrase"]).select("lang", "phrase", "f").collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = [bisect_right(borders, path_of(*x)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *b.columns], names=["range", "lang", "phrase", "f"])

    def composed(place: int, rows: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
        own = [path_of(lang, phrase) for lang, phrase, _ in rows]
        have = dict(zip(own, (f for _, _, f in rows)))
        for k in range(2, len(borders[place - 1])) if place else ():
            have.setdefault(borders[place - 1][:k], known[borders[place - 1][:k]])
        langs, words = sorted({p[0] for p in have}), sorted({w for p in have for w in p[1:]})
        lang_at, word_at = {x: i + 1 for i, x in enumerate(langs)}, {x: i + 1 for i, x in enumerate(words)}

        def coded(paths: Sequence[tuple[str, ...]]) -> np.ndarray:
            out = np.zeros((len(paths), MOST_WORDS + 1), np.int32)
            for i, p in enumerate(paths):
                out[i, 0] = lang_at[p[0]]
                out[i, 1 : len(p)] = [word_at[w] for w in p[1:]]
            return out

        found = PhraseTransducer(names(langs), names(words), *summed(coded(list(have)), np.fromiter(have.values(), np.int64, len(have)))).ends(coded(own))
        parts = [x[1 : len(p)] for x, p in zip(found.tolist(), own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(parts, pa.list_(pa.int64()))], names=["lang", "phrase", "parts"])

    dealt = phrases.select("lang", "phrase", "f").mapInArrow(deal, "range int, lang string, phrase string, f long").repartition(width, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(by_range(composed), "lang string, phrase string, parts array<long>")


def by_range(work: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands the rows of each range, a bounded number, to ``work``; the stream is sorted by its first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        for b in batches:
            for r, *row in zip(*(c.to_pylist() for c in b.columns)):
                if r != place:
                    if rows:
                        yield from work(place, rows)
                    place, rows = r, []
                rows.append(tuple(row))
        if rows:
            yield from work(place, rows)

    return run


class PhraseTransducer(CountTransducer):
    """Accepts whole phrases; the weight of a phrase stands on the arc that ends it (label 0)."""

    def ends(self, paths: np.ndarray) -> np.ndarray:
        """For each prefix of each path, the weight of the phrase that ends there (0: none)."""
        out = np.zeros(paths.shape, np.int64)
        for k in range(2, paths.shape[1] + 1):
            cut = paths.copy()
            cut[:, k:] = 0
            out[:, k - 1] = self.prefixes(cut)[:, -1]
        return out


# ---- scores ------------------------------------------------------------------------------


def phrase_scores(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, range_windows: int = RANGE_WINDOWS, range_phrases: int = RANGE_PHRASES) -> DataFrame:
    """(lang, phrase, n_words, a, k, l, r, n, score, kept) for every phrase of two to five words with a >= least.

    Cut after k words into parts with counts l and r, the score is floor(1000 a n / (l r)) in exact
    decimals; the lowest cut counts, ties to the smallest k. ``kept`` is false where a longer
    candidate with the same count holds the phrase. Counts fall as phrases grow, so if any longer one
    has the same count, one that is longer by a single word has it too, and only those are looked at.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(phrase_counts(docs, text, lang, least, range_windows))
    phrases = counts.where("n_words > 0")
    total = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    first = prefix_counts(phrases, False, range_phrases).withColumnRenamed("parts", "firsts")
    rest = prefix_counts(phrases, True, range_phrases).withColumnRenamed("parts", "rests")
    both = scratch.keep(first.join(rest, ["lang", "phrase"]).where(F.size("firsts") > 1))
    m = F.size("firsts")
    a = F.element_at("firsts", -1)
    longer = both.select("lang", F.split("phrase", " ").alias("w"), m.alias("m"), a.alias("a"), F.element_at("firsts", -2).alias("l"), F.element_at("rests", -2).alias("r")).where("m > 2")
    covered = longer.where("l = a").select("lang", F.concat_ws(" ", F.expr("slice(w, 1, m - 1)")).alias("phrase")).unionByName(longer.where("r = a").select("lang", F.concat_ws(" ", F.expr("slice(w, 2, m - 1)")).alias("phrase"))).distinct()
    total = F.broadcast(total) if total.count() <= RANGE_PHRASES else total
    wide = both.join(total, "lang").select("lang", "phrase", m.alias("n_words"), a.alias("a"), "n", "firsts", "rests")
    cuts = F.expr("""transform(sequence(1, n_words - 1), k -> named_struct(
        'score', (cast(1000 * a AS decimal(19,0)) * cast(n AS decimal(18,0))) div (cast(firsts[k - 1] AS decimal(18,0)) * cast(rests[n_words - k - 1] AS decimal(18,0))),
        'k', k, 'l', firsts[k - 1], 'r', rests[n_words - k - 1]))""")
    scored = wide.select("lang", "phrase", "n_words", "a", "n", F.array_min(cuts).alias("cut"))
    return scored.join(covered.withColumn("covered", F.lit(True)), ["lang", "phrase"], "left").select(
        "lang", "phrase", "n_words", "a", "cut.k", "cut.l", "cut.r", "n", "cut.score", F.col("covered").isNull().alias("kept"))


def top_phrases(scores: DataFrame, top: int = TOP, bucket_rows: int = RANGE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` kept phrases of each language by score, count, phrase.

    Ranked in hash buckets first, so that no task sees more than a bucket or ``top`` rows of each.
    """
    kept = Scratch(scores.sparkSession).keep(scores.where("kept"))
    buckets = max(1, math.ceil(kept.count() / bucket_rows))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked_again = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked_again.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
