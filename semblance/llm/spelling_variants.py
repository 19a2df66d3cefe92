"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the delimited vocabulary.

If two words are one edit apart, one of them starts with the first half of the other or ends with
its second half. So each word is searched twice: its first half exactly, then to the right with one
error; its second half exactly, then to the left with one error. Going right takes suffix-rank
intervals over the reversed words, going left over the words, and both are the same code on
reversed keys. The vocabulary is cut into blocks of neighbouring words (in order of the words, and
in order of the reversed words); a word visits the blocks that its exact half reaches into.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, lower_ascii

LETTERS = "a-zÀ-ÿ"
#: Words of a block (one task holds one block at a time) and sampled words for each border between blocks.
BLOCK_WORDS, SAMPLES = 25_000, 64
#: Gathered index rows and error states held at once.
GATHER, QUERIES = 1 << 21, 4_096
LAST = chr(0x10FFFF)


def counted_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_length: int = 5, least: int = 3, damage: int = 97) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, A-Z lower-cased, with at least ``least`` occurrences.

    Where ``damage`` divides h = crc32(id:run), the run loses its code point h % length (0: no
    damage). Null texts have no runs; a null id reads as empty text; repeated rows count again.
    """
    run, h = F.col("run"), F.col("h")
    runs = docs.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    word = run
    if damage:
        runs = runs.where(F.char_length(run) >= least_length).select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
        at = (h % F.char_length(run)).cast("int")
        word = F.when(h % damage == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- one block ---------------------------------------------------------------------------


class FMIndex:
    """FM-index of distinct keys, each closed by a delimiter on both sides; patterns grow to the right.

    Row (i, j) stands for the first j characters of key i, rows are sorted by these characters read
    backwards, and the row's symbol is the character after them (0: the delimiter). ``order`` keeps
    the rows sorted by symbol, so one binary search gives a symbol's first row plus its rank.
    """

    def __init__(self, keys: list[str]):
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        text = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        self.letters, code = np.unique(text, return_inverse=True)
        rows = size + 1
        n, first = int(rows.sum()), np.cumsum(rows) - rows
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        j = np.arange(n) - np.repeat(first, rows)
        before[j > 0] = code + 1
        after[j < np.repeat(size, rows)] = code + 1
        rank, k, longest = before, 1, int(size.max()) + 1
        while k < longest:  # ranks by k characters give ranks by 2 k
            far = np.where(j >= k, rank[np.maximum(np.arange(n) - k, 0)] + 1, 0)
            both = rank * (n + 1) + far
            kinds, rank = np.unique(both, return_inverse=True)
            if len(kinds) == n:
                break
            k *= 2
        place = np.argsort(rank, kind="stable")
        self.n, self.symbol = n, after[place]
        by = np.argsort(self.symbol, kind="stable")
        self.order = self.symbol[by] * n + by
        self.key_at_end = np.repeat(np.arange(len(keys)), rows)[place[self.symbol == 0]]
        self.keys = len(keys)

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text; -1 for letters that no key has."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, c), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == c, at + 1, -1) if len(self.letters) else np.full(len(c), -1)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = symbol > 0
        low = np.searchsorted(self.order, symbol * self.n + lo)
        return low, np.where(known, np.searchsorted(self.order, symbol * self.n + hi), low)

    def followers(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) for the letters that follow each interval."""
        kinds = len(self.letters) + 1
        seen = np.zeros((len(lo), kinds), bool)
        wide = hi - lo > 16 * kinds
        for c in range(1, kinds) if wide.any() else ():
            a, b = self.extend(lo[wide], hi[wide], np.full(int(wide.sum()), c))
            seen[wide, c] = b > a
        thin = np.flatnonzero(~wide)
        size = (hi - lo)[thin]
        upto = np.cumsum(size)
        at = 0
        while at < len(thin):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GATHER, side="right")))
            s = size[at:end]
            rows = np.repeat(lo[thin[at:end]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            seen[np.repeat(thin[at:end], s), self.symbol[rows]] = True
            at = end
        seen[:, 0] = False
        return np.nonzero(seen)

    def one_error(self, words: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) for the keys that share the word's first ``half`` characters and differ by one edit in the rest."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        half = np.asarray(halves, np.int64)
        first = np.cumsum(size) - size
        text = np.append(self.codes("".join(words)), -1)
        q = np.arange(len(words))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.keys, np.int64)  # all keys begin after a delimiter
        err = [np.zeros(0, np.int64)] * 3
        found, t = [], 0
        while len(q) or len(err[0]):
            # states with an error at the same place of the pattern: those of the last step, and new ones
            fresh = [err]
            branch = t >= half[q]
            if branch.any():
                bq, blo, bhi = q[branch], lo[branch], hi[branch]
                s, c = self.followers(blo, bhi)
                a, b = self.extend(blo[s], bhi[s], c)
                fresh.append([bq[s], a, b])  # a letter more
                going = t < size[bq]
                at_s = going[s] & (c != text[np.minimum(first[bq[s]] + t, len(text) - 1)])
                later = [[bq[going], blo[going], bhi[going]], [bq[s][at_s], a[at_s], b[at_s]]]  # a letter less, another letter
            else:
                later = []
            eq, elo, ehi = (np.concatenate(x) for x in zip(*fresh))
            done = size[eq] == t
            if done.any():
                a, b = np.searchsorted(self.order, elo[done]), np.searchsorted(self.order, ehi[done])
                hit = b > a
                found.append((eq[done][hit], self.key_at_end[a[hit]]))
                eq, elo, ehi = eq[~done], elo[~done], ehi[~done]
            a, b = self.extend(elo, ehi, text[first[eq] + t])
            alive = b > a
            err = [np.concatenate(x) for x in zip([eq[alive], a[alive], b[alive]], *later)]
            more = size[q] > t
            q, lo, hi = q[more], lo[more], hi[more]
            lo, hi = self.extend(lo, hi, text[first[q] + t])
            alive = hi > lo
            q, lo, hi, t = q[alive], lo[alive], hi[alive], t + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([f[0] for f in found]) * self.keys + np.concatenate([f[1] for f in found]))
        return pairs // self.keys, pairs % self.keys


def best_near(index: FMIndex, keys: list[str], counts: list[int], words: list[str], backward: bool) -> list[tuple[str, int, int, str]]:
    """(word, near, n, form) for the words with near keys in this block; pairs of both directions count going right only."""
    halves = [len(w) - len(w) // 2 if backward else len(w) // 2 for w in words]
    out: dict[int, list] = {}
    for w, k in zip(*(x.tolist() for x in index.one_error(words, halves))):
        word, key = words[w], keys[k]
        if backward and key.endswith(word[halves[w] :]):
            continue
        key = key[::-1] if backward else key
        if w not in out:
            out[w] = [1, counts[k], key]
        else:
            o = out[w]
            o[0] += 1
            if (counts[k], o[2]) > (o[1], key):  # larger n, or the same n and the smaller word
                o[1], o[2] = counts[k], key
    return [(words[w][::-1] if backward else words[w], *o) for w, o in out.items()]


# ---- all blocks --------------------------------------------------------------------------


def block_borders(vocabulary: DataFrame, block_words: int) -> list[list[str]]:
    """First keys of the blocks after the first, for words and for reversed words, from a hash sample of the vocabulary.

    The sample holds about SAMPLES words of each block; it decides where blocks end, not what is found.
    """
    rate = max(1, block_words // SAMPLES)
    sample = [r.word for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(rate)) == 0).select("word").collect()] if vocabulary.count() > block_words else []
    every = max(1, block_words // rate)
    return [sorted(set(sorted(w[::step] for w in sample)[every::every])) for step in (1, -1)]


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best): near words of each word that has any; best is (n, word), the largest n, then the smallest word."""
    borders = block_borders(vocabulary, block_words)
    width = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = "backward boolean, block int, query boolean, key string, n long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word once as a key of its block, and as a query to every block that may hold words with its exact half."""
        for b in batches:
            rows = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for backward in (False, True):
                    key, ends = word[::-1] if backward else word, borders[backward]
                    half = key[: len(word) - len(word) // 2 if backward else len(word) // 2]
                    rows.append((backward, bisect_right(ends, key), False, key, n))
                    rows.extend((backward, block, True, key, n) for block in range(bisect_right(ends, half), bisect_right(ends, half + LAST) + 1))
            for at in range(0, len(rows), 50_000):
                cols = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.int64()))], names=["backward", "block", "query", "key", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, index = None, [], [], None
        for b in batches:
            col = [b.column(i) for i in range(3)]
            back, block, query = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in col)
            cuts = np.flatnonzero((np.diff(block) != 0) | (back[1:] != back[:-1]) | (query[1:] != query[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
                if (back[s], block[s]) != at:
                    at, keys, counts, index = (back[s], block[s]), [], [], None
                part = b.slice(s, e - s)
                if not query[s]:
                    keys += part.column(3).to_pylist()
                    counts += part.column(4).to_pylist()
                    continue
                if not keys:
                    continue
                index = index or FMIndex(keys)
                words, rows = part.column(3).to_pylist(), []
                for i in range(0, len(words), QUERIES):
                    rows += best_near(index, keys, counts, words[i : i + QUERIES], bool(back[s]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "n", "form"])

    dealt = vocabulary.select("word", "n").mapInArrow(deal, row).repartition(width, "backward", "block").sortWithinPartitions("backward", "block", "query")
    found = dealt.mapInArrow(search, "word string, near long, n long, form string")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", F.struct((-F.col("first.n")).alias("n"), F.col("first.word")).alias("best"))


def variant_groups(words: DataFrame, ratio: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a vocabulary (word, n).

    ``form`` is the near word of largest n (ties: smallest in code point order) if that n is at
    least ``ratio`` times the word's, else null; ``root`` follows forms to the last. Rows of one
    word are added up; rows with a null word or n, and empty words, are dropped; an empty table
    gives none. Forms grow by ``ratio`` (2 at least), so chains have at most log2(n) links and
    doubling needs the logarithm of that many joins. Words shorter than four letters are found
    too, but reach into many blocks.
    """
    scratch = Scratch(words.sparkSession)
    vocabulary = scratch.keep(words.where("word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(vocabulary, block_words)
    formed = F.col("best.n") >= ratio * F.col("n")
    out = scratch.keep(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")))
    jumps = scratch.keep(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        far = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch.keep(jumps.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return out.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
