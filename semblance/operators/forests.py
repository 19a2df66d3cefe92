"""Regression forests and boosting whose trees grow on cells of binned features.

Trees look at no more than 32 bins of a feature, so rows that share all their bins share every path and only
their weight and the sum of their targets count. One pass bins the rows and one sums them by cell; a bagged
weight is drawn for every row and every tree on the way. What remains grows with the occupied cells, not with rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions.rand import Counter, mixed
from semblance.operators.frames import cut_lineage
from semblance.operators.ranks import exact_quantiles

#: Bins of a feature, and up to how many distinct values they are cut from counts of all values.
BINS, COUNTED_VALUES = 32, 1_000
#: More occupied cells than this are not grown here.
MOST_CELLS = 500_000
#: Rows of a cell beyond which they are dealt to several tasks, cells of a task, trees grown in one task.
HOT_CELL, TASK_CELLS, TREE_BLOCK = 500_000, 10_000, 4
#: Gains below this share of the node's own sum of squares are rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Binned:
    """Rows as (code, y), code the position of their cell, with the size and sum of y - centre of each occupied cell."""

    edges: tuple[np.ndarray, ...]
    rows: DataFrame
    code: np.ndarray
    n: np.ndarray
    s: np.ndarray
    centre: float


@dataclass(frozen=True)
class Trees:
    """Complete binary trees, a line each: feature (-1 in leaves), last bin that goes left, mean of the node."""

    edges: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    offset: float

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Weighted sums of the trees' leaves for columns of bins."""
        node, tree, at = np.zeros((len(self.feature), bins.shape[1]), dtype=np.int64), np.arange(len(self.feature))[:, None], np.arange(bins.shape[1])
        for _ in range(int(math.log2(self.feature.shape[1] + 1)) - 1):
            f = self.feature[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[f, at] > self.cut[tree, node]), node)
        return self.offset + self.weight @ self.value[tree, node]


def _known(x: np.ndarray) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError("null or NaN among features or target: fill or drop such rows first")
    return x


def _value_counts(df: DataFrame, cols: Sequence[str]) -> list[dict[float, int] | None]:
    """Rows of each value, None for columns of more than COUNTED_VALUES values."""
    names = [f"v{i}" for i in range(len(cols))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list = [pd.Series(dtype="int64") for _ in names]
        for pdf in batches:
            for i, c in enumerate(names):
                _known(pdf[c].to_numpy(dtype=float))
                if seen[i] is not None:
                    total = seen[i].add(pdf[c].value_counts(), fill_value=0).astype("int64")
                    seen[i] = total if len(total) <= COUNTED_VALUES else None
        for i, s in enumerate(seen):
            yield pd.DataFrame({"col": i, "value": s.index.astype(float), "n": s.to_numpy()}) if s is not None else pd.DataFrame({"col": [i], "value": [None], "n": [0]})

    counts = df.select(*[F.col(c).cast("double").alias(v) for c, v in zip(cols, names)]).mapInPandas(run, "col int, value double, n long")
    per = counts.groupBy("col", "value").agg(F.sum("n").alias("n")).groupBy("col").agg(
        F.max(F.col("value").isNull()).alias("many"), F.count("*").alias("k"), F.slice(F.collect_list(F.struct("value", "n")), 1, COUNTED_VALUES).alias("cells"))
    out: list = [{} for _ in names]
    for r in per.collect():
        out[r["col"]] = None if r["many"] or r["k"] > COUNTED_VALUES else {c["value"]: c["n"] for c in r["cells"]}
    return out


def cut_points(counts: dict[float, int], bins: int = BINS) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to even shares where there are too many values."""
    values = sorted(counts)
    if len(values) <= bins:
        return np.array([(a + b) / 2.0 for a, b in pairwise(values)])
    out, stride = [], sum(counts.values()) / bins
    target, now = stride, counts[values[0]]
    for a, b in pairwise(values):
        before, now = now, now + counts[b]
        if abs(before - target) < abs(now - target):
            out.append((a + b) / 2.0)
            target += stride
    return np.array(out)


def _edges(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, ...]:
    counts = _value_counts(df, cols)
    many = [c for c, n in zip(cols, counts) if n is None]
    ranks = exact_quantiles(df, many, [i / BINS for i in range(1, BINS)]) if many else {}
    return tuple(np.unique(np.array(ranks[c], dtype=float)) if n is None else cut_points(n) for c, n in zip(cols, counts))


def _place(edges: Sequence[np.ndarray], x: Sequence[np.ndarray]) -> np.ndarray:
    """Codes of rows: bins as digits of a number, the last feature's lowest."""
    code = np.zeros(len(x[0]), dtype=np.int64)
    for e, v in zip(edges, x):
        code = code * (len(e) + 1) + np.searchsorted(e, _known(v), side="left")
    return code


def _bins(edges: Sequence[np.ndarray], code: np.ndarray) -> np.ndarray:
    """A line of bins per feature."""
    out = np.empty((len(edges), len(code)), dtype=np.uint8)
    for i in reversed(range(len(edges))):
        code, out[i] = np.divmod(code, len(edges[i]) + 1)
    return out


def bin_rows(df: DataFrame, cols: Sequence[str], target: str) -> Binned | None:
    """The rows by cell, None where they fill too many cells."""
    edges = _edges(df, cols)
    if math.prod(len(e) + 1 for e in edges) >= 1 << 62:
        return None
    names = [f"v{i}" for i in range(len(cols))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"code": _place(edges, [pdf[c].to_numpy(dtype=float) for c in names]), "y": _known(pdf["y"].to_numpy(dtype=float))})

    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(v) for c, v in zip(cols, names)], F.col(target).cast("double").alias("y")).mapInPandas(run, "code long, y double"))
    centre = rows.agg(F.avg("y")).first()[0] or 0.0
    cells = rows.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.lit(centre)).alias("s")).limit(MOST_CELLS + 1).toPandas().sort_values("code")
    if len(cells) > MOST_CELLS:
        return None
    if not len(cells):
        raise ValueError("no rows to train on")
    return Binned(edges, rows, cells["code"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=float), cells["s"].to_numpy(dtype=float), centre)


def grow(bins: np.ndarray, widths: Sequence[int], n: np.ndarray, s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree (feature, cut, value) of least squares from weights and weighted sums of cells, a level at a time."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
    kept = n > 0
    bins, n, s, at = bins[:, kept], n[kept], s[kept], np.zeros(int(kept.sum()), dtype=np.int64)
    for level in range(depth + 1):
        here, first = 2**level, 2**level - 1
        nn, ss = np.bincount(at, n, here), np.bincount(at, s, here)
        own = np.divide(ss * ss, nn, out=np.zeros(here), where=nn > 0)
        value[first : first + here] = np.divide(ss, nn, out=np.zeros(here), where=nn > 0)
        if level == depth or not len(at):
            break
        best, best_f, best_cut = np.full(here, -np.inf), np.full(here, -1), np.zeros(here, dtype=int)
        for f, w in enumerate(widths):
            if w < 2:
                continue
            key = at * w + bins[f]
            ln, ls = (np.bincount(key, x, here * w).reshape(here, w).cumsum(axis=1)[:, :-1] for x in (n, s))
            rn, rs = nn[:, None] - ln, ss[:, None] - ls
            held = (ln >= 1) & (rn >= 1)
            kept_squares = np.where(held, ls * ls / np.where(held, ln, 1.0) + rs * rs / np.where(held, rn, 1.0), -np.inf)
            b = kept_squares.argmax(axis=1)
            top = kept_squares[np.arange(here), b]
            better = top > best
            best[better], best_f[better], best_cut[better] = top[better], f, b[better]
        split = best - own > LEAST_GAIN * own
        nodes = first + np.flatnonzero(split)
        feature[nodes], cut[nodes] = best_f[split], best_cut[split]
        down = split[at]
        if not down.all():
            bins, n, s, at = bins[:, down], n[down], s[down], at[down]
        at = 2 * at + (bins[best_f[at], np.arange(len(at))] > best_cut[at])
    return feature, cut, value


def poisson(words: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson counts from random 32-bit words, a line of words for each rate: the bagged weight of so many equal rows."""
    out = np.empty(words.shape)
    for m in np.unique(rate):
        lo = max(0, int(m - 8.0 * math.sqrt(m) - 10.0))
        k = np.arange(lo, int(m + 8.0 * math.sqrt(m) + 20.0))
        log_share = k * math.log(m) - m - math.lgamma(lo + 1) - np.r_[0.0, np.cumsum(np.log(k[1:]))]
        ends = np.cumsum(np.exp(log_share)) * 2.0**32
        # the upper half of a word decides but where an end falls inside its span
        starts = np.arange(1 << 16) * 65536.0
        table = lo + np.searchsorted(ends, starts, side="right")
        table[lo + np.searchsorted(ends, starts + 65535.0, side="right") != table] = -1
        at = slice(None) if len(rate) and (rate == m).all() else np.flatnonzero(rate == m)
        w = words[at]
        drawn = table[w >> np.uint32(16)].astype(float)
        open_ = drawn < 0
        drawn[open_] = lo + np.searchsorted(ends, w[open_].astype(float), side="right")
        out[at] = drawn
    return out


def bag_words(seed: int, ids: np.ndarray, trees: int) -> np.ndarray:
    """A random 32-bit word for each row and tree, from both chains of the row's counter."""
    c = Counter(seed, ids.astype(np.int64).view(np.uint64), trees)
    return mixed(mixed(np.arange(trees, dtype=np.uint32)[None, :] ^ c.base[0][:, None]) ^ c.base[1][:, None])


def grow_forest(data: Binned, trees: int, depth: int, seed: int) -> Trees:
    """Bagged trees: every row counts Poisson(1) times in every tree. Draws follow from seed, cell and target, so the partitioning does not matter.

    Equal rows are drawn together, as one Poisson count of their number.
    """
    spark, widths = data.rows.sparkSession, [len(e) + 1 for e in data.edges]
    hot = [(int(c), int(-(-n // HOT_CELL))) for c, n in zip(data.code, data.n) if n > HOT_CELL]
    salted = data.rows.withColumn("salt", F.lit(0))
    if hot:
        # fewer rows than one in HOT_CELL
        salted = data.rows.join(F.broadcast(spark.createDataFrame(hot, "code long, salts int")), "code", "left").select("code", "y", F.pmod(F.xxhash64("y"), F.coalesce(F.col("salts"), F.lit(1))).alias("salt"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(data.code) // TASK_CELLS))
    groups = salted.repartition(tasks, "code", "salt").groupBy("code", "salt", "y").agg(F.count("*").alias("m"))
    ordered = groups.select("code", "y", "m", F.xxhash64("code", "y").alias("id")).sortWithinPartitions("code")
    blocks, centre, edges = -(-trees // TREE_BLOCK), data.centre, data.edges

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Weights and weighted sums of the cells of a batch, a row of bytes for each block of trees."""
        for pdf in batches:
            if not len(pdf):
                continue
            code, y = pdf["code"].to_numpy(dtype=np.int64), pdf["y"].to_numpy(dtype=float) - centre
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            w = poisson(bag_words(seed, pdf["id"].to_numpy(), trees), pdf["m"].to_numpy())
            n = np.add.reduceat(w, start, axis=0)
            w *= y[:, None]
            s, at = np.add.reduceat(w, start, axis=0), code[start].tobytes()
            spans = [slice(b * TREE_BLOCK, (b + 1) * TREE_BLOCK) for b in range(blocks)]
            yield pd.DataFrame({"block": range(blocks), "code": at, "n": [n[:, x].tobytes() for x in spans], "s": [s[:, x].tobytes() for x in spans]})

    def read(col: pd.Series, kind: type, lanes: int = 1) -> np.ndarray:
        return np.concatenate([np.frombuffer(b, dtype=kind) for b in col]).reshape(-1, lanes)

    def grown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lanes = min(TREE_BLOCK, trees - key[0] * TREE_BLOCK)
        code, n, s = read(pdf["code"], np.int64)[:, 0], read(pdf["n"], float, lanes), read(pdf["s"], float, lanes)
        order = np.argsort(code, kind="stable")
        code, n, s = code[order], n[order], s[order]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n, s = np.add.reduceat(n, start, axis=0), np.add.reduceat(s, start, axis=0)
        bins = _bins(edges, code[start])
        found = [(key[0] * TREE_BLOCK + i, *grow(bins, widths, n[:, i], s[:, i], depth)) for i in range(lanes)]
        return pd.DataFrame(found, columns=["tree", "feature", "cut", "value"])

    sums = ordered.mapInPandas(bag, "block int, code binary, n binary, s binary").repartition(2 * blocks, "block")
    out = sorted(sums.groupBy("block").applyInPandas(grown, "tree int, feature array<int>, cut array<int>, value array<double>").collect(), key=lambda r: r["tree"])
    return Trees(edges, *(np.array([r[c] for r in out]) for c in ("feature", "cut", "value")), np.full(len(out), 1.0 / max(len(out), 1)), centre)


def grow_boosted(data: Binned, trees: int, depth: int, step: float) -> Trees:
    """Gradient boosting of the squared error, on the driver: a first tree of the target, then trees of twice the residual, weighted by ``step``."""
    bins, widths = _bins(data.edges, data.code), [len(e) + 1 for e in data.edges]
    weight, found, fitted = np.r_[1.0, np.full(trees - 1, step)], [], np.zeros(len(data.code))
    for i in range(trees):
        one = grow(bins, widths, data.n, data.s if i == 0 else 2.0 * (data.s - data.n * fitted), depth)
        found.append(one)
        fitted += Trees(data.edges, *(x[None] for x in one), weight[i : i + 1], 0.0).predict(bins)
    return Trees(data.edges, *(np.array(x) for x in zip(*found)), weight, data.centre)


def predictor(model: Trees, cols: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds ``prediction``; rows of one cell are predicted once a task."""

    def predict(df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            trees, code, out = shared.value, np.zeros(0, dtype=np.int64), np.zeros(0)
            for pdf in batches:
                here, back = np.unique(_place(trees.edges, [pdf[c].to_numpy(dtype=float) for c in pdf]), return_inverse=True)
                new = np.setdiff1d(here, code, assume_unique=True)
                if len(new):
                    if len(code) > MOST_CELLS:
                        code, out, new = code[:0], out[:0], here
                    code, out = np.r_[code, new], np.r_[out, trees.predict(_bins(trees.edges, new))]
                    order = np.argsort(code)
                    code, out = code[order], out[order]
                yield pd.Series(out[np.searchsorted(code, here)][back])

        row = F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
        return df.withColumn("prediction", F.pandas_udf(run, "double")(row))

    return predict
