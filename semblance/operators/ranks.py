"""Distributed order statistics.

A global running total or rank never goes through one task: values fall into
ordered buckets whose edges come from one sketch pass, bucket totals (a bounded
table) are accumulated, and only the inside of a bucket is windowed. Edges are
brought to the driver once, so every later stage sees the same buckets.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.functions.rand import digest
from semblance.operators.frames import const_array, melt

BUCKETS = 1024
SKETCH_ACCURACY = 20_000
SMALL_DISTINCT = 200_000
#: Accuracy of the sketch that encloses wanted ranks, and edges up to which a tree of comparisons finds the slot.
ENCLOSING, TREE_EDGES = 2_000, 64
SMALL_SERIES = 4_000_000
#: Buckets of a comparison of two CDFs, and how many sorted values of a batch one of them stands for when edges are placed.
CDF_BUCKETS, THIN = 4_096, 16


def bucket_edges(long: DataFrame, by: str, value: str = "value", buckets: int = BUCKETS) -> dict[str, list[float]]:
    """Sorted distinct edges per series: near-equal row shares, one sketch pass."""
    grid = const_array([i / buckets for i in range(1, buckets)], "double")
    rows = long.groupBy(by).agg(F.percentile_approx(value, grid, SKETCH_ACCURACY).alias("e")).collect()
    return {r[by]: sorted(set(r["e"] or [])) for r in rows}


def with_bucket(long: DataFrame, edges: dict[str, list[float]], by: str, value: str = "value") -> DataFrame:
    """Add ``_bucket``, how many edges of its series are <= the value.

    One binary search in the row's own edges, so the cost of a row does not grow with the number of
    series; the edges are a constant of the plan.
    """
    filled = {k: e for k, e in edges.items() if e}
    if not filled:
        return long.withColumn("_bucket", F.lit(0))
    own = F.create_map(*[x for k, e in filled.items() for x in (F.lit(k), const_array(e, "double"))])[F.col(by)]
    most = max(map(len, filled.values()))
    return long.withColumn("_bucket", F.coalesce(F.element_at(F.transform(F.array(own), lambda e: _steps(e, F.col(value), most)), 1), F.lit(0)))


def _steps(e: Column, v: Column, most: int) -> Column:
    """How many entries of a sorted array of up to ``most`` are <= v."""
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def ahead(at: Column, stride: Column) -> Column:
        return (at + stride <= F.size(e)) & (F.get(e, at + stride - 1) <= v)

    return F.aggregate(strides, F.lit(0), lambda at, stride: F.when(ahead(at, stride), at + stride).otherwise(at))


def _search(v: Column, edges: list[float]) -> Column:
    return F.element_at(F.transform(F.array(const_array(edges, "double")), lambda e: _steps(e, v, len(edges))), 1)


def running_counts(
    long: DataFrame, by: str, tallies: dict[str, Column], value: str = "value", buckets: int = BUCKETS, small: int = SMALL_SERIES
) -> DataFrame:
    """One row per (series, distinct value) in sorted order, with neighbours in that order.

    Besides the tallies there are their totals per series (``total_*``), inclusive running
    tallies (``cum_*``) and ``after``, the struct (value, tallies) of the next larger value.
    Equal values are pre-aggregated before the shuffle, so a value holding a third of all rows
    is one row afterwards. A series is windowed as one group only when it is counted to be small.
    """
    sizes = long.groupBy(by).agg(F.count(value).alias("_n"), *[t.alias(n) for n, t in tallies.items()]).collect()
    counted = long.groupBy(by, value).agg(*[t.alias(n) for n, t in tallies.items()])
    kind = dict(counted.dtypes)
    total = {n: F.lit(0).cast(kind[n]) for n in tallies}
    for r in sizes:
        total = {n: F.when(F.col(by) == r[by], F.lit(r[n]).cast(kind[n])).otherwise(t) for n, t in total.items()}
    cell = F.struct(value, *tallies)
    if all(r["_n"] <= small for r in sizes):
        inside = Window.partitionBy(by).orderBy(value)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        return counted.select(
            by, value, *tallies, *[t.alias(f"total_{n}") for n, t in total.items()],
            *[F.sum(n).over(upto).alias(f"cum_{n}") for n in tallies], F.lead(cell).over(inside).alias("after"),
        )
    edges = bucket_edges(long, by, value, buckets)
    placed = with_bucket(counted, edges, by, value).withColumn("_cell", cell)
    totals = placed.groupBy(by, "_bucket").agg(
        F.min("_cell").alias("_first"), *[F.sum(n).alias(f"_t_{n}") for n in tallies]
    )
    order = Window.partitionBy(by).orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        by, "_bucket", F.lead("_first").over(order).alias("_next"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in tallies],
    )
    inside = Window.partitionBy(by, "_bucket").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # offsets has at most series x buckets rows, so it may be broadcast
    out = placed.join(F.broadcast(offsets), [by, "_bucket"])
    return out.select(
        by, value, *tallies, *[t.alias(f"total_{n}") for n, t in total.items()],
        *[(F.col(f"_o_{n}") + F.sum(n).over(upto)).alias(f"cum_{n}") for n in tallies],
        F.coalesce(F.lead("_cell").over(inside), F.col("_next")).alias("after"),
    )


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def _pooled_edges(frames: Sequence[DataFrame], n_cols: int, buckets: int) -> list[np.ndarray]:
    """Edges per column with near-equal shares of the finite values of all frames; a value that spans several shares has a bucket of its own.

    The edges only balance the buckets, so the sketch sees every ``THIN``-th value of each sorted batch.
    """
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(n_cols):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                v = np.sort(v[np.isfinite(v)])
                v = v[min(THIN // 2, max(len(v) - 1, 0)) :: THIN]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], names=["c", "v"])

    points = None
    for df in frames:
        some = df.mapInArrow(thin, "c int, v double")
        points = some if points is None else points.unionByName(some)
    grid = const_array([i / buckets for i in range(1, buckets)], "double")
    out = [np.zeros(0)] * n_cols
    for r in points.groupBy("c").agg(F.percentile_approx("v", grid, SKETCH_ACCURACY).alias("e")).collect():
        e, times = np.unique(np.array(r["e"], float), return_counts=True)
        e = np.unique(np.concatenate([e, np.nextafter(e[times > 1], np.inf)]))
        out[r["c"]] = e[np.isfinite(e)]
    return out


def cdf_distances(real: DataFrame, syn: DataFrame, cols: Sequence[str], area: bool = False, buckets: int = CDF_BUCKETS) -> list[dict]:
    """Per column with values: sizes of both sides, the largest gap of their CDFs (``ks``), it times both sizes (``cross``) and, with ``area``, the area between them.

    Exact, without sorting whole columns: counts per bucket give both CDFs at the edges and bound them
    inside. Only the values of buckets that may hold a larger gap than any edge, or in which the sign may
    change, are ordered one by one; elsewhere the area follows from sums. Bucket totals reach the driver.
    """
    cols = list(cols)
    frames = [_numbers(real, cols), _numbers(syn, cols)]
    edges = _pooled_edges(frames, len(cols), buckets)

    def tally(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # before the first bucket those at minus infinity, behind the last those at infinity and NaN
            n = [np.zeros(len(e) + 4, np.int64) for e in edges]
            s = [np.zeros(len(e) + 4) for e in edges]
            ends = [[math.inf, -math.inf] for _ in edges]
            for batch in batches:
                for i, e in enumerate(edges):
                    v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    n[i][0] += (v == -np.inf).sum()
                    n[i][-2] += (v == np.inf).sum()
                    n[i][-1] += np.isnan(v).sum()
                    v = v[np.isfinite(v)]
                    if len(v):
                        at = np.searchsorted(e, v, side="right")
                        n[i][1:-2] += np.bincount(at, minlength=len(e) + 1)
                        s[i][1:-2] += np.bincount(at, weights=v - e[np.maximum(at - 1, 0)], minlength=len(e) + 1)
                        ends[i] = [min(ends[i][0], v.min()), max(ends[i][1], v.max())]
            for i in range(len(edges)):
                b = np.flatnonzero(n[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.full(len(b), side, np.int32), np.full(len(b), i, np.int32), b.astype(np.int32), n[i][b], s[i][b],
                                           np.full(len(b), ends[i][0]), np.full(len(b), ends[i][1]))], names=["side", "c", "b", "n", "s", "lo", "hi"])

        return run

    kinds = "side int, c int, b int, n long, s double, lo double, hi double"
    counted = frames[0].mapInArrow(tally(0), kinds).unionByName(frames[1].mapInArrow(tally(1), kinds))
    sums = counted.groupBy("side", "c", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    count = [np.zeros((2, len(e) + 4), np.int64) for e in edges]
    total = [np.zeros((2, len(e) + 4)) for e in edges]
    lo, hi = [math.inf] * len(cols), [-math.inf] * len(cols)
    for r in sums:
        i = r["c"]
        count[i][r["side"], r["b"]], total[i][r["side"], r["b"]] = r["n"], r["s"]
        lo[i], hi[i] = min(lo[i], r["lo"]), max(hi[i], r["hi"])
    out, spans = {}, []
    inner = [np.zeros(len(e) + 1, bool) for e in edges]
    for i, (c, e) in enumerate(zip(cols, edges)):
        a, b = int(count[i][0].sum()), int(count[i][1].sum())
        if not a + b:
            continue
        out[i] = {"column": c, "n_real": a, "n_syn": b, "ks": None, "cross": 0, "area": None}
        if not a or not b:
            continue
        # gaps times a * b, in whole numbers of any size
        nr, ns = count[i].astype(object)
        cr, cs = np.cumsum(nr), np.cumsum(ns)
        end = cr * b - cs * a
        start = np.concatenate([[0], end[:-1]])
        upper, lower = start + nr * b, start - ns * a
        best = max(abs(x) for x in end)
        left = np.concatenate([[lo[i]], np.minimum(e, hi[i])])
        right = np.concatenate([np.minimum(e, hi[i]), [hi[i]]])
        several = np.concatenate([[True], np.nextafter(e[:-1], np.inf) < e[1:], [True]]) if len(e) else np.array([True])
        body = slice(1, -2)
        far = np.array([max(u, -w) > best for u, w in zip(upper[body], lower[body])])
        turns = np.array([u > 0 > w for u, w in zip(upper[body], lower[body])])
        inner[i] = (far | turns if area else far) & several
        out[i] |= {"ks": max(abs(x / a - y / b) for x, y in zip(cr, cs)), "cross": best}
        if area:
            ref = e[np.maximum(np.arange(len(e) + 1) - 1, 0)] if len(e) else np.zeros(1)
            ahead = count[i][:, body] * (right - ref) - total[i][:, body]
            held = np.abs([x / (a * b) for x in start[body]] * (right - left) + ahead[0] / a - ahead[1] / b)
            out[i]["area"] = float(held[~inner[i]].sum()) if len(e) else 0.0
            if count[i][:, -2:].any() or (count[i][:, 0].any() and (not len(e) or not end[0])):
                out[i]["area"] = math.nan
            elif count[i][:, 0].any():
                out[i]["area"] = math.inf
        spans += [(i, int(j), a, b, int(cr[j]), int(cs[j]), float(left[j]), float(right[j])) for j in np.flatnonzero(inner[i])]
    if spans:
        for r in _inside_buckets(frames, edges, inner, spans).collect():
            o = out[r["c"]]
            o["ks"] = max(o["ks"], r["ks"])
            if area:
                o["area"] += r["area"]
            # the row of the largest gap decides, in whole numbers
            o["cross"] = max(o["cross"], *[abs(x["r"] * o["n_syn"] - x["s"] * o["n_real"]) for x in r["at"]])
    return [out[i] for i in sorted(out)]


def _inside_buckets(frames: Sequence[DataFrame], edges: list[np.ndarray], inner: list[np.ndarray], spans: list[tuple]) -> DataFrame:
    """(c, ks, area, at): largest gap and area between the CDFs inside the marked buckets; ``at`` holds both counts where the gap is widest up and down."""
    def pick(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, e in enumerate(edges):
                    if not inner[i].any():
                        continue
                    v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    v = v[np.isfinite(v)]
                    at = np.searchsorted(e, v, side="right")
                    v, n = np.unique(v[inner[i][at]] + 0.0, return_counts=True)
                    at, none = np.searchsorted(e, v, side="right"), np.zeros(len(v), np.int64)
                    parts = (np.full(len(v), i, np.int32), at.astype(np.int32), v, *((n, none) if side == 0 else (none, n)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["c", "b", "v", "r", "s"])

        return run

    kinds = "c int, b int, v double, r long, s long"
    tall = frames[0].mapInArrow(pick(0), kinds).unionByName(frames[1].mapInArrow(pick(1), kinds))
    counted = tall.groupBy("c", "b", "v").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    # at most columns x buckets rows
    known = frames[0].sparkSession.createDataFrame(spans, "c int, b int, _a long, _b long, _r long, _s long, _left double, _right double")
    inside = Window.partitionBy("c", "b").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(F.broadcast(known), ["c", "b"]).select(
        "c", "v", "_a", "_b", "_r", "_s", "_left", "_right", (F.col("_r") + F.sum("r").over(upto)).alias("cr"), (F.col("_s") + F.sum("s").over(upto)).alias("cs"),
        F.lead("v").over(inside).alias("after"), F.row_number().over(inside).alias("rank"))
    gap = F.col("cr") / F.col("_a") - F.col("cs") / F.col("_b")
    before = F.when(F.col("rank") == 1, F.abs(F.col("_r") / F.col("_a") - F.col("_s") / F.col("_b")) * (F.col("v") - F.col("_left"))).otherwise(0.0)
    step = F.abs(gap) * (F.coalesce("after", "_right") - F.col("v")) + before
    both = F.struct(F.col("cr").alias("r"), F.col("cs").alias("s"))
    return rows.groupBy("c").agg(F.max(F.abs(gap)).alias("ks"), F.sum(step).alias("area"), F.array(F.max_by(both, gap), F.min_by(both, gap)).alias("at"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL_DISTINCT, buckets: int = BUCKETS
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of whole columns, in two passes for all columns together.

    The first pass counts and sketches: for each probability it gives two values that enclose the
    wanted rank. The second counts the values between such edges one by one and those elsewhere
    only by side. Where that leaves more than ``small`` distinct values, or a sketch was off, the ranks are
    selected by buckets instead (:func:`order_statistics`).
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    # the sketch is off by at most 1 / ENCLOSING of the rows
    margin = 2.0 / ENCLOSING
    grid = [x for p in probs for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    head = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(F.col(c).cast("double"), const_array(grid, "double"), ENCLOSING).alias(f"q{i}") for i, c in enumerate(cols)],
    ).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    filled = {c: head[f"n{i}"] for i, c in enumerate(cols) if head[f"n{i}"]}
    wanted = {c: sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) for c, n in filled.items()}
    edges = {}
    for i, c in enumerate(cols):
        if c in filled:
            # below 10 ranks per margin the whole column is looked at
            spans = [(-math.inf, math.inf)] if filled[c] < 10 * ENCLOSING else sorted(
                (lo if low > 0.0 else -math.inf, hi if high < 1.0 else math.inf) for low, high, lo, hi in zip(grid[::2], grid[1::2], head[f"q{i}"][::2], head[f"q{i}"][1::2]))
            edges[c] = _merged(spans)
    at = _between(df, wanted, edges, small)
    left = [c for c in filled if c not in at]
    if left:
        at |= order_statistics(df, {c: wanted[c] for c in left}, buckets)
    for c, n in filled.items():
        spots = [p * (n - 1) for p in probs]
        out[c] = [at[c][math.floor(s)] + (at[c][math.ceil(s)] - at[c][math.floor(s)]) * (s - math.floor(s)) for s in spots]
    return out


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _tree(v: Column, edges: list[float], lo: int, hi: int) -> Column:
    """How many of edges[lo:hi] are <= v, plus lo, by a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < F.lit(edges[mid]), _tree(v, edges, lo, mid)).otherwise(_tree(v, edges, mid + 1, hi))


def _between(df: DataFrame, wanted: dict[str, list[int]], spans: dict[str, list[tuple[float, float]]], small: int) -> dict[str, dict[int, float]]:
    """Values at ranks that lie in closed spans; columns whose spans hold too many values, or miss a rank, are left out."""
    # slot 2 i + 1 is span i, even slots lie between spans; a span's upper edge is the next larger number
    cuts = {c: [x for lo, hi in s for x in (lo, math.nextafter(hi, math.inf))] for c, s in spans.items()}
    few = {c for c in cuts if len(cuts[c]) <= TREE_EDGES}
    parts = []
    for c in wanted:
        v = F.col(c).cast("double")
        inner = [e for e in cuts[c] if e != -math.inf]
        shift = len(cuts[c]) - len(inner)
        if c in few:
            slot = _tree(v, inner, 0, len(inner)) + shift
        else:
            slot = _search(v, inner) + shift
        parts.append((c, v, slot))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), slot.cast("int").alias("slot"), v.alias("v")) for i, (_, v, slot) in enumerate(parts)])
    tall = df.select(F.inline(cells)).where("v IS NOT NULL").select("c", "slot", F.when(F.col("slot") % 2 == 1, F.col("v")).alias("v"))
    names = [c for c, _, _ in parts]
    rows = tall.groupBy("c", "slot", "v").agg(F.count("*").alias("n")).limit(small + 1).collect() if names else []
    if len(rows) > small:
        return {}
    out: dict[str, dict[int, float]] = {}
    for i, c in enumerate(names):
        mine = sorted(((r["slot"], r["v"], r["n"]) for r in rows if r["c"] == i), key=lambda x: (x[0], x[1] is not None, x[1] != x[1], x[1] if x[1] is not None else 0.0))
        ends, run = [], 0
        for _, _, n in mine:
            run += n
            ends.append(run)
        found = {r: mine[bisect.bisect_right(ends, r)][1] for r in wanted[c]}
        if all(x is not None for x in found.values()):
            out[c] = found
    return out


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], buckets: int = BUCKETS) -> dict[str, dict[int, float]]:
    """Values at given 0-based ranks of each column (ranks count non-null cells only)."""
    spark = df.sparkSession
    long = melt(df, list(ranks))
    edges = bucket_edges(long, "column", "value", buckets)
    placed = with_bucket(long, edges, "column")
    histogram = placed.groupBy("column", "_bucket").count().collect()
    targets = []
    for c, wanted in ranks.items():
        sizes = sorted((r["_bucket"], r["count"]) for r in histogram if r["column"] == c)
        ends, run = [], 0
        for _, k in sizes:
            run += k
            ends.append(run)
        found: dict[int, list[int]] = {}
        for r in wanted:
            i = bisect.bisect_right(ends, r)
            found.setdefault(sizes[i][0], []).append(r - (ends[i] - sizes[i][1]))
        targets += [(c, b, local, ends[[s[0] for s in sizes].index(b)] - dict(sizes)[b]) for b, local in found.items()]
    table = spark.createDataFrame(targets, "column string, _bucket int, _ranks array<bigint>, _start bigint")
    # at most one row per wanted rank
    hits = placed.join(F.broadcast(table), ["column", "_bucket"])
    counted = hits.groupBy("column", "_bucket", "_ranks", "_start", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column", "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    spans = counted.withColumn("_hi", F.sum("n").over(w)).withColumn("_lo", F.col("_hi") - F.col("n"))
    picked = spans.select(
        "column", "value", "_start",
        F.explode(F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))).alias("_r"),
    ).collect()
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for r in picked:
        out[r["column"]][r["_start"] + r["_r"]] = r["value"]
    return out


def _hash_digits(spark: SparkSession) -> int:
    """Leading hex digits used as bucket: 4096 buckets, or 65536 on big clusters."""
    return 3 if int(spark.conf.get("spark.sql.shuffle.partitions")) < 2000 else 4


def _hash_bucket(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def number_rows(df: DataFrame, seed: str | int, key: Column, name: str = "idx") -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in hash order, in parallel; returns the frame and n.

    The hash spreads unique keys evenly, so buckets cannot be hot. Only rows of one key share a hash, so
    its 16 bytes are all that is sorted and shuffled beside the columns in use.
    """
    digits = _hash_digits(df.sparkSession)
    keyed = df.withColumn("_h", digest(seed, key.cast("string")))
    keyed = keyed.withColumn("_b", _hash_bucket(F.col("_h"), digits)).withColumn("_h", F.unhex("_h"))
    counts = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    offsets, run = [], 0
    for b in range(16**digits):
        offsets.append(run)
        run += counts.get(b, 0)
    start = F.element_at(const_array(offsets, "bigint"), F.col("_b") + 1)
    inside = Window.partitionBy("_b").orderBy("_h")
    out = keyed.withColumn(name, start + F.row_number().over(inside) - 1).drop("_h", "_b")
    return out, run


def number_groups(df: DataFrame, seed: str | int, key: Column, by: str, name: str = "idx") -> tuple[DataFrame, dict]:
    """Number rows 0..n_g-1 inside every group in (hash, key) order; returns the frame and group sizes.

    A group is split over hash buckets, so a huge one is not numbered by one task. Group count
    times 4096 offsets reach the driver: meant for classes and regions.
    """
    digits = _hash_digits(df.sparkSession)
    keyed = df.withColumn("_k", key.cast("string")).withColumn("_h", digest(seed, F.col("_k")))
    keyed = keyed.withColumn("_b", _hash_bucket(F.col("_h"), digits))
    counts: dict = {}
    for r in keyed.groupBy(by, "_b").count().collect():
        counts.setdefault(r[by], {})[r["_b"]] = r["count"]
    start = F.lit(None).cast("bigint")
    for g, c in counts.items():
        offsets, run = [], 0
        for b in range(16**digits):
            offsets.append(run)
            run += c.get(b, 0)
        start = F.when(F.col(by).eqNullSafe(F.lit(g)), F.element_at(const_array(offsets, "bigint"), F.col("_b") + 1)).otherwise(start)
    inside = Window.partitionBy(by, "_b").orderBy("_h", "_k")
    out = keyed.withColumn(name, start + F.row_number().over(inside) - 1).drop("_k", "_h", "_b")
    return out, {g: sum(c.values()) for g, c in counts.items()}


def hash_cut(df: DataFrame, seed: str | int, key: Column, share: float, by: str | None = None, flag: str = "is_test") -> DataFrame:
    """Mark exactly ceil(share * n) rows (per class when ``by`` is given): those first in (hash, key) order.

    Only bucket counts and one cut point per class reach the driver; rows are then marked
    by a comparison, without a shuffle. Null is a class of its own.
    """
    digits = _hash_digits(df.sparkSession)
    name = F.col(by).cast("string") if by else F.lit("")
    group = F.when(name.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), name))
    keyed = (
        df.withColumn("_g", group).withColumn("_k", key.cast("string"))
        .withColumn("_h", digest(seed, F.col("_k"))).withColumn("_b", _hash_bucket(F.col("_h"), digits))
    )
    per: dict[str, list[tuple[int, int]]] = {}
    for r in keyed.groupBy("_g", "_b").count().collect():
        per.setdefault(r["_g"], []).append((r["_b"], r["count"]))
    cuts = []
    for g, sizes in per.items():
        left = math.ceil(round(share * sum(n for _, n in sizes), 9))
        for b, n in sorted(sizes):
            if left <= n:
                cuts.append((g, b, left))
                break
            left -= n
    spark = df.sparkSession
    table = spark.createDataFrame([c for c in cuts if c[2] > 0], "_g string, _b int, _left int")
    inside = Window.partitionBy("_g", "_b").orderBy("_h", "_k")
    edge = (
        keyed.select("_g", "_b", "_h", "_k").join(F.broadcast(table), ["_g", "_b"])
        .withColumn("_r", F.row_number().over(inside)).where("_r = _left").select("_g", "_h", "_k").collect()
    )
    points = spark.createDataFrame([(r["_g"], r["_h"], r["_k"]) for r in edge], "_g string, _ch string, _ck string")
    marked = keyed.join(F.broadcast(points), "_g", "left")
    below = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col("_k") <= F.col("_ck")))
    return marked.withColumn(flag, F.coalesce(below, F.lit(False))).drop("_g", "_k", "_h", "_b", "_ch", "_ck")
