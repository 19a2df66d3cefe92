"""Exact k-nearest-neighbour join (Euclidean).

Small point tables are broadcast after a size check. Larger ones are split into cells and cells
into blocks of bounded size. In many dimensions the cells are Voronoi cells around hash-picked
pivots; a query visits only blocks that the triangle inequality cannot rule out, and cells are
large, so that its vector is sent to few of them even where the bounds rule out little. In few
dimensions a tree of halves, cut from a bounded sample, places points and queries, so that the cost
of a row grows with the depth of the tree and not with the number of cells; a query visits the
cells whose box lies within its bound, and inside a block only such boxes. Copies of one
vector are handled once: among equal points only the k smallest ids can be neighbours, and equal
queries share one search. Python sees one block of points and one Arrow batch of queries at a time
and emits at most k candidates per visit, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.rand import digest
from semblance.operators.frames import HOT_SHARE, cut_lineage, drop_checkpoint

BROADCAST_BYTES = 32 << 20
BROADCAST_PAIRS = 500_000_000
BLOCK_ROWS = 65_536
BLOCK_BYTES = 32 << 20
TILE_ROWS = 4096
QUERY_ROWS = 256
HOT_VISITS = 50_000
PIVOTS = 16_384
#: Up to so many dimensions blocks are cut into boxes of so many points, and cells are small.
BOX_DIMS, BOX_ROWS = 16, 128
CELL_ROWS = 16_384
#: Points of the sample that cuts the cells of few dimensions: per cell, and at most.
CUT_ROWS, CUT_MOST = 32, 100_000
#: Visits of one task and block in more dimensions: a central cell draws many of them there.
WIDE_VISITS = 8_192


def _rounding(dims: int) -> float:
    """Relative error, with a wide margin, of a centred expanded square against |a|^2 + |b|^2."""
    return 8.0 * (dims + 4) * np.finfo(float).eps


def _best(qv: np.ndarray, pv: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (queries x min(k, points)) of the nearest points, ties by id.

    Candidates come from the expanded square around the points' mean; their distances are then
    recomputed from differences, with a margin that covers the rounding of the expansion.
    """
    kk = min(k, len(pv))
    centre = pv.mean(axis=0)
    pc = pv - centre
    p2 = np.einsum("ij,ij->i", pc, pc)
    top, margin = p2.max(), 4.0 * _rounding(pv.shape[1])
    out_ids, out_dist = [], []
    for s in range(0, len(qv), QUERY_ROWS):
        q = qv[s : s + QUERY_ROWS]
        qc = q - centre
        q2 = np.einsum("ij,ij->i", qc, qc)
        rough = q2[:, None] + p2[None, :] - 2.0 * (qc @ pc.T)
        edge = rough.min(axis=1) if kk == 1 else np.partition(rough, kk - 1, axis=1)[:, kk - 1]
        row, col = np.nonzero(rough <= (edge + margin * (q2 + top))[:, None])
        diff = pv[col] - q[row]
        # cumsum adds from left to right, so equal sums tie exactly
        dist = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
        order = np.lexsort((ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < kk
        out_ids.append(ids[col[keep]].reshape(len(q), kk))
        out_dist.append(dist[keep].reshape(len(q), kk))
    return np.vstack(out_ids), np.vstack(out_dist)


def _ranked(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by (distance, id)."""
    order = np.lexsort((ids, dist, row))
    row, ids, dist = row[order], ids[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], dist[keep]


def _pair_distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances (queries x points), added from left to right, so that equal sums tie exactly."""
    out = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        diff = p[None, :, j] - q[:, None, j]
        diff *= diff
        out += diff
    return out


class _Tree:
    """Cells of few dimensions: a sample is halved along its widest side until ``cells`` shares are reached.

    ``fit`` takes the cells' true sizes and boxes, of which the nodes above them are made.
    """

    def __init__(self, sample: np.ndarray, cells: float):
        side, cut, down, cell, todo, n_cells = [0], [0.0], [[0, 0]], [-1], [(0, sample, cells)], 0
        while todo:
            node, part, share = todo.pop()
            width = np.zeros(1)
            if len(part):  # sides without numbers are not cut
                with np.errstate(invalid="ignore"):
                    width = np.nan_to_num(np.fmax.reduce(part, axis=0) - np.fmin.reduce(part, axis=0))
            if share <= 1.0 or not width.max() > 0:
                cell[node], n_cells = n_cells, n_cells + 1
                continue
            j = int(width.argmax())
            values = part[:, j]
            known = values[~np.isnan(values)]
            edge = np.partition(known, len(known) // 2)[len(known) // 2]
            if not (known < edge).any():
                edge = known[known > edge].min()
            low = values < edge
            side[node], cut[node], down[node] = j, edge, [len(side), len(side) + 1]
            for half in (part[low], part[~low]):
                todo.append((len(side), half, share * len(half) / len(part)))
                side.append(0), cut.append(0.0), down.append([0, 0]), cell.append(-1)
        self.side, self.cut, self.down, self.cell, self.n_cells = np.array(side), np.array(cut), np.array(down), np.array(cell), n_cells

    def place(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node, row = np.zeros(len(v), dtype=int), np.arange(len(v))
        row = row[self.cell[node] < 0]
        while len(row):
            at = node[row]
            node[row] = self.down[at, (~(v[row, self.side[at]] < self.cut[at])).astype(int)]
            row = row[self.cell[node[row]] < 0]
        return self.cell[node]

    def fit(self, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
        """Sizes and boxes of the nodes, and for each cell the least node around it that holds k points."""
        # a side with a missing number has no end
        lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
        leaf = self.cell >= 0
        self.n, self.lo, self.hi = np.zeros(len(leaf), dtype=np.int64), np.full((len(leaf), lo.shape[1]), np.inf), np.full((len(leaf), lo.shape[1]), -np.inf)
        self.n[leaf], self.lo[leaf], self.hi[leaf] = n[self.cell[leaf]], lo[self.cell[leaf]], hi[self.cell[leaf]]
        for node in reversed(np.flatnonzero(~leaf)):  # children follow their parents
            both = self.down[node]
            self.n[node], self.lo[node], self.hi[node] = self.n[both].sum(), self.lo[both].min(axis=0), self.hi[both].max(axis=0)
        around = np.arange(len(leaf))
        for node in np.flatnonzero(~leaf):
            for child in self.down[node]:
                around[child] = child if self.n[child] >= k else around[node]
        self.around = np.zeros(self.n_cells, dtype=int)
        self.around[self.cell[leaf]] = around[leaf]

    def farthest(self, q: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A distance within which each query has k points, infinite if there are fewer."""
        node, total = self.around[cell], np.zeros(len(q))
        for j in range(q.shape[1]):
            gap = np.maximum(np.abs(q[:, j] - self.lo[node, j]), np.abs(q[:, j] - self.hi[node, j]))
            total += gap * gap
        return np.where(self.n[node] > 0, np.sqrt(total), np.inf) if self.n[0] else np.full(len(q), np.inf)

    def visits(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells whose box lies within each query's squared limit."""
        # rounding is monotonic and the sums run in the same order, so a box is never farther than its points
        row, node, found = np.arange(len(q)), np.zeros(len(q), dtype=int), []
        while len(row):
            low = np.zeros(len(row))
            for j in range(q.shape[1]):
                v = q[row, j]
                gap = np.maximum(np.maximum(self.lo[node, j] - v, v - self.hi[node, j]), 0.0)
                low += gap * gap
            near = (low <= limit[row]) & (self.n[node] > 0)
            row, node = row[near], node[near]
            leaf = self.cell[node] >= 0
            found.append((row[leaf], self.cell[node[leaf]]))
            row, node = row[~leaf], node[~leaf]
            row, node = np.concatenate([row, row]), self.down[node].T.reshape(-1)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


class _Block:
    """The points of one block, searched for the k nearest within a bound of each query."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray):
        self.vecs, self.ids = vecs, ids
        self.cuts = self._boxes() if vecs.shape[1] <= BOX_DIMS else None

    def _boxes(self) -> list[tuple[int, int]]:
        """Sorts the points into boxes: halves along the widest side until few points or one vector are left."""
        self.tree = _Tree(self.vecs, len(self.vecs) / BOX_ROWS)
        box = self.tree.place(self.vecs)
        order = np.argsort(box, kind="stable")
        self.vecs, self.ids = self.vecs[order], self.ids[order]
        n = np.bincount(box, minlength=self.tree.n_cells)
        ends = np.cumsum(n)
        lo, hi = np.minimum.reduceat(self.vecs, ends - n, axis=0), np.maximum.reduceat(self.vecs, ends - n, axis=0)
        self.tree.fit(n, lo, hi, 1)
        return list(zip((ends - n).tolist(), ends.tolist()))

    def within(self, q: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of at most k nearest points no farther than ``reach``, ordered by query, distance and id."""
        found = self._in_boxes(q, k, reach) if self.cuts else self._in_tiles(q, k, reach)
        return _ranked(*(np.concatenate(x) for x in zip(*found)), k) if found else (np.zeros(0, int), self.ids[:0], np.zeros(0))

    def _in_boxes(self, q: np.ndarray, k: int, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        with np.errstate(over="ignore"):
            limit = reach * reach * (1.0 + 1e-12)
        home, found = self.tree.place(q), []

        def search(box: int, rows: np.ndarray, narrow: bool) -> None:
            s, e = self.cuts[box]
            sq = _pair_distances(q[rows], self.vecs[s:e])
            if narrow and e - s >= k:  # the box a query lies in or next to
                limit[rows] = np.fmin(limit[rows], np.partition(sq, k - 1, axis=1)[:, k - 1] * (1.0 + 1e-12))
            a, b = np.nonzero(sq <= limit[rows][:, None])
            found.append((rows[a], self.ids[s:e][b], np.sqrt(sq[a, b])))

        for box, rows in _runs(home, np.arange(len(q))):
            search(box, rows, True)
        row, box = self.tree.visits(q, limit)
        other = box != home[row]
        for b, rows in _runs(box[other], row[other]):
            search(b, rows, False)
        return found

    def _in_tiles(self, q: np.ndarray, k: int, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Expanded squares around the mean, tile by tile; those within the bound and its rounding are recomputed from differences."""
        if not hasattr(self, "centre"):
            self.centre = self.vecs.mean(axis=0)
            self.pc = self.vecs - self.centre
            self.p2 = np.einsum("ij,ij->i", self.pc, self.pc)
        found, margin, top = [], 4.0 * _rounding(q.shape[1]), self.p2.max()
        for s in range(0, len(q), QUERY_ROWS):
            qv = q[s : s + QUERY_ROWS]
            qc = qv - self.centre
            q2 = np.einsum("ij,ij->i", qc, qc)
            slack = margin * (q2 + top)
            with np.errstate(over="ignore"):
                limit = np.square(reach[s : s + QUERY_ROWS]) + slack
            for t in range(0, len(self.vecs), TILE_ROWS):
                pc = self.pc[t : t + TILE_ROWS]
                rough = qc @ pc.T
                rough *= -2.0
                rough += self.p2[t : t + TILE_ROWS]
                rough += q2[:, None]
                if len(pc) >= k and np.isinf(limit).any():
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
                row, col = np.nonzero(rough <= limit[:, None])
                if not len(row):
                    continue
                diff = self.vecs[t + col] - qv[row]
                dist = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
                found.append((s + row, self.ids[t + col], dist))
        return found


def _runs(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its rows), by ascending key."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for s, e in zip(starts, [*starts[1:], len(keys)]):
        yield int(keys[s]), rows[s:e]


def _merge(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return b
    ids, dist = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    order = np.lexsort((ids, dist), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.concatenate(col.to_numpy()).astype(float, copy=False).reshape(len(col), -1)


def _id_array(values, text: bool) -> np.ndarray:
    return np.array(list(values), dtype=str) if text else np.asarray(values, dtype=np.int64)


def _near(dists: str = "dists", pids: str = "pids"):
    """Parallel arrays to one array of (distance, pid)."""
    return F.arrays_zip(F.col(dists).alias("distance"), F.col(pids).alias("pid")).alias("near")


def _distinct_points(points: DataFrame, keep: int, group: list[str]) -> DataFrame:
    """At most ``keep`` smallest ids per distinct vector; others can never be among the nearest."""
    w = Window.partitionBy(*group, "vec").orderBy("pid")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, by: str | None = None, exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, hot_visits: int = HOT_VISITS,
    probes: int | None = None,
) -> DataFrame:
    """(qid, rank, pid, distance) with the k nearest points per query, ties by smallest pid.

    ``queries`` has qid and vec (array<double>), ``points`` has pid and vec; with ``by`` both carry
    a group column and neighbours come from the same group only. ``exclude_self`` ignores the
    point whose pid equals the qid. The search is exact unless ``probes`` is given: then each query
    looks only into so many cells (see ``cells.nearest_approximate``).
    """
    group = [by] if by else []
    if probes is not None:
        from semblance.operators.cells import build_index, nearest_approximate

        if by:
            raise ValueError("build an index for each group to search it approximately")
        return nearest_approximate(queries, build_index(_distinct_points(points.select("pid", "vec"), k + exclude_self, []), block_rows, pivots), k, probes, exclude_self, hot_visits)
    text = dict(points.dtypes)["pid"] == "string"
    need = k + 1 if exclude_self else k
    pts = _distinct_points(points.select(*group, "pid", "vec"), need, group)
    reps = queries.groupBy(*group, "vec").agg(F.min("qid").alias("rep"), F.count("*").alias("n"))
    # copies are handled once, and the search reads the rest several times
    pts = cut_lineage(pts)
    first = pts.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n_points, dims = first["n"], first["d"] or 0
    fits = n_points * (dims * 8 + 64) <= broadcast_bytes
    if fits and n_points * queries.count() <= BROADCAST_PAIRS:
        found = _search_broadcast(reps, pts, need, group, text)
    else:
        found = _search_cells(reps, pts, need, group, text, dims, block_rows, pivots, hot_visits)
    return _spread(queries, reps, found, k, group, exclude_self)


def _spread(queries: DataFrame, reps: DataFrame, found: DataFrame, k: int, group: list[str], exclude_self: bool) -> DataFrame:
    """Hand the list of each distinct vector to all queries that share it.

    Vectors that stand for more than 1/1000 of the queries are fewer than 1000 and are joined by
    broadcast; the rest is an evenly spread shuffle join.
    """
    n = queries.count()
    floor = max(n // HOT_SHARE, 10_000)
    on = [*group, "vec"]
    plain = queries.select(*group, "qid", "vec")
    hot = reps.where(F.col("n") > floor).select(*on, F.lit(True).alias("_hot"))
    if n > floor and not hot.isEmpty():
        found = cut_lineage(found)
        marked = plain.join(F.broadcast(hot), on, "left")
        hot_lists = found.join(F.broadcast(hot), on, "left_semi")
        full = (
            marked.where("_hot").drop("_hot").join(F.broadcast(hot_lists), on)
            .unionByName(marked.where("_hot is null").drop("_hot").join(found, on))
        )
    else:
        full = plain.join(found, on)
    near = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda x: x["pid"] != F.col("qid"))
    top = F.slice(near, 1, k)
    return full.select(*group, "qid", F.posexplode(top).alias("pos", "x")).select(
        *group, "qid", (F.col("pos") + 1).alias("rank"), F.col("x.pid").alias("pid"), F.col("x.distance").alias("distance")
    )


def _search_broadcast(reps: DataFrame, pts: DataFrame, k: int, group: list[str], text: bool) -> DataFrame:
    """All points fit the broadcast budget: every query batch is compared with them in blocks."""
    spark = pts.sparkSession
    local = pts.toPandas()
    tables = {}
    for g, part in local.groupby(group[0]) if group else [(None, local)]:
        if len(part):
            tables[g] = (_matrix(part["vec"]), _id_array(part["pid"], text))
    shared = spark.sparkContext.broadcast(tables)
    id_type = dict(pts.dtypes)["pid"]
    cols = [f"{group[0]} {dict(reps.dtypes)[group[0]]}"] if group else []
    schema = ", ".join([*cols, "vec array<double>", f"dists array<double>, pids array<{id_type}>"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for g, rows in pdf.groupby(group[0]).groups.items() if group else [(None, pdf.index)]:
                if g not in known or not len(rows):
                    continue
                vecs, ids = known[g]
                part = pdf.loc[rows, [*group, "vec"]]
                q, best = _matrix(part["vec"]), None
                for s in range(0, len(ids), TILE_ROWS):
                    best = _merge(best, _best(q, vecs[s : s + TILE_ROWS], ids[s : s + TILE_ROWS], k), k)
                yield part.assign(dists=list(best[1]), pids=list(best[0]))

    # the search is heavy per row, so spread it over all cores whatever the byte size
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = reps.select(*group, "vec").repartition(max(width, spark.sparkContext.defaultParallelism))
    return spread.mapInPandas(search, schema).select(*group, "vec", _near())


# ---- cells -----------------------------------------------------------------------------


def _fit_block(block_rows: int, dims: int) -> int:
    """Rows of a block whose bytes stay bounded in many dimensions."""
    return max(1, min(block_rows, BLOCK_BYTES // (8 * max(dims, 1))))


def _cell_count(n: int, dims: int, block_rows: int, pivots: int) -> int:
    """Cells for n points: few of a block each in many dimensions, where bounds rule out little; smaller ones in few dimensions."""
    rows = min(block_rows, CELL_ROWS) if dims <= BOX_DIMS else block_rows
    return int(min(pivots, max(8, n // rows)))


def _pivot_rows(pts: DataFrame, m: int, group: list[str]) -> dict:
    """m hash-picked point vectors per group (bounded)."""
    h = pts.withColumn("_h", digest("pivot", F.col("pid").cast("string")))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_h")
    picked = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m) if group else h.orderBy("_h").limit(m)
    out: dict = {}
    for r in picked.select(*group, "vec").collect():
        out.setdefault(r[group[0]] if group else None, {})[tuple(r["vec"])] = None
    return {g: np.array(list(v), dtype=float) for g, v in out.items()}


def _squares(a: np.ndarray, b: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances through the expansion around ``centre``, and a bound of their error."""
    a, b = a - centre, b - centre
    norms = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    return norms - 2.0 * (a @ b.T), _rounding(a.shape[1]) * norms


def _nearest_pivot(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest pivot (up to rounding) and the distance to it, a slice of rows at a time."""
    at, off, centre = [], [], pivots.mean(axis=0)
    for s in range(0, len(v), QUERY_ROWS):
        part = v[s : s + QUERY_ROWS]
        nearest = _squares(part, pivots, centre)[0].argmin(axis=1)
        diff = part - pivots[nearest]
        at.append(nearest)
        off.append(np.sqrt(np.einsum("ij,ij->i", diff, diff)))
    return np.concatenate(at), np.concatenate(off)


def _lower_bounds(
    sq: np.ndarray, err: np.ndarray, pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: np.ndarray
) -> np.ndarray:
    """Proven lower bounds (queries x cells) of the distance to any point of a cell.

    Two rules: the triangle inequality with the cell's span of offsets, and the distance to the
    plane between the cell's pivot and the query's nearest one. The error of every square,
    also of those that assigned points to cells, is taken off.
    """
    low = np.maximum(np.sqrt(np.maximum(sq - err, 0.0)) - hi * (1.0 + 1e-12), lo * (1.0 - 1e-12) - upper)
    row, at, centre = np.arange(len(sq)), sq.argmin(axis=1), pivots.mean(axis=0)
    gap2, gap_err = _squares(pivots[at], pivots, centre)
    c2 = np.einsum("ij,ij->i", pivots - centre, pivots - centre)
    reach2 = (np.sqrt(c2) + hi) ** 2
    assigned = 2.0 * _rounding(pivots.shape[1]) * (reach2[None, :] + np.maximum(c2[None, :], c2[at][:, None]))
    gap = np.sqrt(np.maximum(gap2 + gap_err, 0.0))
    clear = sq - sq[row, at][:, None] - err - err[row, at][:, None] - assigned
    plane = np.divide(clear, 2.0 * gap, out=np.zeros_like(clear), where=(clear > 0) & (gap > 0))
    return np.maximum(low, plane)


def _search_boxes(
    reps: DataFrame, pts: DataFrame, k: int, group: list[str], text: bool, dims: int, block_rows: int, pivots: int, hot_visits: int
) -> DataFrame:
    """The search in few dimensions: the own cell first, then every cell within the bound found there."""
    spark = pts.sparkSession
    sizes = {(r[group[0]] if group else None): r["n"] for r in pts.groupBy(*group).agg(F.count("*").alias("n")).collect()}
    most = max(sizes.values(), default=0)
    # small tables are cut finer, so that every task gets several cells
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = min(pivots, max(_cell_count(most, dims, block_rows, pivots), min(8 * width, most // 1024)))
    share = min(CUT_ROWS * m, CUT_MOST) / max(most, 1)
    sample: dict = {g: [] for g in sizes}
    for r in pts.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select(*group, "vec").collect():
        sample[r[group[0]] if group else None].append(r["vec"])
    trees = {g: _Tree(np.array(v, dtype=float).reshape(len(v), dims), m * sizes[g] / max(most, 1)) for g, v in sample.items()}
    cut = spark.sparkContext.broadcast(trees)
    g_cols = [f"{group[0]} {dict(pts.dtypes)[group[0]]}"] if group else []
    id_type = dict(pts.dtypes)["pid"]

    def split(pdf: pd.DataFrame, known: dict) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """Group, positions and vectors of the rows whose group has points."""
        for g, rows in pdf.groupby(group[0]).indices.items() if group else [(None, np.arange(len(pdf)))]:
            if g in known and len(rows):
                yield g, rows, _matrix(pdf["vec"].iloc[rows])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.full(len(pdf), -1)
            for g, rows, v in split(pdf, cut.value):
                cell[rows] = cut.value[g].place(v)
            yield pdf.assign(cell=cell)

    placed = cut_lineage(pts.select(*group, "pid", "vec").mapInPandas(place, ", ".join([*g_cols, f"pid {id_type}", "vec array<double>", "cell int"])))
    ends = [f(F.col("vec")[j]).alias(f"{n}{j}") for j in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes: dict = {g: (np.zeros(t.n_cells, dtype=np.int64), np.full((t.n_cells, dims), np.nan), np.full((t.n_cells, dims), np.nan)) for g, t in trees.items()}
    for r in placed.groupBy(*group, "cell").agg(F.count("*").alias("n"), *ends).collect():
        n, lo, hi = boxes[r[group[0]] if group else None]
        n[r["cell"]] = r["n"]
        lo[r["cell"]], hi[r["cell"]] = [r[f"lo{j}"] for j in range(dims)], [r[f"hi{j}"] for j in range(dims)]
    drop_checkpoint(pts)  # placed holds the same rows
    for g, (n, lo, hi) in boxes.items():
        trees[g].fit(n, lo, hi, k)
        trees[g].blocks = np.maximum(1, -(-n // block_rows))
    cells = spark.sparkContext.broadcast(trees)
    located = _located(placed, {g: t.blocks for g, t in trees.items()}, group, g_cols)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First visit: one block of the own cell."""
        for pdf in batches:
            cell, block = np.full(len(pdf), -1), np.zeros(len(pdf), dtype=int)
            for g, rows, v in split(pdf, cells.value):
                cell[rows] = cells.value[g].place(v)
                block[rows] = np.arange(len(rows)) % cells.value[g].blocks[cell[rows]]
            yield pdf.assign(cell=cell, block=block, reach=np.inf)[lambda x: x["cell"] >= 0]

    visit_schema = ", ".join([*g_cols, "vec array<double>", "cell int", "block int", "reach double"])
    seen = cut_lineage(_scan(reps.select(*group, "vec").mapInPandas(home, visit_schema), located, k, group, text, hot_visits))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Second visit: every other block that may hold a point within the bound found so far."""
        for pdf in batches:
            for g, rows, v in split(pdf, cells.value):
                part, tree = pdf.iloc[rows], cells.value[g]
                at, own = part["cell"].to_numpy(), part["block"].to_numpy()
                reach = np.array([x[-1] if len(x) >= k else np.inf for x in part["dists"]])
                few = np.flatnonzero(np.isinf(reach))
                reach[few] = tree.farthest(v[few], at[few])
                reach *= 1.0 + 1e-9
                with np.errstate(over="ignore"):
                    limit = reach * reach * (1.0 + 1e-12)
                for s in range(0, len(rows), TILE_ROWS):
                    q, cell = tree.visits(v[s : s + TILE_ROWS], limit[s : s + TILE_ROWS])
                    reps_n = tree.blocks[cell]
                    q, cell = np.repeat(q + s, reps_n), np.repeat(cell, reps_n)
                    block = np.arange(len(q)) - np.repeat(np.cumsum(reps_n) - reps_n, reps_n)
                    left = (cell != at[q]) | (block != own[q])
                    q, cell, block = q[left], cell[left], block[left]
                    for e in range(0, len(q), 20_000):
                        piece = part[[*group, "vec"]].iloc[q[e : e + 20_000]]
                        yield piece.assign(cell=cell[e : e + 20_000], block=block[e : e + 20_000], reach=reach[q[e : e + 20_000]])

    more = _scan(seen.mapInPandas(others, visit_schema), located, k, group, text, hot_visits)
    return _merged_lists(seen.select(*group, "vec", _near()).unionByName(more.select(*group, "vec", _near())), k, group)


def _located(placed: DataFrame, blocks: dict, group: list[str], g_cols: list[str]) -> DataFrame:
    """Points with the block of their cell."""
    rows = [(*([g] if group else []), c, int(b)) for g, every in blocks.items() for c, b in enumerate(every) if b > 1]
    # one row per cell that needs more than one block: at most groups x pivots rows
    table = placed.sparkSession.createDataFrame(rows, ", ".join([*g_cols, "cell int", "_blocks int"]))
    return (
        placed.join(F.broadcast(table), [*group, "cell"], "left")
        .withColumn("block", F.pmod(F.xxhash64("pid"), F.coalesce(F.col("_blocks"), F.lit(1))).cast("int")).drop("_blocks", "off")
    )


def _search_cells(
    reps: DataFrame, pts: DataFrame, k: int, group: list[str], text: bool, dims: int, block_rows: int, pivots: int, hot_visits: int
) -> DataFrame:
    spark = pts.sparkSession
    block_rows = _fit_block(block_rows, dims)
    if 0 < dims <= BOX_DIMS:
        return _search_boxes(reps, pts, k, group, text, dims, block_rows, pivots, hot_visits)
    hot_visits = min(hot_visits, WIDE_VISITS)
    # the largest group decides: smaller ones get as many pivots as they have points at most
    most = pts.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    m = _cell_count(most, dims, block_rows, pivots)
    centres = spark.sparkContext.broadcast(_pivot_rows(pts, m, group))
    g_cols = [f"{group[0]} {dict(pts.dtypes)[group[0]]}"] if group else []
    id_type = dict(pts.dtypes)["pid"]

    def split(pdf: pd.DataFrame):
        if group:
            return [(g, list(rows)) for g, rows in pdf.reset_index(drop=True).groupby(group[0]).groups.items()]
        return [(None, list(range(len(pdf))))]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, off = np.full(len(pdf), -1), np.zeros(len(pdf))
            for g, rows in split(pdf):
                if g in centres.value and rows:
                    cell[rows], off[rows] = _nearest_pivot(_matrix(pdf["vec"].iloc[rows]), centres.value[g])
            yield pdf.assign(cell=cell, off=off)

    point_schema = ", ".join([*g_cols, f"pid {id_type}", "vec array<double>", "cell int", "off double"])
    placed = cut_lineage(pts.select(*group, "pid", "vec").mapInPandas(place, point_schema))
    # per cell: size, radius span and the k smallest offsets (cells x k numbers)
    stats = placed.groupBy(*group, "cell").agg(F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi")).collect()
    w = Window.partitionBy(*group, "cell").orderBy("off")
    inner = placed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(*group, "cell", "off").collect()
    info: dict = {}
    for g, c in centres.value.items():
        size = len(c)
        info[g] = {"n": np.zeros(size, dtype=np.int64), "lo": np.zeros(size), "hi": np.zeros(size), "off": [[] for _ in range(size)]}
    for r in stats:
        i = info[r[group[0]] if group else None]
        i["n"][r["cell"]], i["lo"][r["cell"]], i["hi"][r["cell"]] = r["n"], r["lo"], r["hi"]
    for r in inner:
        info[r[group[0]] if group else None]["off"][r["cell"]].append(r["off"])
    for i in info.values():
        i["blocks"] = np.maximum(1, -(-i["n"] // block_rows))
        i["flat"] = np.array([x for o in i["off"] for x in o])
        i["flat_cell"] = np.array([c for c, o in enumerate(i["off"]) for _ in o], dtype=int)
        del i["off"]
    cells = spark.sparkContext.broadcast(info)
    located = _located(placed, {g: i["blocks"] for g, i in info.items()}, group, g_cols)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First visit: one block of the nearest cell that holds points."""
        for pdf in batches:
            cell, block = np.full(len(pdf), -1), np.zeros(len(pdf), dtype=int)
            for g, rows in split(pdf):
                if g in cells.value and rows:
                    cell[rows] = _nearest_pivot(_matrix(pdf["vec"].iloc[rows]), centres.value[g])[0]
                    block[rows] = (np.arange(len(rows)) % cells.value[g]["blocks"][cell[rows]]).astype(int)
            yield pdf.assign(cell=cell, block=block, reach=np.inf)[lambda x: x["cell"] >= 0]

    visit_schema = ", ".join([*g_cols, "vec array<double>", "cell int", "block int", "reach double"])
    first = reps.select(*group, "vec").mapInPandas(home, visit_schema)
    seen = cut_lineage(_scan(first, located, k, group, text, hot_visits))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Second visit: every block that may hold a point within the bound found so far."""
        for pdf in batches:
            for g, rows in split(pdf):
                if not rows:
                    continue
                c, i = centres.value[g], cells.value[g]
                for s in range(0, len(rows), QUERY_ROWS):
                    part = pdf.iloc[rows[s : s + QUERY_ROWS]]
                    sq, err = _squares(_matrix(part["vec"]), c, c.mean(axis=0))
                    upper = np.sqrt(np.maximum(sq + err, 0.0))
                    reach = np.array([x[-1] if len(x) >= k else np.inf for x in part["dists"]])
                    if len(i["flat"]) >= k:
                        far = np.partition(upper[:, i["flat_cell"]] + i["flat"][None, :], k - 1, axis=1)[:, k - 1]
                        reach = np.minimum(reach, far)
                    low = _lower_bounds(sq, err, c, i["lo"], i["hi"], upper)
                    q, cell = np.nonzero((low <= (reach * (1.0 + 1e-9))[:, None]) & (i["n"] > 0)[None, :])
                    reps_n = i["blocks"][cell]
                    q, cell = np.repeat(q, reps_n), np.repeat(cell, reps_n)
                    block = np.concatenate([np.arange(b) for b in reps_n]) if len(reps_n) else np.zeros(0, dtype=int)
                    done = (cell == part["cell"].to_numpy()[q]) & (block == part["block"].to_numpy()[q])
                    q, cell, block = q[~done], cell[~done], block[~done]
                    bound = reach * (1.0 + 1e-9)
                    for e in range(0, len(q), 20_000):
                        piece = part[[*group, "vec"]].iloc[q[e : e + 20_000]]
                        yield piece.assign(cell=cell[e : e + 20_000], block=block[e : e + 20_000], reach=bound[q[e : e + 20_000]])

    second = seen.mapInPandas(others, visit_schema)
    more = _scan(second, located, k, group, text, hot_visits)
    return _merged_lists(seen.select(*group, "vec", _near()).unionByName(more.select(*group, "vec", _near())), k, group)


def _merged_lists(lists: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The first k of all lists of a vector, by distance and id; vectors without any neighbour are left out."""
    every = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return lists.groupBy(*group, "vec").agg(every.alias("near")).where(F.size("near") > 0)


def _scan(visits: DataFrame, located: DataFrame, k: int, group: list[str], text: bool, hot_visits: int) -> DataFrame:
    """Bring visits (vec, cell, block, reach) to their block and search it: points first, then queries, in one sorted stream.

    Visits without a bound always give a row, others only if a point lies within their reach.

    Blocks with very many visits are split by a salt; their points are repeated per salt. The
    number of such blocks is at most visits / hot_visits.
    """
    at = [*group, "cell", "block"]
    sizes = visits.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > hot_visits)
    hot = F.broadcast(sizes.select(*at, F.ceil(F.col("n") / hot_visits).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = visits.join(hot, at, "left").withColumn("salt", F.pmod(F.xxhash64("vec"), salts).cast("int"))
    right = located.join(hot, at, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    stream = right.select(*at, "salt", "pid", "vec", F.lit(None).cast("double").alias("reach"), F.lit(0).alias("side")).unionByName(
        left.select(*at, "salt", F.lit(None).cast(dict(located.dtypes)["pid"]).alias("pid"), "vec", "reach", F.lit(1).alias("side"))
    )
    keys = [*at, "salt"]
    width = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartition(width, *keys).sortWithinPartitions(*keys, "side")
    g_cols = [f"{group[0]} {dict(visits.dtypes)[group[0]]}"] if group else []
    id_type = dict(located.dtypes)["pid"]
    schema = ", ".join([*g_cols, "vec array<double>", "cell int", "block int", f"dists array<double>, pids array<{id_type}>"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, vecs, ids = None, [], []
        table = None
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1) | (pdf["side"] != pdf["side"].shift())
            bounds = [*np.flatnonzero(change.to_numpy()), len(pdf)]
            for s, e in zip(bounds[:-1], bounds[1:]):
                run = pdf.iloc[s:e]
                key = tuple(run[keys].iloc[0])
                if key != here:
                    here, vecs, ids, table = key, [], [], None
                if run["side"].iloc[0] == 0:
                    vecs.append(_matrix(run["vec"]))
                    ids.append(_id_array(run["pid"], text))
                    table = None
                    continue
                out = run[[*group, "vec", "cell", "block"]]
                reach = run["reach"].to_numpy()
                if vecs and table is None:
                    table = _Block(np.vstack(vecs), np.concatenate(ids))
                row, pids, dists = table.within(_matrix(run["vec"]), k, reach) if table else (np.zeros(0, int), np.zeros(0), np.zeros(0))
                ends = np.searchsorted(row, np.arange(len(run) + 1))
                keep = np.flatnonzero((np.diff(ends) > 0) | np.isinf(reach))
                if len(keep):
                    spans = [slice(ends[i], ends[i + 1]) for i in keep]
                    yield out.iloc[keep].assign(dists=[dists[x] for x in spans], pids=[pids[x] for x in spans])

    return ordered.mapInPandas(search, schema)
