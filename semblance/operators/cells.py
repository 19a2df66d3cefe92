"""An index table of points in Voronoi cells: counts inside balls, and approximate neighbours by probing few cells.

Cells belong to hash-picked pivots and are cut into blocks of bounded size. The pivots with the
size and the span of offsets of each cell are small (at most ``PIVOTS`` rows) and go to every task;
the points stay a table and are read block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.operators.frames import cut_lineage
from semblance.operators.neighbors import (
    BLOCK_ROWS, HOT_VISITS, PIVOTS, QUERY_ROWS, TILE_ROWS, _fit_block, _lower_bounds, _matrix, _merged_lists, _near, _nearest_pivot, _pivot_rows, _rounding,
    _scan, _spread, _squares, knn_join,
)


@dataclass
class CellIndex:
    """``points`` is (cell, block, pid, vec, weight); the arrays hold one entry per cell."""

    points: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    blocks: np.ndarray

    def save(self, path: str) -> None:
        """Writes the points and the cells as two Parquet tables."""
        self.points.write.parquet(f"{path}/points")
        rows = [(c, [float(x) for x in p], int(n), float(a), float(b), int(k)) for c, (p, n, a, b, k) in enumerate(zip(self.pivots, self.size, self.lo, self.hi, self.blocks))]
        self.points.sparkSession.createDataFrame(rows, "cell int, pivot array<double>, size long, lo double, hi double, blocks int").write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        column = {c: np.array([r[c] for r in cells]) for c in ("pivot", "size", "lo", "hi", "blocks")}
        return cls(spark.read.parquet(f"{path}/points"), column["pivot"].reshape(len(cells), -1), column["size"], column["lo"], column["hi"], column["blocks"])


def build_index(points: DataFrame, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> CellIndex:
    """Index of (pid, vec) or (pid, vec, weight): about sqrt(n) pivots picked by hash, every point with its nearest one."""
    pts = points if "weight" in points.columns else points.withColumn("weight", F.lit(1).cast("long"))
    pts = pts.select("pid", "vec", "weight").where("vec IS NOT NULL")
    n = pts.count()
    block_rows = _fit_block(block_rows, pts.agg(F.max(F.size("vec"))).first()[0] or 0)
    centres = _pivot_rows(pts, int(min(pivots, max(8, math.sqrt(n)))), []).get(None, np.zeros((0, 1)))
    m = len(centres)
    shared = pts.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, off = _nearest_pivot(_matrix(pdf["vec"]), shared.value)
                yield pdf.assign(cell=cell.astype(np.int32), off=off)

    placed = cut_lineage(pts.mapInPandas(place, f"pid {dict(pts.dtypes)['pid']}, vec array<double>, weight long, cell int, off double"))
    size, lo, hi, rows = np.zeros(m, np.int64), np.zeros(m), np.zeros(m), np.ones(m, np.int64)
    for r in placed.groupBy("cell").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi")).collect():
        size[r["cell"]], rows[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["w"], r["n"], r["lo"], r["hi"]
    blocks = np.maximum(1, -(-rows // block_rows))
    count = F.element_at(F.lit([int(b) for b in blocks]), F.col("cell") + 1) if m else F.lit(1)
    located = placed.select("cell", F.pmod(F.xxhash64("pid", "vec"), count).cast("int").alias("block"), "pid", "vec", "weight")
    return CellIndex(located, centres, size, lo, hi, blocks)


# ---- balls -------------------------------------------------------------------------------


def _inside(centres: np.ndarray, radii: np.ndarray, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of the points in each closed ball, a tile at a time; squares near the rim are recomputed from differences."""
    out, middle = np.zeros(len(centres), np.int64), points.mean(axis=0)
    for t in range(0, len(points), TILE_ROWS):
        tile, heavy = points[t : t + TILE_ROWS], weights[t : t + TILE_ROWS]
        for s in range(0, len(centres), QUERY_ROWS):
            c, r = centres[s : s + QUERY_ROWS], radii[s : s + QUERY_ROWS]
            sq, err = _squares(c, tile, middle)
            err = 4.0 * (err + _rounding(points.shape[1]) * (r * r)[:, None])
            sure = sq + err < (r * r)[:, None]
            total = sure @ heavy
            row, col = np.nonzero(~sure & (sq - err <= (r * r)[:, None]))
            diff = tile[col] - c[row]
            hit = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1]) <= r[row]
            out[s : s + QUERY_ROWS] += total + np.bincount(row[hit], heavy[col[hit]], len(c)).astype(np.int64)
    return out


def ball_counts(balls: DataFrame, index: CellIndex, hot_visits: int = HOT_VISITS) -> DataFrame:
    """(bid, inside): the weight of the points inside each closed ball (bid, vec, radius); no pair leaves a task.

    A cell that lies inside a ball whole is counted from its size, a cell that the triangle
    inequality rules out is not visited, and the blocks of the others are searched. Balls without
    radius hold nothing.
    """
    kind = dict(balls.dtypes)["bid"]
    cells = balls.sparkSession.sparkContext.broadcast((index.pivots, index.size, index.lo, index.hi, index.blocks))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, size, lo, hi, blocks = cells.value
        for pdf in batches:
            for s in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[s : s + QUERY_ROWS]
                if not len(pivots):
                    yield part.assign(cell=-1, block=0, inside=0)
                    continue
                sq, err = _squares(_matrix(part["vec"]), pivots, pivots.mean(axis=0))
                upper, r = np.sqrt(np.maximum(sq + err, 0.0)), part["radius"].to_numpy()[:, None]
                whole = upper + hi * (1.0 + 1e-12) <= r * (1.0 - 1e-9)
                yield part.assign(cell=-1, block=0, inside=whole @ size)
                open_cells = (_lower_bounds(sq, err, pivots, lo, hi, upper) <= r * (1.0 + 1e-9)) & ~whole & (size > 0)
                q, cell = np.nonzero(open_cells)
                reps = blocks[cell]
                q, cell = np.repeat(q, reps), np.repeat(cell, reps)
                block = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
                for e in range(0, len(q), 20_000):
                    yield part.iloc[q[e : e + 20_000]].assign(cell=cell[e : e + 20_000], block=block[e : e + 20_000], inside=0)

    full = balls.select("bid", "vec", F.col("radius").cast("double").alias("radius")).where("radius IS NOT NULL AND vec IS NOT NULL")
    visits = cut_lineage(full.mapInPandas(plan, f"bid {kind}, vec array<double>, radius double, cell int, block int, inside long"))

    def count(run: pd.DataFrame, vecs: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bid": run["bid"], "inside": _inside(_matrix(run["vec"]), run["radius"].to_numpy(), vecs, weights)})

    searched = _search_blocks(visits.where("cell >= 0").drop("inside"), index, count, f"bid {kind}, inside long", hot_visits)
    return searched.unionByName(visits.where("cell < 0").select("bid", "inside")).groupBy("bid").agg(F.sum("inside").alias("inside"))


def _search_blocks(visits: DataFrame, index: CellIndex, work: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, hot_visits: int) -> DataFrame:
    """``work`` on the visits (bid, vec, radius, cell, block) of each block and its points; blocks with very many visits are salted."""
    at, kind = ["cell", "block", "salt"], dict(visits.dtypes)["bid"]
    busy = visits.groupBy("cell", "block").agg(F.count("*").alias("n")).where(F.col("n") > hot_visits)
    salts = F.broadcast(busy.select("cell", "block", F.ceil(F.col("n") / hot_visits).cast("int").alias("_salts")))  # at most visits / hot_visits rows
    many = F.coalesce(F.col("_salts"), F.lit(1))
    left = visits.join(salts, ["cell", "block"], "left").withColumn("salt", F.pmod(F.xxhash64("bid"), many).cast("int"))
    right = index.points.join(salts, ["cell", "block"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    stream = right.select(*at, F.lit(0).alias("side"), F.lit(None).cast(kind).alias("bid"), "vec", F.lit(None).cast("double").alias("radius"), "weight").unionByName(
        left.select(*at, F.lit(1).alias("side"), "bid", "vec", "radius", F.lit(None).cast("long").alias("weight")))
    width = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartition(width, *at).sortWithinPartitions(*at, "side")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, vecs, weights = None, [], []
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            change = (pdf[at] != pdf[at].shift()).any(axis=1) | (pdf["side"] != pdf["side"].shift())
            bounds = [*np.flatnonzero(change.to_numpy()), len(pdf)]
            for s, e in zip(bounds[:-1], bounds[1:]):
                run = pdf.iloc[s:e]
                key = tuple(run[at].iloc[0])
                if key != here:
                    here, vecs, weights = key, [], []
                if run["side"].iloc[0] == 0:
                    vecs.append(_matrix(run["vec"]))
                    weights.append(run["weight"].to_numpy().astype(np.int64))
                elif vecs:
                    yield work(run, np.vstack(vecs), np.concatenate(weights))

    return ordered.mapInPandas(search, schema)


def rim_distances(balls: DataFrame, index: CellIndex, hot_visits: int = HOT_VISITS) -> DataFrame:
    """(bid, inner, outer): the largest distance of a point inside each closed ball and the smallest outside it.

    Each ball is compared with all points, a block at a time: for few balls.
    """
    kind = dict(balls.dtypes)["bid"]
    places = [(int(c), b) for c in np.flatnonzero(index.size > 0) for b in range(int(index.blocks[c]))]
    # one row per block
    every = balls.sparkSession.createDataFrame(places, "cell int, block int")
    visits = balls.select("bid", "vec", F.col("radius").cast("double").alias("radius")).join(F.broadcast(every))

    def rim(run: pd.DataFrame, vecs: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
        rows = []
        for bid, vec, radius in zip(run["bid"], _matrix(run["vec"]), run["radius"]):
            diff = vecs - vec
            dist = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
            rows.append((bid, dist[dist <= radius].max(initial=-np.inf), dist[dist > radius].min(initial=np.inf)))
        return pd.DataFrame(rows, columns=["bid", "inner", "outer"])

    found = _search_blocks(visits, index, rim, f"bid {kind}, inner double, outer double", hot_visits)
    return found.groupBy("bid").agg(F.max("inner").alias("inner"), F.min("outer").alias("outer"))


def below_half_median(cases: DataFrame, points: DataFrame, **how) -> DataFrame:
    """(bid, near): whether the distance of a case (bid, vec, distance) is less than half the median of its distances to all points (pid, vec).

    The median itself is not needed: it exceeds twice the distance if fewer than half of the points lie in
    the ball of that radius, which is a count over cells. Only where exactly half of an even number lies
    inside do the two middle distances decide.
    """
    index = build_index(points.groupBy("vec").agg(F.min("pid").alias("pid"), F.count("*").alias("weight")), **how)
    n = int(index.size.sum())
    balls = cut_lineage(cases.select("bid", "vec", "distance", (F.col("distance") * 2).alias("radius")))
    counted = cut_lineage(balls.join(ball_counts(balls, index), "bid"))
    inside = F.col("inside")
    if n % 2:
        return counted.select("bid", (inside <= n // 2).alias("near"))
    clear = counted.where(inside != n // 2).select("bid", (inside < n // 2).alias("near"))
    even = counted.where(inside == n // 2)
    rim = rim_distances(even, index)
    middle = (F.col("inner") + F.col("outer")) / 2
    return clear.unionByName(even.join(rim, "bid").select("bid", (F.col("distance") < middle / 2).alias("near")))


# ---- approximate neighbours --------------------------------------------------------------


def nearest_approximate(queries: DataFrame, index: CellIndex, k: int, probes: int, exclude_self: bool = False, hot_visits: int = HOT_VISITS) -> DataFrame:
    """(qid, rank, pid, distance): the k nearest points among those in the ``probes`` cells whose pivots are nearest.

    Each query visits ``probes`` cells whatever the number of points, so the work grows with the
    queries and the size of a cell; ``neighbor_recall`` measures what that misses.
    """
    cells = queries.sparkSession.sparkContext.broadcast((index.pivots, index.size, index.blocks))
    text = dict(index.points.dtypes)["pid"] == "string"
    need = k + 1 if exclude_self else k
    reps = queries.groupBy("vec").agg(F.min("qid").alias("rep"), F.count("*").alias("n"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, size, blocks = cells.value
        full = np.flatnonzero(size > 0)
        for pdf in batches:
            for s in range(0, len(pdf) if len(full) else 0, QUERY_ROWS):
                part = pdf.iloc[s : s + QUERY_ROWS]
                sq = _squares(_matrix(part["vec"]), pivots[full], pivots.mean(axis=0))[0]
                near = full[np.argsort(sq, axis=1, kind="stable")[:, :probes]]
                q, cell = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel()
                n = blocks[cell]
                q, cell = np.repeat(q, n), np.repeat(cell, n)
                block = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                for e in range(0, len(q), 20_000):
                    yield part.iloc[q[e : e + 20_000]].assign(cell=cell[e : e + 20_000], block=block[e : e + 20_000], reach=np.inf)

    visits = cut_lineage(reps.select("vec").mapInPandas(probe, "vec array<double>, cell int, block int, reach double"))
    seen = _scan(visits, index.points.select("cell", "block", "pid", "vec"), need, [], text, hot_visits)
    return _spread(queries, reps, _merged_lists(seen.select("vec", _near()), need, []), k, [], exclude_self)


def neighbor_recall(queries: DataFrame, points: DataFrame, found: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(n_queries, n_exact, n_found, recall): approximate neighbours no farther than the exact k-th, against the exact search over all points."""
    exact = cut_lineage(knn_join(queries, points, k, exclude_self=exclude_self))
    reach = exact.groupBy("qid").agg(F.max("distance").alias("reach"), F.count("*").alias("n"))
    hits = reach.join(found.join(queries.select("qid"), "qid", "left_semi"), "qid", "left").groupBy("qid").agg(
        F.first("n").alias("n"), F.count_if(F.col("distance") <= F.col("reach") * (1.0 + 1e-12)).alias("hits"))
    out = hits.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_exact"), F.sum(F.least("n", "hits")).alias("n_found"))
    return out.select("*", (F.col("n_found") / F.col("n_exact")).alias("recall"))


def recall_curve(queries: DataFrame, points: DataFrame, index: CellIndex, k: int, exclude_self: bool = False) -> DataFrame:
    """(probes, recall): what share of the exact neighbours lies in the first 1, 2, ... cells of their queries.

    One exact search for the given queries, a sample of them as a rule; the index must hold all ``points``.
    """
    exact = knn_join(queries, points, k, exclude_self=exclude_self).select("qid", "pid")
    placed = exact.join(index.points.select("pid", "cell"), "pid").join(queries.select("qid", "vec"), "qid").select("vec", "cell")
    cells = queries.sparkSession.sparkContext.broadcast((index.pivots, index.size))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, size = cells.value
        full = np.flatnonzero(size > 0)
        for pdf in batches:
            for s in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[s : s + QUERY_ROWS]
                order = full[np.argsort(_squares(_matrix(part["vec"]), pivots[full], pivots.mean(axis=0))[0], axis=1, kind="stable")]
                yield pd.DataFrame({"probes": 1 + np.argmax(order == part["cell"].to_numpy()[:, None], axis=1)})

    counted = placed.mapInPandas(rank, "probes int").groupBy("probes").agg(F.count("*").alias("n"))
    steps = queries.sparkSession.range(1, len(index.pivots) + 1).select(F.col("id").cast("int").alias("probes")).join(counted, "probes", "left")  # one row per cell
    upto = Window.orderBy("probes").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    return steps.select("probes", (F.coalesce(F.sum("n").over(upto), F.lit(0)) / total).alias("recall"))


def fit_probes(curve: DataFrame, recall: float = 0.9) -> int:
    """The fewest probes that reach a recall."""
    return curve.where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
