"""Cell index, balls, approximate neighbours and distribution measures against plain numpy."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import cells as C
from semblance.operators import distribution as D
from semblance.operators.neighbors import knn_join


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def samples(seed=1, n=400, m=300, d=3):
    rnd = np.random.default_rng(seed)
    real = np.vstack([rnd.normal(size=(n, d)), rnd.normal(3, 0.2, size=(n // 2, d))])
    real[20:60] = real[5]  # copies
    syn = np.vstack([rnd.normal(size=(m, d)), np.repeat(real[:1], 50, axis=0), rnd.normal(40, 1, size=(7, d))])
    return real, syn


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "pivots": 30}])
def test_ball_counts(spark, options):
    real, syn = samples()
    rnd = np.random.default_rng(2)
    radii = rnd.choice([0.0, 0.3, 1.0, 6.0, 100.0], len(real))
    balls = spark.createDataFrame([(i, [float(v) for v in x], float(r)) for i, (x, r) in enumerate(zip(real, radii))] + [(9999, [0.0, 0.0, 0.0], None)], "bid long, vec array<double>, radius double")
    points = frame(spark, syn).withColumnRenamed("id", "pid")
    want = (distances(real, syn) <= radii[:, None]).sum(axis=1)
    for hot in (200_000, 10):
        got = {r.bid: r.inside for r in C.ball_counts(balls, C.build_index(points, **options), hot).collect()}
        assert got == dict(enumerate(want.tolist()))
    empty = C.build_index(points.where(F.lit(False)))
    assert {r.inside for r in C.ball_counts(balls, empty).collect()} == {0}


@pytest.mark.parametrize("k", [1, 4])
def test_density_coverage(spark, k):
    real, syn = samples(3)
    d = distances(real, real)
    np.fill_diagonal(d, np.inf)
    radius = np.sort(d, axis=1)[:, k - 1]
    inside = distances(real, syn) <= radius[:, None]
    row = D.density_coverage(frame(spark, real), frame(spark, syn, 10_000), k, scaled=False).first()
    assert row.density == pytest.approx(inside.sum() / (k * len(syn))) and row.coverage == pytest.approx(inside.any(axis=1).mean())
    few = D.density_coverage(frame(spark, real[:k]), frame(spark, syn), k, scaled=False).first()
    assert (few.density, few.coverage) == (0.0, 0.0)


def test_index_round_trip_and_probes(spark, tmp_path):
    real, syn = samples(4)
    points, queries = frame(spark, real).withColumnRenamed("id", "pid"), frame(spark, syn).withColumnRenamed("id", "qid")
    index = C.build_index(points, block_rows=11, pivots=20)
    index.save(os.path.join(tmp_path, "index"))
    again = C.CellIndex.load(spark, os.path.join(tmp_path, "index"))
    m = len(index.pivots)
    exact = {(r.qid, r["rank"]): r.distance for r in knn_join(queries, points, 3).collect()}
    for probes in (1, 3, m):
        found = [C.nearest_approximate(queries, i, 3, probes) for i in (index, again)]
        rows = [sorted(map(tuple, f.collect())) for f in found]
        assert rows[0] == rows[1]
        recall = C.neighbor_recall(queries, points, found[0], 3).first()
        assert recall.n_queries == len(syn) and recall.n_exact == 3 * len(syn)
        within = sum(r[3] <= exact[r[0], 3] * (1 + 1e-12) for r in rows[0])
        assert recall.n_found == within and recall.recall == within / recall.n_exact
        if probes == m:
            assert recall.recall == 1.0 and {(q, r): d for q, r, _, d in rows[0]} == exact
    curve = {r.probes: r.recall for r in C.recall_curve(queries, points, index, 3).collect()}
    assert list(sorted(curve)) == list(range(1, m + 1)) and curve[m] == 1.0 and all(curve[i] <= curve[i + 1] for i in range(1, m))
    least = C.fit_probes(C.recall_curve(queries, points, index, 3), 0.9)
    assert curve[least] >= 0.9 and (least == 1 or curve[least - 1] < 0.9)
    with pytest.raises(ValueError):
        knn_join(queries.withColumn("g", F.lit(1)), points.withColumn("g", F.lit(1)), 3, by="g", probes=2)


def test_mmd_forms(spark):
    rnd = np.random.default_rng(5)
    a, near, far = rnd.normal(size=(300, 4)), rnd.normal(size=(200, 4)), rnd.normal(1.0, 1.5, size=(250, 4))

    def exact(x, y, width):
        k = lambda p, q: np.exp(-distances(p, q) ** 2 / (2 * width * width)).mean()
        return k(x, x) + k(y, y) - 2 * k(x, y)

    for other in (near, far):
        sides = frame(spark, a), frame(spark, other)
        row = D.mmd_exact(*sides, scaled=False).first()
        assert (row.n_real, row.n_syn, row.bandwidth) == (300, len(other), 2.0)
        assert row.mmd2 == pytest.approx(exact(a, other, 2.0), abs=1e-12)
        rough = D.mmd_random_features(*sides, features=1024, scaled=False).first()
        w, b = D.random_features(4, 1024, 2.0)
        z = [np.sqrt(2 / 1024) * np.cos(x @ w.T + b).mean(axis=0) for x in (a, other)]
        assert rough.mmd2 == pytest.approx(((z[0] - z[1]) ** 2).sum(), abs=1e-12)
        assert abs(math.sqrt(rough.mmd2) - math.sqrt(row.mmd2)) < 0.1
    with pytest.raises(ValueError):
        D.mmd_exact(*sides, rows=249)


def test_two_sample_test(spark):
    rnd = np.random.default_rng(6)
    mix = np.array([[1, 0.8, 0], [0, 0.6, 0], [0, 0, 1]])
    real = rnd.normal(size=(1500, 3)) @ mix
    cases = {"same": (rnd.normal(size=(1200, 3)) @ mix, 0.46, 0.54), "shift": (real[:1200] + 0.7, 0.65, 1.0), "spread": (rnd.normal(size=(1200, 3)) @ mix * 2, 0.65, 1.0), "unlinked": (rnd.normal(size=(1200, 3)), 0.6, 1.0)}
    for name, (syn, low, high) in cases.items():
        row = D.auc_test(D.two_sample_scores(frame(spark, real), frame(spark, syn, 5000))).first()
        assert low <= row.auc <= high, name
        assert (row.p > 0.01) == (name == "same") and (row.n_real, row.n_syn) == (1500, 1200)


def test_auc_test_with_ties(spark):
    rnd = np.random.default_rng(7)
    rows = [(int(rnd.integers(0, 2)), int(rnd.integers(0, 3)), float(rnd.integers(0, 6))) for _ in range(400)] + [(1, 7, 0.5), (1, 0, None)]
    got = D.auc_test(spark.createDataFrame(rows, "label int, fold int, score double")).first()
    wins = pairs = null = spread = 0.0
    for f in range(3):
        x = np.array([s for y, g, s in rows if y == 1 and g == f and s is not None])
        y = np.array([s for y, g, s in rows if y == 0 and g == f])
        v = (x[:, None] > y) + 0.5 * (x[:, None] == y)
        wins, pairs, n = wins + v.sum(), pairs + v.size, len(x) + len(y)
        t = np.unique(np.concatenate([x, y]), return_counts=True)[1]
        null += v.size / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1)))
        spread += (v.mean(axis=1).var(ddof=1) / len(x) + v.mean(axis=0).var(ddof=1) / len(y)) * v.size**2
    assert got.auc == pytest.approx(wins / pairs) and got.se == pytest.approx(math.sqrt(spread) / pairs)
    z = (wins / pairs - 0.5) / (math.sqrt(null) / pairs)
    assert got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_support_curve(spark):
    real, syn = samples(8, 200, 150)
    rows = D.support_curve(frame(spark, real), frame(spark, syn, 1000), 10, scaled=False).collect()
    cr, cs = real.mean(axis=0), syn.mean(axis=0)
    dist = lambda x, c: np.sqrt(((x - c) ** 2).sum(axis=1))
    d = distances(real, real)
    np.fill_diagonal(d, np.inf)
    cross = distances(real, syn)
    met = cross.min(axis=1) <= d.min(axis=1)
    own = dist(syn, cs)
    for r in rows:
        assert r.precision == pytest.approx((dist(syn, cr) <= np.quantile(dist(real, cr), r.level) + 1e-12).mean(), abs=0.011)
        assert r.recall == pytest.approx((met & (own[cross.argmin(axis=1)] <= np.quantile(own, r.level) + 1e-9)).mean(), abs=0.006)
    perfect = D.support_scores(spark.createDataFrame([(i / 4, i / 4, i / 4) for i in range(5)], "level double, precision double, recall double")).first()
    assert tuple(perfect) == (1.0, 1.0)
    none = D.support_scores(spark.createDataFrame([(i / 4, 0.0, 1.0) for i in range(5)], "level double, precision double, recall double")).first()
    assert none.alpha_precision == pytest.approx(0.0) and none.beta_recall == pytest.approx(0.0)


@pytest.mark.parametrize("n", [40, 41])
def test_below_half_median(spark, n):
    rnd = np.random.default_rng(n)
    points = rnd.normal(size=(n, 2))
    points[5:9] = points[4]
    line = np.array([[float(i), 0.0] for i in range(n)])  # distances tie, and half of them often lie inside
    for x in (points, line):
        d = distances(x, x)
        cases, want = [], []
        for i in range(n):
            for step in (0.0, d[i].min(), float(np.median(d[i])) / 2, float(np.sort(d[i])[n // 2 - 1]) / 2, float(np.sort(d[i])[n // 2]) / 2 * 0.999999, 1.0, 3.7):
                cases.append((len(cases), [float(v) for v in x[i]], float(step)))
                want.append(bool(step < np.median(d[i]) / 2))
        got = C.below_half_median(spark.createDataFrame(cases, "bid long, vec array<double>, distance double"), frame(spark, x).withColumnRenamed("id", "pid"), block_rows=6, pivots=9)
        assert {r.bid: r.near for r in got.collect()} == dict(enumerate(want))


def test_exact_discrepancy_of_many_rows(spark):
    """Sides of any size, in pairs of blocks; copies are weighted points on both sides of a pair."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 40, (20_500, 2)) / 10.0, rng.integers(0, 40, (300, 2)) / 12.0
    sides = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(s)], "id long, vec array<double>") for s in (a, b)]

    def mean(x, y):
        return np.mean([np.exp(-((y - row) ** 2).sum(axis=1) / 8.0).mean() for row in x])

    (ua, ca), other = np.unique(a, axis=0, return_counts=True), mean(b, a)
    own = sum(c * (np.exp(-((ua - v) ** 2).sum(axis=1) / 8.0) @ ca) for v, c in zip(ua, ca)) / len(a) ** 2
    for block_rows in (20_000, 150):
        row = D.mmd_exact(*sides, bandwidth=2.0, scaled=False, block_rows=block_rows).first()
        assert (row.n_real, row.n_syn) == (20_500, 300)
        assert row.mmd2 == pytest.approx(own + mean(b, b) - 2 * other, abs=1e-11)


def test_exact_discrepancy_copies_no_point_on_disk(spark):
    """What is shuffled does not grow with the number of blocks."""
    rng = np.random.default_rng(3)
    frames = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 3)))], "id long, vec array<double>") for _ in range(2)]

    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())}

    def run(block_rows):
        before = on_disk()
        found = D.mmd_exact(*frames, scaled=False, block_rows=block_rows).first()["mmd2"]
        return found, sum(n for f, n in on_disk().items() if f not in before and f.startswith("shuffle") and f.endswith(".data"))

    (whole, once), (cut, many) = run(1_000), run(40)
    assert abs(whole - cut) < 1e-12 and 0 < once and many < 2 * once
