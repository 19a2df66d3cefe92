import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import fidelity as H
from semblance.operators import models as M
from semblance.operators import privacy as V
from semblance.operators.diffusion import sample_health
from semblance.operators.utility import regression_metrics


def nums(spark, n, f):
    return spark.range(n).select("id", f(F.col("id")).cast("double").alias("x"))


def test_ks_bounds_and_collapse(spark):
    a, far, flat = nums(spark, 400, lambda i: i % 50), nums(spark, 300, lambda i: i + 1000), nums(spark, 300, lambda i: F.lit(7))
    ks = lambda s: H.ks_two_sample(a, s, ["x"]).first()
    assert ks(a).ks == 0 and ks(a).verdict == "PASS"
    assert ks(far).ks == 1 and ks(far).verdict == "FAIL"
    assert ks(flat).verdict == "FAIL"


def test_chi_square_needs_counts(spark):
    real = spark.range(1000).select(F.when(F.col("id") < 500, "a").otherwise("b").alias("c"))
    fake = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("c"))
    assert H.chi_square(real, fake, ["c"]).first().verdict == "FAIL"
    assert H.chi_square(real, fake, ["c"], on="shares").first().verdict == "PASS"
    gone = real.where("c = 'a'")
    assert H.chi_square(gone, real, ["c"]).first().verdict == "FAIL"


def test_collapsed_sample_is_flagged(spark):
    good = nums(spark, 200, lambda i: i / 100 - 1)
    assert not sample_health(good, good, ["x"]).first().collapsed
    assert sample_health(nums(spark, 200, lambda i: F.lit(0.5)), good, ["x"]).first().collapsed


def dist(spark, member, other):
    rows = [("0", "member", str(i), float(d)) for i, d in enumerate(member)] + [("0", "nonmember", str(i), float(d)) for i, d in enumerate(other)]
    return spark.createDataFrame(rows, "run string, role string, id string, distance double")


def test_auc_and_tpr(spark):
    assert V.attack_auc(dist(spark, [1, 2, 3], [1, 2, 3])).first().auc == 0.5
    assert V.attack_auc(dist(spark, [0, 0.1, 0.2], [1, 2, 3])).first().auc == 1.0
    tied = V.tpr_at_fpr(dist(spark, [1, 1, 2], [1, 3, 3]), drop_collinear=False).first()
    assert tied.tpr_at_1_fpr == pytest.approx(2 / 3)


def test_training_set_as_synthetic_is_caught(spark):
    from semblance.functions.rand import normal

    rows = spark.range(400).select("id", F.array(normal("a", F.col("id")), normal("b", F.col("id"))).alias("vec"))
    train, hold = rows.where("id < 200"), rows.where("id >= 200")
    out = V.privacy_verdict(V.attack_distances(train, hold, train)).first()
    assert out.auc > 0.95 and not out.safe and out.band == "warning"
    assert V.distance_to_closest_record(train, train).first().n_copies == 200


def test_r2_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, prediction double")
    assert regression_metrics(df, "y").first().r2 == 0
    assert regression_metrics(df.withColumn("y", F.lit(1.0)), "y").first().r2 is None


def test_logistic_models_by_key(spark):
    import math
    import random

    from semblance.operators.privacy import fit_logistic_by

    rnd = random.Random(3)
    data = {k: [(rnd.gauss(0, 2), 0) for _ in range(80)] + [(rnd.gauss(m, 2), 1) for _ in range(n)] for k, m, n in (("a", 1.0, 60), ("b", -3.0, 9), ("c", 0.0, 80))}
    data |= {"apart": [(float(i), int(i >= 10)) for i in range(20)], "far": [(1000.0 + i, i % 2) for i in range(30)]}
    rows = [(k, x, y) for k, v in data.items() for x, y in v] + [("a", None, 1)]
    got = fit_logistic_by(spark.createDataFrame(rows, "g string, x double, y int"), "g", "x", "y")
    assert set(got) == set(data)
    for k, (a, b) in got.items():
        p = [(1 / (1 + math.exp(-(a + b * x))), x, y) for x, y in data[k]]
        size = sum(abs(x) for x, _ in data[k])
        assert abs(sum(q - y for q, _, y in p)) < 1e-6 * len(p) and abs(sum((q - y) * x for q, x, y in p) + b) < 1e-6 * size
    only = fit_logistic_by(spark.createDataFrame([("z", 1.0, 1), ("z", 2.0, 1)], "g string, x double, y int"), "g", "x", "y")
    assert only["z"][0] > 5


def test_moments_add_up_and_linear_scores(spark):
    import numpy as np

    from semblance.operators import models as M
    from semblance.operators import utility as U

    rnd = np.random.default_rng(4)

    def rows(n, shift):
        x = rnd.normal(shift, 1 + shift, size=(n, 3))
        return np.column_stack([x, x @ [1.0, -2.0, 0.5] + rnd.normal(size=n)])

    a, b, t = rows(300, 0), rows(40, 3), rows(100, 1)
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)] * gap, "u double, v double, w double, y double") for x, gap in ((a, 0), (b, 2), (t, 0))]
    spec = {"all": U.LinearSpec(("u", "v", "w")), "two": U.LinearSpec(("w", "u"), 50.0)}
    moments = U.scenario_moments({"a": frames[0], "b": frames[1]}, {"a": ["a"], "both": ["a", "b"], "none": []}, ["u", "v", "w", "y"])
    both = np.vstack([a, b])
    assert np.allclose(moments["both"].mean, both.mean(axis=0)) and np.allclose(moments["both"].cov, np.cov(both.T, bias=True)) and moments["none"].n == 0
    out = U.tstr_linear({"a": frames[0], "b": frames[1]}, {"a": ["a"], "both": ["a", "b"]}, frames[2], spec, "y")
    one_by_one = U.tstr({"a": frames[0], "both": frames[0].unionByName(frames[1]).dropna()}, frames[2], {m: M.ridge(s.cols, "y", s.alpha) for m, s in spec.items()}, "y")
    got, want = ({(r.model, r.scenario): (r.n, r.rmse, r.mae, r.r2) for r in x.collect()} for x in (out, one_by_one))
    assert set(got) == set(want) and len(got) == 4
    for k in got:
        assert got[k] == pytest.approx(want[k])
    fit = moments["a"].ridge(("u", "v", "w"), "y")
    test_moments = M.keyed_moments(frames[2].withColumn("k", F.lit(1)), "k", ["y", "u", "v", "w"])[1]
    assert test_moments.r2(fit, "y") == pytest.approx(got["all", "a"][3])


def test_attack_runs_share_one_search(spark):
    from semblance.functions.rand import normal

    rows = spark.range(300).select("id", F.array(normal("a", F.col("id")), normal("b", F.col("id"))).alias("vec"))
    train, hold, far = rows.where("id < 150"), rows.where("id >= 150"), rows.where("id < 70").select("id", F.transform("vec", lambda x: x * 3 + 1).alias("vec"))
    runs = {"x": (train, hold, train), "y": (train, hold, far)}
    for k in (1, 2):
        got = sorted(map(tuple, V.attack_distances_by_run(runs, k).collect()))
        want = sorted(tuple(r) for n, one in runs.items() for r in V.attack_distances(*one, k, n).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_exact_ks_law_against_enumeration():
    from itertools import combinations

    from semblance.functions.special import ks_exact_tail

    for m, n in ((1, 1), (3, 4), (5, 5), (2, 7), (6, 4)):
        gaps = []
        for real in combinations(range(m + n), m):
            i, worst = 0, 0
            for s in range(m + n):
                i += s in real
                worst = max(worst, abs(i * n - (s + 1 - i) * m))
            gaps.append(worst)
        for gap in sorted(set(gaps)):
            assert ks_exact_tail(m, n, gap) == pytest.approx(sum(g >= gap for g in gaps) / len(gaps))
    assert ks_exact_tail(40, 40, 1600) == pytest.approx(2 / math.comb(80, 40)) and ks_exact_tail(5, 9, 0) == 1.0


def test_ks_methods(spark):
    a, b = nums(spark, 60, lambda i: (i * 37) % 61), nums(spark, 40, lambda i: (i * 29) % 53 + 4)
    auto, exact, asymptotic, few = [H.ks_two_sample(a, b, ["x"], m, rows).first() for m, rows in (("auto", 10_000), ("exact", 1), ("asymptotic", 10_000), ("auto", 59))]
    assert auto == exact and asymptotic == few and auto.ks == asymptotic.ks and auto.p_value != asymptotic.p_value


def test_training_rows_are_dealt_out_where_few_partitions_hold_them(spark):
    """As many partitions as cores, but one with nearly all rows: the estimator sees even ones."""
    from semblance.operators import models as M

    width, seen = spark.sparkContext.defaultParallelism, []

    class Fake:
        def fit(self, data):
            seen.append([len(p) for p in data.select("x").rdd.glom().collect()])

    def make(_):
        return Fake()

    def rows(n):
        # the partition of the first key holds all rows but a few
        return spark.range(n).select("id", F.rand(1).alias("x")).repartition(width, F.when(F.col("id") < 10, F.col("id")).otherwise(0))

    M._mllib(make, ["x"])(rows(120_000).localCheckpoint())
    M._mllib(make, ["x"])(rows(5_000).localCheckpoint())
    assert sum(seen[0]) == 120_000 and max(seen[0]) <= 2 * 120_000 / width
    assert max(seen[1]) > 4_900


def test_partial_moments_merge_exactly_per_key(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3)) + 1e6
    rows = [(("a", "b")[i % 3 == 0], *map(float, r)) for i, r in enumerate(x)] + [(None, 1.0, 2.0, 3.0), ("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, u double, v double, w double").repartition(7)
    got = M.keyed_moments(df, "k", ["u", "v", "w"])
    for k, mine in (("a", np.arange(4000) % 3 != 0), ("b", np.arange(4000) % 3 == 0)):
        assert got[k].n == mine.sum()
        assert np.allclose(got[k].mean, x[mine].mean(axis=0), rtol=1e-14)
        assert np.allclose(got[k].cov, np.cov(x[mine].T, bias=True), rtol=1e-7, atol=1e-9)
    assert got[None].n == 1 and np.allclose(M.Moments.of(("u",), x[:, :1]).mean, x[:, 0].mean())
