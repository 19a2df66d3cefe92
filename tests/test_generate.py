import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.functions.arrays import log_one_hot
from semblance.operators import diffusion as D
from semblance.operators import oversample as O
from semblance.operators import synthesizer as Y


@pytest.mark.parametrize("steps", [1, 10, 1000])
def test_schedule(steps):
    v = D.noise_schedule(steps).values
    assert (np.diff(v["abar"]) < 0).all() and v["post_var"][0] == 0
    assert v["beta"].min() >= 1e-4 and v["beta"].max() <= 0.9999


def toy(spark, n=4000):
    i = F.col("id")
    from semblance.functions.rand import normal, uniform

    a = F.when(uniform("c", i) < 0.7, 0).otherwise(1)
    return spark.range(n).select("id", a.alias("code"), (a * 0.8 - 0.4 + 0.2 * normal("x", i)).alias("x"), (0.3 * normal("y", i)).alias("y"))


def test_sampling_is_partition_free_and_close(spark):
    df = toy(spark)
    model = Y.fit_synthesizer(df, ["x", "y"], {"code": 2}, condition="code")
    sched = D.noise_schedule(100)
    out = Y.sample_synthesizer(spark, model, sched, 6000, block=1000)
    one = out.orderBy("row").collect()
    assert one == Y.sample_synthesizer(spark, model, sched, 6000, block=1000).repartition(3).orderBy("row").collect()
    assert len(one) == 6000
    got, want = out.agg(F.avg("x"), F.stddev("x"), F.avg("code")).first(), df.agg(F.avg("x"), F.stddev("x"), F.avg("code")).first()
    assert abs(got[0] - want[0]) < 0.05 and abs(got[1] - want[1]) < 0.08 and abs(got[2] - want[2]) < 0.05
    assert Y.sample_synthesizer(spark, model, sched, 500, label="1").agg(F.avg("code")).first()[0] > 0.95


def test_smote_rows_lie_on_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0 if i < 200 else 1, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(230, 2)))]
    df = spark.createDataFrame(rows, "id long, c int, x double, y double")
    new = O.smote(df, F.col("id"), ["x", "y"], "c").collect()
    assert len(new) == 170 and {r.c for r in new} == {1}
    pts = np.array([r[2:] for r in rows[200:]])
    for r in new[:40]:
        a, b = pts[:, None], pts[None]
        p = np.array([r.x, r.y])
        gap = np.abs(np.linalg.norm(a - p, axis=2) + np.linalg.norm(b - p, axis=2) - np.linalg.norm(a - b, axis=2))
        assert gap.min() < 1e-9
    with pytest.raises(ValueError):
        O.smote(df.where("c = 0 OR id = 200"), F.col("id"), ["x", "y"], "c")


def test_smogn_follows_its_plan(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(size=400), rng.normal(size=20) + 8])
    df = spark.createDataFrame([(i, float(rng.normal()), float(v)) for i, v in enumerate(y)], "id long, x double, y double")
    plan = {r.region: r.kept + r.added for r in O.smogn_regions(df, "y").collect()}
    got = {r.region: r["count"] for r in O.smogn(df, F.col("id"), ["x"], "y").groupBy("region").count().collect()}
    assert got == plan


def test_label_dropout_by_row_and_by_batch(spark):
    df = toy(spark, 600).withColumn("label", F.lit("a"))
    run = lambda **kw: D.training_pairs(df, ["x"], {"code": 2}, D.noise_schedule(20), F.col("id"), label="label", **kw)
    share = run(label_dropout=0.3).agg(F.avg(F.col("label").isNull().cast("int"))).first()[0]
    assert 0.2 < share < 0.4
    assert run(label_dropout=0.3, batch_size=50).where("label IS NULL").count() == 0
    assert run(label_dropout=1.0, batch_size=50).where("label IS NOT NULL").count() == 0
    post = run(repeats=2).select(F.aggregate(F.transform("post_code", F.exp), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert post.count() == 1200 and post.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_sampler_draws_depend_on_rows_only(spark):
    import numpy as np

    from semblance.functions.rand import Counter
    from semblance.operators import diffusion as D
    from semblance.operators import synthesizer as Y

    draws, rows = Counter(7, np.arange(20_000), 4), np.array([3, 19_999])
    z = draws.normal(5, 0, 3)
    assert np.array_equal(Counter(7, rows, 4).normal(5, 0, 3), z[rows])
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.03
    assert not np.array_equal(Counter(7, rows + (1 << 32), 4).normal(5, 0, 3), z[rows])
    data = spark.range(400).selectExpr("id", "cast(id % 3 as int) code", "if(id % 2 = 0, 'a', 'b') y", "id / 200.0D - 1 x", "cos(id) z")
    model = Y.fit_synthesizer(data, ["x", "z"], {"code": 3}, condition="y")
    for variant in ("posterior", "simple"):
        out = [sorted(map(tuple, Y.sample_synthesizer(spark, model, D.noise_schedule(6), 100, variant=variant, block=b).collect())) for b in (4096, 7)]
        assert [x[0] for x in out[0]] == list(range(100)) and [(x[0], x[3]) for x in out[0]] == [(x[0], x[3]) for x in out[1]]
        assert np.allclose([x[1:3] for x in out[0]], [x[1:3] for x in out[1]])


def test_denoiser_matches_brute_force_and_shares_only_on_request():
    """Weights and expectations component by component; category shares are worked out only for steps that draw from them."""
    rng = np.random.default_rng(5)
    means, probs = rng.normal(size=(3, 2)), rng.dirichlet(np.ones(4), 3)
    covs = np.array([a @ a.T + 0.1 * np.eye(2) for a in rng.normal(size=(3, 2, 2))])
    model = Y.Synthesizer(("x", "y"), ("c",), ("a", "b", "c"), np.array([0.2, 0.3, 0.5]), means, covs, (probs,))
    sched = D.noise_schedule(10)
    denoiser = Y._Denoiser(model, sched, np.arange(3))
    x, c = rng.normal(size=(5, 2)), rng.integers(0, 4, 5)
    lines = np.vstack([x.T, np.ones(5)])
    for t in (0, 4, 9):
        a = sched.values["abar"][t]
        clean, (shares,) = denoiser(lines, [c], t, True)
        assert denoiser(lines, [c], t, False)[1] == []
        for i in range(5):
            plain, seen, moved = [], [], []
            for k in range(3):
                s, gap = a * covs[k] + (1 - a) * np.eye(2), x[i] - np.sqrt(a) * means[k]
                plain.append(model.weights[k] * np.exp(-0.5 * gap @ np.linalg.solve(s, gap)) / np.sqrt(np.linalg.det(s)))
                seen.append(plain[k] * (a * probs[k, c[i]] + (1 - a) / 4))
                moved.append(means[k] + np.sqrt(a) * covs[k] @ np.linalg.solve(s, gap))
            assert np.allclose(clean[:, i], np.array(seen) @ moved / sum(seen), rtol=1e-9)
            assert np.allclose(shares[:, i], np.array(plain) @ probs / sum(plain), rtol=1e-9)


@pytest.mark.parametrize("k", [1, 2, 3, 6, 20])
def test_training_pairs_equal_the_array_forms(spark, k):
    schedule = D.noise_schedule(20)
    df = spark.range(400).select("id", (F.col("id") / 200 - 1).alias("x"), F.when(F.col("id") % 37 != 0, F.col("id") % (k + 1)).cast("int").alias("code"))
    got = D.training_pairs(df, ["x"], {"code": k}, schedule, F.col("id"), repeats=2)
    share = F.col("abar")
    block = D.log_mix_uniform(log_one_hot(F.col("code"), k), share, k)
    whole = D.with_schedule(got, schedule, ("abar", "alpha", "abar_prev")).select(
        "post_code", "xt_code", D.gumbel_sample(block, k, F.col("pair"), "42/cat/code").alias("xt"),
        D.posterior_categorical(log_one_hot(F.col("code"), k), log_one_hot(F.col("xt_code"), k), k).alias("post"))
    rows = whole.collect()
    assert len(rows) == 800 and all(r.xt_code == r.xt for r in rows)
    assert np.allclose([r.post_code for r in rows], [r.post for r in rows], atol=1e-9)


def test_draws_of_few_categories_need_no_lambda(spark):
    df = spark.range(10).select("id", F.lit(0.5).alias("x"), (F.col("id") % 3).cast("int").alias("code"))
    out = D.training_pairs(df, ["x"], {"code": 3}, D.noise_schedule(20), F.col("id")).select("xt_code")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    drawn = [line for line in plan.splitlines() if "md5(" in line]
    assert drawn and not any("lambda" in line for line in drawn)
