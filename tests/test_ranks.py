import numpy as np
from pyspark.sql import functions as F

from semblance.functions.rand import draw_index
from semblance.operators.frames import lookup
from semblance.operators.layout import fit_dictionary
from semblance.operators.ranks import cdf_distances, exact_quantiles, hash_cut, number_groups, number_rows, running_counts, with_bucket


def skewed(spark, n=3000):
    """A third of all rows share one value."""
    rng = np.random.default_rng(1)
    v = np.where(np.arange(n) % 3 == 0, 5.0, np.round(rng.normal(size=n) * 10, 1))
    return v, spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")


def test_quantiles_by_bucket_equal_the_plain_ones(spark):
    v, df = skewed(spark)
    probs = [0, 0.01, 0.25, 0.5, 0.777, 0.99, 1]
    for small in (0, 10**6):
        got = exact_quantiles(df, ["v"], probs, small=small, buckets=16)["v"]
        assert np.allclose(got, np.quantile(v, probs))


def test_running_counts_by_bucket(spark):
    v, df = skewed(spark)
    long = df.select(F.lit("v").alias("column"), F.col("v").alias("value"))
    for small in (0, 10**6):
        rows = running_counts(long, "column", {"n": F.count("*")}, buckets=64, small=small).orderBy("value").collect()
        assert [r.cum_n for r in rows] == [int((v <= r.value).sum()) for r in rows]
        assert [r.after.value if r.after else None for r in rows] == [r.value for r in rows[1:]] + [None]
        assert {r.total_n for r in rows} == {len(v)}


def test_numbering_is_complete(spark):
    _, df = skewed(spark)
    numbered, n = number_rows(df, 1, F.col("i"))
    assert sorted(r.idx for r in numbered.collect()) == list(range(n)) == list(range(3000))
    grouped, sizes = number_groups(df.withColumn("g", F.col("i") % 2), 1, F.col("i"), "g")
    assert sizes == {0: 1500, 1: 1500}
    assert sorted((r.g, r.idx) for r in grouped.collect()) == [(g, i) for g in (0, 1) for i in range(1500)]


def test_cut_sizes_and_stability(spark):
    _, df = skewed(spark, 1001)
    one = {r.i for r in hash_cut(df, 42, F.col("i"), 0.2).where("is_test").collect()}
    two = {r.i for r in hash_cut(df.repartition(7), 42, F.col("i"), 0.2).where("is_test").collect()}
    assert one == two and len(one) == 201
    by = hash_cut(df.withColumn("g", F.col("i") % 3), 42, F.col("i"), 0.25, by="g").where("is_test").groupBy("g").count()
    assert {r["count"] for r in by.collect()} == {84}


def test_lookup_beyond_the_broadcast_limit(spark):
    left = spark.range(30_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long"))
    right = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup(left, right, ["k"], limit=100)
    row = got.agg(F.count("*").alias("n"), F.count("v").alias("hit"), F.sum((F.col("v") == F.col("k") * 2).cast("int")).alias("ok")).first()
    want = left.where("k < 20000").count()
    assert (row.n, row.hit, row.ok) == (30_000, want, want)


def test_null_class_is_split_and_numbered(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 > 0 THEN cast(id % 2 AS string) END AS c")
    flagged = hash_cut(df, 42, F.col("id"), 0.2, by="c")
    got = {r["c"]: (r["n"], r["t"]) for r in flagged.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {None: (250, 50), "0": (250, 50), "1": (500, 100)}
    numbered, sizes = number_groups(df, 1, F.col("id"), "c")
    assert sizes == {None: 250, "0": 250, "1": 500}
    assert sorted(r.idx for r in numbered.where("c IS NULL").collect()) == list(range(250))


def test_lookup_keeps_null_keys_out_of_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(30000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id END AS k")
        right = spark.range(30000).selectExpr("id AS k", "id * 2 AS v")
        out = lookup(left, right, ["k"], limit=10)
        assert out.count() == 30000
        assert out.where("v = 2 * id").count() == 20000 and out.where("k IS NULL AND v IS NULL").count() == 10000
        assert lookup(left, right, ["k"], limit=10, how="inner").count() == 20000
        # rows that a join shuffles: none has a null key, so they spread evenly
        keyed = out.where("k IS NOT NULL").groupBy(F.spark_partition_id()).count().where("count > 0").collect()
        assert max(r["count"] for r in keyed) < 3 * 20000 / len(keyed)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_draws_of_a_huge_range_reach_odd_and_even_rows(spark):
    n = 10**12
    got = [r[0] for r in spark.range(4000).select(draw_index("s", F.col("id"), n)).collect()]
    odd = sum(g % 2 for g in got)
    assert 0 <= min(got) and max(got) < n and len(set(got)) == 4000 and 1800 < odd < 2200


def test_bucket_of_many_series_and_odd_values(spark):
    edges = {f"s{i}": sorted({float(j * (i + 1)) for j in range(i % 9)}) for i in range(100)}
    cells = [(f"s{i}", v) for i in range(100) for v in (-1.0, 0.0, 3.5, 7.0, 1e9, float("nan"), None)] + [("other", 1.0)]
    got = with_bucket(spark.createDataFrame(cells, "s string, value double"), edges, "s").collect()
    assert len(got) == len(cells)
    for r in got:
        own = edges.get(r.s, [])
        want = 0 if r.value is None else len(own) if r.value != r.value else sum(e <= r.value for e in own)
        assert r._bucket == want


def test_dictionary_ranks_over_ranges(spark):
    words = spark.range(5000).selectExpr("md5(cast(id % 3000 as string)) as a", "cast(id % 7 as string) as b")
    got = {(r.column, r.value): r.idx for r in fit_dictionary(words, ["a", "b"]).collect()}
    for c in "ab":
        assert [got[c, v] for v in sorted(r[0] for r in words.select(c).distinct().collect())] == list(range(words.select(c).distinct().count()))
    assert fit_dictionary(words.limit(0), ["a"]).count() == 0


def cdf_by_definition(a, b):
    """(ks, cross, area) from both CDFs at every value."""
    v = np.unique(np.concatenate([a, b]))
    ra, rb = np.searchsorted(np.sort(a), v, side="right"), np.searchsorted(np.sort(b), v, side="right")
    gap = np.abs(ra / len(a) - rb / len(b))
    return gap.max(), int(np.abs(ra * len(b) - rb * len(a)).max()), float((gap[:-1] * np.diff(v)).sum())


def test_cdf_distances_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    steps = rng.integers(0, 11, 4000) / 100
    pairs = [
        (steps, steps[rng.integers(0, 4000, 3000)] + rng.normal(size=3000) * 0.003), (rng.normal(size=4000), rng.normal(size=3000)),
        (rng.normal(size=4000), rng.normal(size=3000) + 5), (np.full(4000, 7.0), np.full(3000, 7.0)), (np.round(rng.normal(size=4000)), np.full(3000, -0.0)),
    ]
    real = spark.createDataFrame([tuple(float(p[0][i]) for p in pairs) for i in range(4000)], [f"x{j}" for j in range(5)]).repartition(3)
    syn = spark.createDataFrame([tuple(float(p[1][i]) for p in pairs) for i in range(3000)], [f"x{j}" for j in range(5)]).repartition(5)
    for buckets in (2, 64, 4096):
        got = cdf_distances(real, syn, real.columns, area=True, buckets=buckets)
        for g, (a, b) in zip(got, pairs, strict=True):
            ks, cross, area = cdf_by_definition(a, b)
            assert (g["n_real"], g["n_syn"], g["cross"]) == (4000, 3000, cross)
            assert np.isclose(g["ks"], ks, atol=1e-12) and np.isclose(g["area"], area, atol=1e-9)


def test_cdf_distances_order_few_values(spark, monkeypatch):
    """Values far from the largest gap and from any change of sign are counted, not ordered one by one."""
    from semblance.operators import ranks

    ordered, inside = [], ranks._inside_buckets
    monkeypatch.setattr(ranks, "_inside_buckets", lambda frames, edges, inner, spans: ordered.append((len(spans), sum(map(len, inner)))) or inside(frames, edges, inner, spans))
    real, syn = (spark.range(20_000).select(F.sqrt((F.col("id") + s) * m).alias("x")) for s, m in ((0, 1.0), (1, 1.3)))
    got = cdf_distances(real, syn, ["x"], area=True, buckets=256)[0]
    a, b = np.sqrt(np.arange(20_000.0)), np.sqrt(np.arange(1, 20_001) * 1.3)
    assert np.allclose([got["ks"], got["area"]], [cdf_by_definition(a, b)[i] for i in (0, 2)])
    assert sum(n for n, _ in ordered) <= 25 and all(m >= 200 for _, m in ordered)


def test_cdf_distances_with_gaps_and_infinities(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, None, nan, inf, -inf), (2.0, None, 1.0, 1.0, 1.0), (None, None, 2.0, 2.0, 2.0)]
    real = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    syn = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0), (2.0, 2.0, 2.0, 2.0, 2.0)], real.schema)
    a, b, c, d, e = cdf_distances(real, syn, real.columns, area=True)
    assert (a["n_real"], a["n_syn"], a["ks"], a["area"]) == (2, 2, 0.0, 0.0)
    assert (b["n_real"], b["n_syn"], b["ks"], b["area"]) == (0, 2, None, None)
    assert np.isclose(c["ks"], 1 / 3) and np.isnan(c["area"])
    assert np.isclose(d["ks"], 1 / 3) and np.isnan(d["area"])
    assert np.isclose(e["ks"], 1 / 3) and e["area"] == inf
    assert cdf_distances(real.select("b"), real.select("b"), ["b"]) == []
