"""Registered queries: preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.operators import layout as L
from semblance.operators import prepare as P
from semblance.operators.frames import cut_lineage
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, GAPPY, NUMERIC, TARGET, R, gappy_lines, lines, rounded
from semblance.plans.registry import query, table

DIMS = (*NUMERIC, TARGET)
SPLIT = S.split(f"({S.LINE})", "k")
_SPLIT = f"WITH s AS ({SPLIT}), tr AS (SELECT * FROM s WHERE NOT is_test)"


def split_lines(spark, d):
    return P.split_random(lines(spark, d), F.col("k"))


def train_and_all(spark, d):
    s = split_lines(spark, d)
    return s.where("NOT is_test"), s


@query("d01_impute_median", f"""WITH g AS ({GAPPY}), s AS ({S.split('g', 'k')})
 SELECT k, {R('coalesce(l_quantity, (SELECT median(l_quantity) FROM s WHERE NOT is_test))')} AS l_quantity FROM s""")
def d01(spark, d):
    s = P.split_random(gappy_lines(spark, d), F.col("k"))
    params = P.fit_median(s.where("NOT is_test"), ["l_quantity"])
    return rounded(P.impute(s, params).select("k", "l_quantity"))


@query("d02_fill_missing_category", f"SELECT k, coalesce(l_returnflag, 'Missing') AS l_returnflag FROM ({GAPPY})")
def d02(spark, d):
    return P.fill_missing_category(gappy_lines(spark, d), ["l_returnflag"]).select("k", "l_returnflag")


@query("d03_group_rare", """WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
 SELECT p_partkey, CASE WHEN n >= 80 THEN p_brand ELSE 'Other' END AS p_brand FROM part JOIN n USING (p_brand)""")
def d03(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return P.group_rare(p, P.fit_frequent(p, ["p_brand"], 80), ["p_brand"])


@query("d04_drop_constant_categories", f"SELECT k, l_returnflag, l_linestatus FROM ({GAPPY})")
def d04(spark, d):
    g = gappy_lines(spark, d).select("k", "l_returnflag", "l_linestatus", "plant")
    return P.drop_constant_categories(g, ["l_returnflag", "l_linestatus", "plant"])


@query("d05_label_encode", """SELECT p_partkey, p_brand, cast(dense_rank() OVER (ORDER BY p_brand) - 1 AS integer) AS p_brand_code,
 p_type, cast(dense_rank() OVER (ORDER BY p_type) - 1 AS integer) AS p_type_code FROM part""")
def d05(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return L.label_encode(p, L.fit_dictionary(p, ["p_brand", "p_type"]), ["p_brand", "p_type"]).select(
        "p_partkey", "p_brand", "p_brand_code", "p_type", "p_type_code")


TYPES = "SELECT *, cast(dense_rank() OVER (ORDER BY p_type) - 1 AS integer) AS code FROM part"


@query("d06_one_hot", f"""SELECT p_partkey, cast(i AS integer) AS i, CASE WHEN code = i THEN 1.0::double ELSE 0.0::double END AS v
 FROM ({TYPES}), range((SELECT count(DISTINCT p_type) FROM part)) AS r(i)""")
def d06(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    dic = L.fit_dictionary(p, ["p_type"])
    k = L.cardinalities(dic)["p_type"]
    coded = L.label_encode(p, dic, ["p_type"])
    return coded.select("p_partkey", F.posexplode(L.one_hot(F.col("p_type_code"), k)).alias("i", "v"))


@query("d07_one_hot_decode", f"""SELECT doc_id, cast(list_position(b, list_max(b)) - 1 AS integer) AS code FROM (
 SELECT doc_id, [floor(3 * {S.uniform('b0', 'doc_id')}), floor(3 * {S.uniform('b1', 'doc_id')}), floor(3 * {S.uniform('b2', 'doc_id')})] AS b FROM documents)""")
def d07(spark, d):
    from semblance.functions.arrays import argmax
    from semblance.functions.rand import uniform

    docs = table(spark, d, "documents").select("doc_id")
    block = F.array(*[F.floor(F.lit(3) * uniform(f"b{i}", F.col("doc_id"))) for i in range(3)])
    return docs.select("doc_id", argmax(block).alias("code"))


def _clip(c: str) -> str:
    return f"greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM tr)), (SELECT quantile_cont({c}, 0.01) FROM tr))"


@query("d08_clip_percentile", f"{_SPLIT} SELECT k, is_test, " + ", ".join(f"{R(_clip(c), 4)} AS {c}" for c in DIMS) + " FROM s")
def d08(spark, d):
    # quantiles take several passes, so the split is written once
    every = cut_lineage(split_lines(spark, d).select("k", "is_test", *DIMS))
    train = every.where("NOT is_test")
    return rounded(P.clip(every, P.fit_clip(train, DIMS)).select("k", "is_test", *DIMS), 4)


def _minmax(c: str, x: str | None = None, src: str = "tr") -> str:
    lo, hi = f"(SELECT min({c}) FROM {src})", f"(SELECT max({c}) FROM {src})"
    return f"(({x or c} - {lo}) / ({hi} - {lo}) * 2 - 1)"


@query("d09_minmax_scale", f"{_SPLIT} SELECT k, is_test, " + ", ".join(f"{R(_minmax(c))} AS {c}" for c in DIMS) + " FROM s")
def d09(spark, d):
    train, every = train_and_all(spark, d)
    return rounded(P.scale(every, P.fit_minmax(train, DIMS)).select("k", "is_test", *DIMS))


@query("d09_minmax_inverse", f"{_SPLIT} SELECT k, {R(TARGET, 4)} AS {TARGET} FROM s")
def d09i(spark, d):
    train, every = train_and_all(spark, d)
    params = P.fit_minmax(train, [TARGET])
    return rounded(P.unscale(P.scale(every, params), params).select("k", TARGET), 4)


# knots of the quantile map are listed once; a value's rank interpolates between them, ties from both sides
def _cdf_sql(src: str, c: str, n: int) -> str:
    return f"""q AS (SELECT quantile_cont({c}, list_transform(range({n}), lambda i: i / {n - 1}.0::double)) AS a FROM {src}),
 kn AS (SELECT unnest(a) AS v, unnest(range({n})) AS i FROM q),
 u AS (SELECT v, min(i) AS lo, max(i) AS hi FROM kn GROUP BY v),
 seg AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS nv, lead(lo) OVER (ORDER BY v) AS nlo FROM u),
 cdf AS (SELECT x.k, x.{c} AS x, CASE WHEN x.{c} = s.v THEN (s.lo + s.hi) / 2.0::double
   WHEN s.nv IS NULL THEN s.hi ELSE s.hi + (x.{c} - s.v) / (s.nv - s.v) * (s.nlo - s.hi) END / {n - 1} AS p
   FROM {src} x ASOF JOIN seg s ON x.{c} >= s.v)"""


_EVENTS = "SELECT event_id AS k, value FROM events"
_QN = f"WITH e AS ({_EVENTS}), {_cdf_sql('e', 'value', 1000)}"
_PROBIT = S.probit("greatest(least(p, 1 - 1e-7), 1e-7)")


def _quantile(spark, d, mode):
    e = table(spark, d, "events").select(F.col("event_id").alias("k"), "value")
    return e, P.fit_quantile_normal(e, ["value"], mode)


@query("d10_quantile_normal_bounded", f"{_QN} SELECT k, {R(f'greatest(least({_PROBIT}, 3), -3) / 3')} AS value FROM cdf")
def d10b(spark, d):
    e, params = _quantile(spark, d, "bounded")
    return rounded(P.scale(e, params))


@query("d10_quantile_normal_raw", f"{_QN} SELECT k, {R(_PROBIT)} AS value FROM cdf")
def d10r(spark, d):
    e, params = _quantile(spark, d, "raw")
    return rounded(P.scale(e, params))


@query("d10_quantile_normal_clip3", f"{_QN} SELECT k, {R(f'greatest(least({_PROBIT}, 3), -3)')} AS value FROM cdf")
def d10c(spark, d):
    e, params = _quantile(spark, d, "clip3")
    return rounded(P.scale(e, params))


@query("d10_quantile_inverse", f"SELECT event_id AS k, {R('value', 4)} AS value FROM events")
def d10i(spark, d):
    e, params = _quantile(spark, d, "raw")
    return rounded(P.unscale(P.scale(e, params), params), 4)


@query("d11_standard_scale", f"{_SPLIT} SELECT k, is_test, " + ", ".join(
    f"{R(f'({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_pop({c}) FROM tr)')} AS {c}" for c in DIMS) + " FROM s")
def d11(spark, d):
    train, every = train_and_all(spark, d)
    return rounded(P.scale(every, P.fit_standard(train, DIMS)).select("k", "is_test", *DIMS))


@query("d11_standard_scale_bounded", "SELECT event_id, " + R(
    "greatest(least((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 3), -3) / 3") + " AS value FROM events")
def d11b(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return rounded(P.scale(e, P.fit_standard(e, ["value"], bounded=True)))


@query("d12_split_random", f"SELECT k, is_test FROM ({SPLIT})")
def d12(spark, d):
    return split_lines(spark, d).select("k", "is_test")


@query("d12_split_threshold", f"SELECT k, {S.uniform(42, 'k')} < 0.2 AS is_test FROM ({S.LINE})")
def d12t(spark, d):
    return P.split_threshold(lines(spark, d), F.col("k")).select("k", "is_test")


@query("d13_split_stratified", f"SELECT doc_id, quality, is_test FROM ({S.split('labels', 'cast(doc_id AS varchar)', by='quality')})")
def d13(spark, d):
    return P.split_stratified(table(spark, d, "labels"), F.col("doc_id"), "quality").select("doc_id", "quality", "is_test")


@query("d13_split_null_class", f"SELECT k, l_returnflag, is_test FROM ({S.split(f'({GAPPY})', 'k', by='l_returnflag')})")
def d13_null(spark, d):
    return P.split_stratified(gappy_lines(spark, d), F.col("k"), "l_returnflag").select("k", "l_returnflag", "is_test")


def line_layout(spark, d):
    df = lines(spark, d).select("k", *DIMS, *CATS)
    dic = L.fit_dictionary(df, CATS)
    layout = L.Layout(NUMERIC, TARGET, CATS, L.cardinalities(dic))
    return L.label_encode(df, dic, CATS), layout, dic


CODED = f"""SELECT *, cast(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS integer) AS l_returnflag_code,
 cast(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS integer) AS l_linestatus_code FROM ({S.LINE})"""
_HYBRID = f"""SELECT k, [l_quantity, l_discount, l_tax, l_extendedprice] || list_transform(range(3), lambda i: (i = l_returnflag_code)::double)
 || list_transform(range(2), lambda i: (i = l_linestatus_code)::double) AS h FROM ({CODED})"""


@query("d14_assemble", f"SELECT k, cast(len(h) AS integer) AS n, " + ", ".join(f"h[{i + 1}] AS h{i}" for i in range(9)) + f" FROM ({_HYBRID})")
def d14(spark, d):
    df, layout, _ = line_layout(spark, d)
    h = L.assemble(df, layout, keep=["k"])
    return h.select("k", F.size("hybrid").alias("n"), *[F.col("hybrid")[i].alias(f"h{i}") for i in range(9)])


@query("d15_disassemble", f"SELECT k, {', '.join(DIMS)}, l_returnflag_code, l_linestatus_code FROM ({CODED})")
def d15(spark, d):
    df, layout, _ = line_layout(spark, d)
    return L.disassemble(L.assemble(df, layout, keep=["k"]), layout, keep=["k"])


_MM = f"""{_SPLIT}, sc AS (SELECT k, is_test, {_minmax('l_extendedprice')} AS x FROM s), g AS (SELECT * FROM sc WHERE is_test), t AS (SELECT * FROM sc WHERE NOT is_test)
 SELECT k, {R('greatest(least((x - (SELECT avg(x) FROM g)) / ((SELECT stddev_pop(x) FROM g) + 1e-8) * (SELECT stddev_pop(x) FROM t) + (SELECT avg(x) FROM t), 1), -1)')} AS x FROM g"""


@query("d16_match_moments", _MM)
def d16(spark, d):
    train, every = train_and_all(spark, d)
    scaled = P.scale(every, P.fit_minmax(train, [TARGET])).select("k", "is_test", F.col(TARGET).alias("x"))
    out = P.match_moments(scaled.where("is_test"), scaled.where("NOT is_test"), ["x"])
    return rounded(out.select("k", "x"))


@query("d17_decode_synthetic", f"SELECT k, {', '.join(R(c, 4) + ' AS ' + c for c in DIMS)}, l_returnflag, l_linestatus FROM ({S.LINE})")
def d17(spark, d):
    df, layout, dic = line_layout(spark, d)
    xs, ys = P.fit_minmax(df, NUMERIC), P.fit_minmax(df, [TARGET])
    hybrid = L.assemble(P.scale(P.scale(df, xs), ys), layout, keep=["k"])
    rows = L.disassemble(hybrid, layout, keep=["k"])
    return rounded(P.decode_synthetic(rows, xs, ys, dic, CATS).select("k", *DIMS, *CATS), 4)
