"""Registered queries: fidelity and privacy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.functions.rand import uniform
from semblance.operators import fidelity as H
from semblance.operators import layout as L
from semblance.operators import privacy as V
from semblance.operators import sampling as A
from semblance.operators.frames import cut_lineage
from semblance.operators.neighbors import knn_join
from semblance.operators.prepare import split_random
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, NUMERIC, TARGET, R, rounded
from semblance.plans.registry import query, table
from semblance.plans.sampling_queries import DIMS, line_cols, noisy_lines, noisy_sql

_SYN = noisy_sql()


def _copy(spark, d):
    """The noisy copy, written once: the reports read it several times."""
    return cut_lineage(noisy_lines(spark, d).select(*DIMS, *CATS))


def _each(fmt, cols=DIMS) -> str:
    return " UNION ALL ".join(fmt(c) for c in cols)


def _mom(c: str, side: str, src: str) -> str:
    return ", ".join(
        f"{R(f'(SELECT {fn}({c}) FROM {src})', 4)} AS {side}_{n}" for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("h01_compare_moments", f"WITH {_SYN} " + _each(lambda c: f"SELECT '{c}' AS \"column\", {_mom(c, 'real', 'lineitem')}, {_mom(c, 'syn', 'syn')}"))
def h01(spark, d):
    return rounded(H.compare_moments(line_cols(spark, d), _copy(spark, d), DIMS), 4)


_STEPS = f"""long AS ({_each(lambda c: f"SELECT '{c}' AS col, {c} AS v, 1 AS r FROM lineitem UNION ALL SELECT '{c}', {c}, 0 FROM syn")}),
 cnt AS (SELECT col, v, sum(r) AS nr, sum(1 - r) AS ns FROM long GROUP BY 1, 2),
 st AS (SELECT col, v, lead(v) OVER w AS nv, sum(nr) OVER w / sum(nr) OVER (PARTITION BY col) AS fr, sum(ns) OVER w / sum(ns) OVER (PARTITION BY col) AS fs,
   sum(nr) OVER (PARTITION BY col) AS tr, sum(ns) OVER (PARTITION BY col) AS ts FROM cnt WINDOW w AS (PARTITION BY col ORDER BY v)),
 ks AS (SELECT col, max(abs(fr - fs)) AS ks, cast(max(tr) AS bigint) AS n_real, cast(max(ts) AS bigint) AS n_syn,
   sum(abs(fr - fs) * (coalesce(nv, v) - v)) AS w1 FROM st GROUP BY col)"""
_LAM = "ks * sqrt(n_real * n_syn / (n_real + n_syn)::double)"
_P = (f"CASE WHEN {_LAM} < 0.2 THEN 1.0::double ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda j: "
      f"(CASE WHEN j % 2 = 1 THEN 2.0::double ELSE -2.0::double END) * exp(-2.0::double * j * j * ({_LAM}) * ({_LAM})))), 0), 1) END")


@query("h02_ks_two_sample", f"""WITH {_SYN}, {_STEPS}, p AS (SELECT *, {_P} AS p FROM ks)
 SELECT col AS "column", {R('ks')} AS ks, n_real, n_syn, {R('p')} AS p_value, CASE WHEN p > 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""")
def h02(spark, d):
    return rounded(H.ks_two_sample(line_cols(spark, d), _copy(spark, d), DIMS, method="asymptotic"))


# halves of the customers, one of them also shifted: the exact law by lattice paths, a diagonal per step
_BALANCES = f"""cu AS (SELECT c_acctbal, {S.uniform('ks', 'c_custkey')} < 0.5 AS r FROM customer),
 long AS (SELECT 'c_acctbal' AS col, c_acctbal AS v, r::int AS r FROM cu UNION ALL SELECT 'shifted', c_acctbal + CASE WHEN r THEN 0 ELSE 300 END, r::int FROM cu),
 cnt AS (SELECT col, v, sum(r)::bigint AS nr, sum(1 - r)::bigint AS ns FROM long GROUP BY 1, 2),
 st AS (SELECT col, sum(nr) OVER w AS cr, sum(ns) OVER w AS cs, sum(nr) OVER (PARTITION BY col) AS m, sum(ns) OVER (PARTITION BY col) AS n FROM cnt WINDOW w AS (PARTITION BY col ORDER BY v)),
 ks AS (SELECT col, max(m)::bigint AS m, max(n)::bigint AS n, max(abs(cr / m - cs / n)) AS ks, max(abs(cr * n - cs * m))::bigint AS gap FROM st GROUP BY col),
 lat AS (SELECT col, m, n, gap, 0::bigint AS s, 0::bigint AS i, 0.0::double AS met FROM ks
  UNION ALL SELECT col, m, n, gap, s + 1, j, CASE WHEN abs(j * (n + m) - (s + 1) * m) >= gap THEN 1.0::double ELSE sum(part) END FROM (
   SELECT col, m, n, gap, s, i AS j, met * (s + 1 - i) / (s + 1) AS part FROM lat WHERE s < m + n UNION ALL SELECT col, m, n, gap, s, i + 1, met * (i + 1) / (s + 1) FROM lat WHERE s < m + n)
  WHERE j <= m AND s + 1 - j <= n GROUP BY col, m, n, gap, s, j)"""


@query("h02_ks_exact", f"""WITH RECURSIVE {_BALANCES} SELECT ks.col AS "column", {R('ks')} AS ks, m AS n_real, n AS n_syn, {R('met')} AS p_value, CASE WHEN met > 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict
 FROM ks JOIN (SELECT col, met FROM lat WHERE s = m + n AND i = m) USING (col)""")
def h02x(spark, d):
    first = uniform("ks", F.col("c_custkey")) < 0.5
    c = table(spark, d, "customer").select("c_acctbal", first.alias("r"), (F.col("c_acctbal") + F.when(first, 0).otherwise(300)).alias("shifted"))
    return rounded(H.ks_two_sample(c.where("r"), c.where("NOT r"), ["c_acctbal", "shifted"]))


_SHARES = f"""cl AS ({_each(lambda c: f"SELECT '{c}' AS col, {c} AS value, 1 AS r FROM lineitem UNION ALL SELECT '{c}', {c}, 0 FROM syn", CATS)}),
 cc AS (SELECT col, value, cast(sum(r) AS bigint) AS n_real, cast(sum(1 - r) AS bigint) AS n_syn FROM cl GROUP BY 1, 2),
 sh AS (SELECT *, n_real / sum(n_real) OVER w AS share_real, n_syn / sum(n_syn) OVER w AS share_syn, sum(n_syn) OVER w AS total_syn FROM cc WINDOW w AS (PARTITION BY col))"""


@query("h03_category_shares", f"""WITH {_SYN}, {_SHARES} SELECT col AS "column", value, n_real, n_syn, {R('share_real')} AS share_real, {R('share_syn')} AS share_syn FROM sh""")
def h03s(spark, d):
    return rounded(H.category_shares(line_cols(spark, d), _copy(spark, d), CATS).drop("total_syn"))


def _chi(size: str) -> str:
    g, o = f"(share_syn + 1e-10) * {size}", f"(share_real + 1e-10) * {size}"
    return f"""WITH {_SYN}, {_SHARES} SELECT col AS "column", {R(f'sum(({g} - {o}) * ({g} - {o}) / ({o}))')} AS chi2, count(*) AS n_categories FROM sh GROUP BY col"""


@query("h03_chi_square", _chi("total_syn"))
def h03c(spark, d):
    return rounded(H.chi_square(line_cols(spark, d), _copy(spark, d), CATS).select("column", "chi2", "n_categories"))


@query("h03_chi_square_shares", _chi("1.0"))
def h03p(spark, d):
    return rounded(H.chi_square(line_cols(spark, d), _copy(spark, d), CATS, on="shares").select("column", "chi2", "n_categories"))


# the tail with one degree of freedom is erfc(sqrt(chi2 / 2)), here by the series of erf; with two it is exp(-chi2 / 2)
_X2 = "sum(((share_syn + 1e-10) - (share_real + 1e-10)) * ((share_syn + 1e-10) - (share_real + 1e-10)) * total_syn / (share_real + 1e-10))"
_ERF = """2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda n: exp(-chi2 / 2 + 2 * n * ln(2) + (n + 0.5::double) * ln(chi2 / 2) + lgamma(n + 1) - lgamma(2 * n + 2))))"""
_TAIL = f"CASE WHEN n_categories = 3 THEN exp(-chi2 / 2) WHEN chi2 <= 0 THEN 1.0::double WHEN chi2 > 80 THEN 0.0::double ELSE 1 - {_ERF} END"


@query("h03_chi_square_verdict", f"""WITH {_SYN}, {_SHARES}, x AS (SELECT col, {_X2} AS chi2, count(*) AS n_categories FROM sh GROUP BY col),
 p AS (SELECT *, {_TAIL} AS p FROM x) SELECT col AS "column", {R('chi2')} AS chi2, n_categories, {R('p')} AS p_value,
 CASE WHEN p > 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""")
def h03v(spark, d):
    return rounded(H.chi_square(line_cols(spark, d), _copy(spark, d), CATS))


@query("h03_chi_square_p_value", f"""WITH {_SYN}, {_SHARES}, x AS (SELECT col, {_X2} AS chi2, count(*) AS n_categories FROM sh GROUP BY col),
 p AS (SELECT *, {_TAIL} AS p FROM x) SELECT col AS "column", {R('p')} AS p_value FROM p""")
def h03x(spark, d):
    return rounded(H.chi_square(line_cols(spark, d), _copy(spark, d), CATS).select("column", "p_value"))


_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::double AS rr, 1.0::double AS rs" if a == b else
    f"(SELECT corr({a}, {b}) FROM lineitem) AS rr, (SELECT corr({a}, {b}) FROM syn) AS rs") for a in DIMS for b in DIMS)


@query("h04_corr_matrix_diff", f"""WITH {_SYN}, cells AS ({_CELLS}) SELECT {R('avg(abs(rr - rs))')} AS mean_abs_diff, {R('sqrt(sum((rr - rs) * (rr - rs)))')} AS frobenius FROM cells""")
def h04(spark, d):
    return rounded(H.corr_matrix_diff(line_cols(spark, d), _copy(spark, d), DIMS))


@query("h04_corr_pairs", f"""WITH {_SYN}, cells AS ({_CELLS}) SELECT a AS col_a, b AS col_b, {R('rr')} AS r_real, {R('rs')} AS r_syn, {R('abs(rr - rs)')} AS diff FROM cells""")
def h04p(spark, d):
    return rounded(H.corr_pairs(line_cols(spark, d), _copy(spark, d), DIMS))


@query("h05_corr_preservation", f"""WITH {_SYN}, cells AS ({_CELLS})
 SELECT CASE WHEN a = '{TARGET}' THEN b ELSE a END AS feature, CASE WHEN a = '{TARGET}' OR b = '{TARGET}' THEN '{TARGET}' ELSE b END AS against,
 {R('rr')} AS r_real, {R('rs')} AS r_syn, {R('abs(rr - rs)')} AS diff,
 CASE WHEN a = '{TARGET}' OR b = '{TARGET}' THEN CASE WHEN abs(rr - rs) < 0.1 THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM cells WHERE a < b""")
def h05(spark, d):
    return rounded(H.corr_preservation(line_cols(spark, d), _copy(spark, d), NUMERIC, TARGET))


@query("h05_corr_preserved", f"""WITH {_SYN}, cells AS ({_CELLS}) SELECT bool_and(abs(rr - rs) < 0.1) AS all_preserved, {R('max(abs(rr - rs))')} AS max_diff
 FROM cells WHERE a < b AND (a = '{TARGET}' OR b = '{TARGET}')""")
def h05f(spark, d):
    return rounded(H.corr_preserved(line_cols(spark, d), _copy(spark, d), NUMERIC, TARGET))


_HCOLS = ("l_quantity", "l_extendedprice")


def _hist(c: str, side: str, src: str, lo: str, hi: str) -> str:
    w = f"(({hi} - {lo}) / 20)"
    return f"""SELECT '{c}' AS col, '{side}' AS side, cast(i AS integer) AS bin, {lo} + i * {w} AS lft, count(b) AS n, count(b) / ((SELECT count(*) FROM {src}) * {w}) AS density
 FROM range(20) AS r(i) LEFT JOIN (SELECT least(floor(({c} - {lo}) / {w}), 19) AS b FROM {src}) ON b = i GROUP BY i"""


def _own(c, side, src):
    return _hist(c, side, src, f"(SELECT min({c}) FROM {src})", f"(SELECT max({c}) FROM {src})")


def _shared(c, side, src):
    both = f"(SELECT {{}}(v) FROM (SELECT {c} AS v FROM lineitem UNION ALL SELECT {c} FROM syn))"
    return _hist(c, side, src, both.format("min"), both.format("max"))


_SIDES = (("real", "lineitem"), ("syn", "syn"))


@query("h06_histogram_overlay", f"""WITH {_SYN}, hh AS ({' UNION ALL '.join(_own(c, s, t) for c in _HCOLS for s, t in _SIDES)})
 SELECT col AS "column", side, bin, {R('lft', 4)} AS "left", n AS count, {R('density')} AS density FROM hh""")
def h06(spark, d):
    return rounded(H.histogram_overlay(line_cols(spark, d), _copy(spark, d), _HCOLS), 6, left=4)


@query("h07_column_distance", f"""WITH {_SYN}, {_STEPS}, hh AS ({' UNION ALL '.join(_shared(c, s, t) for c in DIMS for s, t in _SIDES)}),
 hs AS (SELECT col, bin, sum(n) FILTER (WHERE side = 'real') AS a, sum(n) FILTER (WHERE side = 'syn') AS b FROM hh GROUP BY 1, 2),
 hp AS (SELECT col, a / sum(a) OVER (PARTITION BY col) + 1e-10 AS p, b / sum(b) OVER (PARTITION BY col) + 1e-10 AS q FROM hs),
 kl AS (SELECT col, sum(p * ln(p / q)) AS kl FROM hp GROUP BY col),
 mo AS ({_each(lambda c: f"SELECT '{c}' AS col, abs((SELECT avg({c}) FROM lineitem) - (SELECT avg({c}) FROM syn)) AS md, abs((SELECT stddev_pop({c}) FROM lineitem) - (SELECT stddev_pop({c}) FROM syn)) AS sd")})
 SELECT col AS "column", {R('ks')} AS ks, {R('w1', 4)} AS wasserstein, {R('md', 4)} AS mean_diff, {R('sd', 4)} AS std_diff, {R('kl')} AS kl FROM ks JOIN kl USING (col) JOIN mo USING (col)""")
def h07(spark, d):
    return rounded(H.column_distance(line_cols(spark, d), _copy(spark, d), DIMS), 6, wasserstein=4, mean_diff=4, std_diff=4)


@query("h08_category_distance", f"""WITH {_SYN}, {_SHARES}, m AS (SELECT *, (share_real + share_syn) / 2 AS m FROM sh)
 SELECT col AS "column", {R('sum(abs(share_real - share_syn)) / 2')} AS total_variation,
 {R('sum(CASE WHEN share_real > 0 THEN share_real * ln(share_real / m) ELSE 0 END + CASE WHEN share_syn > 0 THEN share_syn * ln(share_syn / m) ELSE 0 END) / 2')} AS js_divergence
 FROM m GROUP BY col""")
def h08(spark, d):
    return rounded(H.category_distance(line_cols(spark, d), _copy(spark, d), CATS))


# ---- neighbours ------------------------------------------------------------------------

_EMB = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


_KNN_SQL = f"""WITH e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings),
 p AS (SELECT a.vec_id AS qid, b.vec_id AS pid, sqrt({_EMB}) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id)
 SELECT qid, cast(row_number() OVER w AS integer) AS rank, pid, {R('dist')} AS distance FROM p WINDOW w AS (PARTITION BY qid ORDER BY dist, pid) QUALIFY row_number() OVER w <= 5"""


def _knn(spark, d, **options):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(knn_join(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "pid"), 5, exclude_self=True, **options))


@query("g01_knn_join", _KNN_SQL)
def g01(spark, d):
    return _knn(spark, d)


@query("g01_knn_join_cells", _KNN_SQL)
def g01_cells(spark, d):
    """The same search through cells, as large tables take it."""
    return _knn(spark, d, broadcast_bytes=0)


_MEAN_SQL = f"""WITH e AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
 p AS (SELECT a.vec_id AS qid, b.vec_id AS pid, sqrt({_EMB}) AS dist FROM e a, e b WHERE a.label = b.label AND a.vec_id <> b.vec_id),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, pid) <= 3)
 SELECT qid, {R('avg(dist)')} AS distance FROM k GROUP BY qid"""


def _mean_distance(spark, d, **options):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    near = knn_join(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "pid"), 3, by="label", exclude_self=True, **options)
    return rounded(near.groupBy("qid").agg(F.avg("distance").alias("distance")))


@query("g01_knn_mean_distance", _MEAN_SQL)
def g01m(spark, d):
    return _mean_distance(spark, d)


@query("g01_knn_mean_distance_cells", _MEAN_SQL)
def g01m_cells(spark, d):
    return _mean_distance(spark, d, broadcast_bytes=0)


# ---- privacy ---------------------------------------------------------------------------

PART_NUM, PART_TARGET, PART_CAT = ("p_size",), "p_retailprice", "p_type"
N_TYPES = 6


def part_parts(spark, d):
    """Coded parts, split 80/20, and their layout."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type")
    dic = L.fit_dictionary(p, [PART_CAT])
    layout = L.Layout(PART_NUM, PART_TARGET, (PART_CAT,), L.cardinalities(dic))
    s = split_random(L.label_encode(p, dic, [PART_CAT]), F.col("p_partkey"))
    return s.where("NOT is_test"), s.where("is_test"), layout


def part_copy(train, seed: int = 42, scale_by: float = 0.1):
    return A.noise_relative(train, F.col("p_partkey"), PART_NUM, PART_TARGET, scale_by=scale_by, seed=seed)


def part_features(spark, d, seed: int = 42, scale_by: float = 0.1):
    train, hold, layout = part_parts(spark, d)
    syn = part_copy(train, seed, scale_by)
    key = F.col("p_partkey")
    return (V.attack_features(train, layout, key), V.attack_features(hold, layout, key), V.attack_features(syn, layout, F.col("i")))


PARTS = "SELECT p_partkey, cast(p_size AS double) AS p_size, p_retailprice, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part"
PART_BASE = f"pc AS ({PARTS}), ps AS ({S.split('pc', 'cast(p_partkey AS varchar)')}), ptr AS (SELECT * FROM ps WHERE NOT is_test), pte AS (SELECT * FROM ps WHERE is_test)"


def part_syn_sql(seed: int = 42, scale_by: float = 0.1, tag: str = "") -> str:
    cols = ", ".join(f"{c} + {scale_by}::double * (SELECT stddev_pop({c}) FROM ptr) * {S.normal(f'{seed}/{c}', 'i')} AS {c}" for c in ("p_size", "p_retailprice"))
    return f"""pn{tag} AS ({S.numbered('ptr', seed, 'cast(p_partkey AS varchar)')}),
 psyn{tag} AS (SELECT i, {cols}, p_type, code FROM (SELECT i, {S.draw(seed, 'i', '(SELECT count(*) FROM ptr)')} AS idx FROM range((SELECT count(*) FROM ptr)) AS r(i)) JOIN pn{tag} USING (idx))"""


_VEC = ["p_size", "p_retailprice", *[f"(code = {j})::double" for j in range(N_TYPES)]]


def _scaled(id_col: str, src: str, by: str) -> str:
    cells = ", ".join(f"({x} - (SELECT avg({x}) FROM {by})) / coalesce(nullif((SELECT stddev_pop({x}) FROM {by}), 0), 1) AS x{j}" for j, x in enumerate(_VEC))
    return f"SELECT cast({id_col} AS varchar) AS id, {cells} FROM {src}"


_SQ = "sqrt(" + " + ".join(f"(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in range(len(_VEC))) + ")"


def attack_sql(tag: str = "", run: str = "0") -> str:
    """CTE att<tag>(run, role, id, distance); needs PART_BASE and psyn<tag>."""
    return f"""am{tag} AS ({_scaled('p_partkey', 'ptr', f'psyn{tag}')}), an{tag} AS ({_scaled('p_partkey', 'pte', f'psyn{tag}')}), asy{tag} AS ({_scaled('i', f'psyn{tag}', f'psyn{tag}')}),
 att{tag} AS (SELECT '{run}' AS run, 'member' AS role, a.id, min({_SQ}) AS distance FROM am{tag} a, asy{tag} b GROUP BY a.id
  UNION ALL SELECT '{run}', 'nonmember', a.id, min({_SQ}) FROM an{tag} a, asy{tag} b GROUP BY a.id)"""


def auc_sql(src: str, out: str) -> str:
    """CTEs ending in <out>(run, auc, member_mean, nonmember_mean, n_member, n_nonmember, tpr...)."""
    return f"""{out}_m AS (SELECT run, avg(distance) FILTER (WHERE role = 'member') AS mm, avg(distance) FILTER (WHERE role = 'nonmember') AS nm,
  count(*) FILTER (WHERE role = 'member') AS cm, count(*) FILTER (WHERE role = 'nonmember') AS cn FROM {src} GROUP BY run),
 {out}_c AS (SELECT run, CASE WHEN mm < nm THEN distance WHEN mm > nm THEN -distance ELSE 0 END AS v, count(*) FILTER (WHERE role = 'member') AS mem,
  count(*) FILTER (WHERE role = 'nonmember') AS non FROM {src} JOIN {out}_m USING (run) GROUP BY 1, 2),
 {out}_s AS (SELECT *, sum(mem) OVER w AS cum_mem, sum(non) OVER w AS cum_non, lead(mem) OVER w AS nmem, lead(non) OVER w AS nnon FROM {out}_c WINDOW w AS (PARTITION BY run ORDER BY v)),
 {out}_t AS (SELECT *, (nmem IS NULL OR nmem <> mem OR nnon <> non) AS corner FROM {out}_s JOIN {out}_m USING (run)),
 {out} AS (SELECT run, sum(mem * (cn - cum_non + non / 2)) / (max(cm) * max(cn)) AS auc, max(mm) AS member_mean, max(nm) AS nonmember_mean, max(cm) AS n_member, max(cn) AS n_nonmember,
  min(cum_mem / cm) FILTER (WHERE corner AND cum_non / cn >= 0.01) AS tpr1, min(cum_mem / cm) FILTER (WHERE corner AND cum_non / cn >= 0.05) AS tpr5,
  min(cum_mem / cm) FILTER (WHERE cum_non / cn >= 0.01) AS all1, min(cum_mem / cm) FILTER (WHERE cum_non / cn >= 0.05) AS all5 FROM {out}_t GROUP BY run)"""


_ATT = f"WITH {PART_BASE}, {part_syn_sql()}, {attack_sql()}"


def _distances(spark, d, seed: int = 42, run: str = "0", k: int = 1, scale_by: float = 0.1):
    train, hold, syn = part_features(spark, d, seed, scale_by)
    return V.attack_distances(train, hold, syn, k, run)


def part_runs(spark, d, runs):
    """Attack distances of several noise copies (run, seed, scale) of one training part, searched together."""
    train, hold, layout = part_parts(spark, d)
    train = cut_lineage(train)
    key = F.col("p_partkey")
    real = V.attack_features(train, layout, key), V.attack_features(hold, layout, key)
    return V.attack_distances_by_run({n: (*real, V.attack_features(part_copy(train, s, k), layout, F.col("i"))) for n, s, k in runs})


@query("p01_attack_features", f"WITH {PART_BASE} SELECT p_partkey AS id, " + ", ".join(f"{x} AS x{j}" for j, x in enumerate(_VEC)) + " FROM ptr")
def p01(spark, d):
    train, _, layout = part_parts(spark, d)
    f = V.attack_features(train, layout, F.col("p_partkey"))
    return f.select("id", *[F.col("vec")[j].alias(f"x{j}") for j in range(len(_VEC))])


@query("p02_attack_distances", f"{_ATT} SELECT run, role, id, {R('distance')} AS distance FROM att")
def p02(spark, d):
    return rounded(_distances(spark, d))


@query("p02_attack_distances_k3", f"""WITH {PART_BASE}, {part_syn_sql()}, am AS ({_scaled('p_partkey', 'ptr', 'psyn')}), an AS ({_scaled('p_partkey', 'pte', 'psyn')}), asy AS ({_scaled('i', 'psyn', 'psyn')}),
 pr AS (SELECT 'member' AS role, a.id, {_SQ} AS d, b.id AS pid FROM am a, asy b UNION ALL SELECT 'nonmember', a.id, {_SQ}, b.id FROM an a, asy b),
 nn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY role, id ORDER BY d, pid) <= 3)
 SELECT '0' AS run, role, id, {R('avg(d)')} AS distance FROM nn GROUP BY 2, 3""")
def p02k(spark, d):
    return rounded(_distances(spark, d, k=3))


@query("p03_attack_auc", f"{_ATT}, {auc_sql('att', 'res')} SELECT run, {R('auc')} AS auc FROM res")
def p03(spark, d):
    return rounded(V.attack_auc(_distances(spark, d)))


ROUNDS = 12
_P = "(1 / (1 + exp(-(a + b * distance))))"
_NEWTON = f"""nw AS (SELECT DISTINCT run, 0.0::double AS a, 0.0::double AS b, 0 AS step FROM {{src}}
  UNION ALL SELECT run, a + (ab * gb - bb * ga) / (aa * bb - ab * ab), b + (ab * ga - aa * gb) / (aa * bb - ab * ab), step + 1 FROM (
   SELECT run, a, b, step, sum({_P} - y) AS ga, sum(({_P} - y) * distance) + b AS gb, sum({_P} * (1 - {_P})) AS aa, sum({_P} * (1 - {_P}) * distance) AS ab, sum({_P} * (1 - {_P}) * distance * distance) + 1 AS bb
   FROM nw JOIN (SELECT run, distance, (role = 'member')::int AS y FROM {{src}}) USING (run) WHERE step < {ROUNDS} GROUP BY run, a, b, step))"""


def accuracy_sql(src: str) -> str:
    return f"SELECT run, {R('avg((((a + b * distance) > 0)::int = (role = ' + chr(39) + 'member' + chr(39) + ')::int)::int)')} AS accuracy FROM {src} JOIN nw USING (run) WHERE step = {ROUNDS} GROUP BY run"


@query("p04_attack_accuracy_runs", f"WITH RECURSIVE {PART_BASE}, " + ", ".join(f"{part_syn_sql(s, tag=f'_{s}')}, {attack_sql(f'_{s}', str(s))}" for s in (0, 42, 84))
       + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM att_{s}" for s in (0, 42, 84)) + f"), {_NEWTON.format(src='every')} {accuracy_sql('every')}")
def p04r(spark, d):
    """Three runs fitted together."""
    return rounded(V.attack_accuracy(part_runs(spark, d, [(str(s), s, 0.1) for s in (0, 42, 84)])))


@query("p04_attack_accuracy", f"{_ATT.replace('WITH', 'WITH RECURSIVE', 1)}, {_NEWTON.format(src='att')} {accuracy_sql('att')}")
def p04(spark, d):
    return rounded(V.attack_accuracy(_distances(spark, d)))


@query("p05_tpr_at_fpr", f"{_ATT}, {auc_sql('att', 'res')} SELECT run, {R('tpr1')} AS tpr_at_1_fpr, {R('tpr5')} AS tpr_at_5_fpr FROM res")
def p05(spark, d):
    return rounded(V.tpr_at_fpr(_distances(spark, d)))


@query("p05_tpr_at_fpr_all_points", f"{_ATT}, {auc_sql('att', 'res')} SELECT run, {R('all1')} AS tpr_at_1_fpr, {R('all5')} AS tpr_at_5_fpr FROM res")
def p05a(spark, d):
    return rounded(V.tpr_at_fpr(_distances(spark, d), drop_collinear=False))


BAND_SQL = "CASE WHEN {a} < 0.55 THEN 'excellent' WHEN {a} < 0.6 THEN 'safe' WHEN {a} < 0.7 THEN 'caution' ELSE 'warning' END"


@query("p06_privacy_verdict", f"""{_ATT}, {auc_sql('att', 'res')} SELECT run, {R('auc')} AS auc, {R('tpr1')} AS tpr_at_1_fpr, {R('tpr5')} AS tpr_at_5_fpr,
 {R('member_mean')} AS member_mean, {R('nonmember_mean')} AS nonmember_mean, n_member, n_nonmember, auc < 0.6 AS safe, {BAND_SQL.format(a='auc')} AS band FROM res""")
def p06(spark, d):
    return rounded(V.privacy_verdict(_distances(spark, d)))


SEEDS = tuple(r * 42 for r in range(5))


@query("p07_privacy_multi_run", f"WITH {PART_BASE}, " + ", ".join(f"{part_syn_sql(s, tag=f'_{s}')}, {attack_sql(f'_{s}', str(s))}" for s in SEEDS)
       + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM att_{s}" for s in SEEDS) + f"), {auc_sql('every', 'res')}, o AS (SELECT avg(auc) AS m FROM res) "
       + f"SELECT count(*) AS n_runs, {R('avg(auc)')} AS auc_mean, {R('stddev_pop(auc)')} AS auc_std, {R('min(auc)')} AS auc_min, {R('max(auc)')} AS auc_max, "
       + f"{BAND_SQL.format(a='avg(auc)')} AS band FROM res")
def p07(spark, d):
    return rounded(V.privacy_multi_run(part_runs(spark, d, [(str(s), s, 0.1) for s in SEEDS])))


@query("p09_distance_to_closest_record", f"""WITH {PART_BASE}, {part_syn_sql()}, a1 AS ({_scaled('i', 'psyn', 'ptr')}), b1 AS ({_scaled('p_partkey', 'ptr', 'ptr')}),
 dd AS (SELECT a.id, min({_SQ}) AS d FROM a1 a, b1 b GROUP BY a.id)
 SELECT count(*) AS n, count(*) FILTER (WHERE d = 0) AS n_copies, {R('avg(d)')} AS mean, """ + ", ".join(
    f"{R(f'quantile_cont(d, {p})')} AS q{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM dd")
def p09(spark, d):
    train, _, syn = part_features(spark, d)
    return rounded(V.distance_to_closest_record(syn, train))
