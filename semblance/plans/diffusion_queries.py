"""Registered queries: diffusion operators, the synthesizer and the interpolating oversamplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.functions.arrays import log_one_hot
from semblance.functions.rand import normal
from semblance.operators import diffusion as D
from semblance.operators import fidelity as H
from semblance.operators import oversample as O
from semblance.operators import prepare as P
from semblance.operators import synthesizer as Y
from semblance.operators.frames import cut_lineage
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, NUMERIC, TARGET, R, rounded
from semblance.plans.prepare_queries import CODED, line_layout
from semblance.plans.registry import query, table
from semblance.plans.sampling_queries import DOC_COLS, DOCS, labelled_documents

DIMS = (*NUMERIC, TARGET)
T = 100
K = 3
CODE = "l_returnflag_code"

def _schedule_sql(steps: int) -> str:
    """CTEs ending in sch, the cosine schedule."""
    return f"""ang AS (SELECT t, pow(cos((t / {steps}.0::double + 0.008) / 1.008 * pi() / 2), 2) AS f FROM range({steps + 1}) AS r(t)),
 be AS (SELECT a.t, greatest(least(1 - b.f / a.f, 0.9999), 0.0001)::double AS beta FROM ang a JOIN ang b ON b.t = a.t + 1),
 ab AS (SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS abar FROM be),
 ap AS (SELECT *, coalesce(lag(abar) OVER (ORDER BY t), 1.0::double) AS abar_prev FROM ab),
 sch AS (SELECT cast(t AS integer) AS t, beta, alpha, abar, abar_prev, beta * (1 - abar_prev) / (1 - abar) AS post_var,
  beta * sqrt(abar_prev) / (1 - abar) AS coef1, (1 - abar_prev) * sqrt(alpha) / (1 - abar) AS coef2 FROM ap)"""


SCH = _schedule_sql(T)
_MM = "((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / ((SELECT max(l_extendedprice) FROM lineitem) - (SELECT min(l_extendedprice) FROM lineitem)) * 2 - 1)"
_X = f"x AS (SELECT k, {_MM} AS x, {CODE} AS c, l_linestatus AS y FROM ({CODED}))"
_TSQL = f"cast({S.index('42/t', 'k', T)} AS integer)"


def _gumbel(logp: list[str], seed: str, k: str) -> str:
    cells = ", ".join(f"{lp} - ln(-ln({S.uniform(f'{seed}/{j // 4}', k, j % 4)} + 1e-30) + 1e-30)" for j, lp in enumerate(logp))
    return f"cast(list_position([{cells}], list_max([{cells}])) - 1 AS integer)"


def _mix(hit: str, share: str) -> str:
    return f"({share} * (CASE WHEN {hit} THEN 1 ELSE 0 END) + (1 - {share}) / {K}.0::double)"


_LOGQ = [f"ln({_mix(f'c = {j}', 'abar')})" for j in range(K)]
_NZ = f"""{SCH}, {_X}, xt0 AS (SELECT *, {_TSQL} AS t, {S.normal('42/eps/x', 'k')} AS eps FROM x),
 nz AS (SELECT *, sqrt(abar) * x + sqrt(1 - abar) * eps AS xt, {_gumbel(_LOGQ, f'42/cat/{CODE}', 'k')} AS ct FROM xt0 JOIN sch USING (t))"""


def _schedule():
    return D.noise_schedule(T, "cosine")


def scaled_price(spark, d):
    """Scaled target, category code and class of every line item."""
    df, _, _ = line_layout(spark, d)
    params = P.fit_minmax(df, [TARGET])
    return P.scale(df, params).select("k", F.col(TARGET).alias("x"), CODE, F.col("l_linestatus").alias("y"))


def stepped(spark, d):
    return D.draw_steps(scaled_price(spark, d), F.col("k"), T)


def noised(spark, d):
    out = D.noise_numeric(stepped(spark, d), ["x"], _schedule(), F.col("k"))
    return D.noise_categorical(out, CODE, K, _schedule(), F.col("k"))


_F01 = ("beta", "alpha", "abar", "abar_prev", "post_var", "coef1", "coef2")


@query("f01_noise_schedule", f"""WITH {SCH}, {_X}, v AS (SELECT var_pop(x) AS v FROM x) SELECT t, {', '.join(f'{R(c, 8)} AS {c}' for c in _F01)},
 {R('ln(greatest(post_var, 1e-20))')} AS post_logvar, {R('abar * v + 1 - abar')} AS var_xt FROM sch, v""")
def f01(spark, d):
    v = scaled_price(spark, d).agg(F.var_pop("x")).first()[0]
    s = _schedule().frame(spark).select("t", *_F01, "post_logvar")
    out = s.withColumn("var_xt", F.col("abar") * F.lit(v) + 1 - F.col("abar"))
    return rounded(out, 8, post_logvar=6, var_xt=6)


@query("f01_noise_schedule_linear", f"""WITH be AS (SELECT t, 10 * (1e-4 + (0.02 - 1e-4) * t / 99) AS beta FROM range(100) AS r(t)),
 ab AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS abar FROM be), {_X}, v AS (SELECT var_pop(x) AS v FROM x)
 SELECT cast(t AS integer) AS t, {R('beta', 8)} AS beta, {R('abar', 8)} AS abar, {R('abar * v + 1 - abar')} AS var_xt FROM ab, v""")
def f01l(spark, d):
    v = scaled_price(spark, d).agg(F.var_pop("x")).first()[0]
    s = D.noise_schedule(100, "linear", scaled=True).frame(spark).select("t", "beta", "abar")
    return rounded(s.withColumn("var_xt", F.col("abar") * F.lit(v) + 1 - F.col("abar")), 8, var_xt=6)


@query("f02_noise_numeric", f"WITH {_NZ} SELECT k, t, {R('x')} AS x, {R('eps')} AS eps_x, {R('xt')} AS xt_x FROM nz")
def f02(spark, d):
    return rounded(D.noise_numeric(stepped(spark, d), ["x"], _schedule(), F.col("k")).select("k", "t", "x", "eps_x", "xt_x"))


@query("f03_noise_categorical_probability", f"WITH {_NZ} SELECT k, t, " + ", ".join(f"{R(_mix(f'c = {j}', 'abar'))} AS p{j}" for j in range(K)) + " FROM nz")
def f03p(spark, d):
    out = D.noise_categorical(stepped(spark, d), CODE, K, _schedule(), F.col("k"), mode="probability")
    return rounded(out.select("k", "t", *[F.col(f"pt_{CODE}")[j].alias(f"p{j}") for j in range(K)]))


@query("f03_noise_categorical_sample", f"WITH {_NZ} SELECT k, t, c AS {CODE}, ct AS xt_{CODE} FROM nz")
def f03s(spark, d):
    return noised(spark, d).select("k", "t", CODE, f"xt_{CODE}")


@query("f03_noise_categorical_one_step", f"WITH {_NZ} SELECT k, t, " + ", ".join(f"{R(_mix(f'c = {j}', 'alpha'))} AS p{j}" for j in range(K)) + " FROM nz")
def f03o(spark, d):
    out = D.noise_categorical(stepped(spark, d), CODE, K, _schedule(), F.col("k"), mode="probability", one_step=True)
    return rounded(out.select("k", "t", *[F.col(f"pt_{CODE}")[j].alias(f"p{j}") for j in range(K)]))


_SHARE = [f"(SELECT count(*) FILTER (WHERE l_returnflag = '{v}') / count(*) FROM lineitem)" for v in ("A", "N", "R")]


def _marginal(spark, d):
    df, _, _ = line_layout(spark, d)
    counts = {r[CODE]: r["n"] for r in df.groupBy(CODE).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    return F.array(*[F.ln(F.lit(counts[j] / n)) for j in range(K)])


@query("f04_gumbel_sample", f"WITH {_X} SELECT k, {_gumbel([f'ln({s})' for s in _SHARE], '7', 'k')} AS drawn FROM x")
def f04(spark, d):
    return scaled_price(spark, d).select("k", D.gumbel_sample(_marginal(spark, d), K, F.col("k"), 7).alias("drawn"))


_CLEAN = "(xt / sqrt(abar) - sqrt(1 / abar - 1) * (0.9 * eps))"


@query("f05_posterior_numeric", f"""WITH {_NZ}, c0 AS (SELECT *, greatest(least({_CLEAN}, 1), -1) AS x0 FROM nz)
 SELECT k, t, {R('x0')} AS x0, {R('coef1 * x0 + coef2 * xt')} AS mean, {R('post_var')} AS var, {R('ln(greatest(post_var, 1e-20))')} AS logvar FROM c0""")
def f05(spark, d):
    df = D.with_schedule(D.noise_numeric(stepped(spark, d), ["x"], _schedule(), F.col("k")), _schedule())
    x0 = D.clean_from_noise(F.col("xt_x"), F.lit(0.9) * F.col("eps_x"), clip=1.0)
    mean, var, logvar = D.posterior_numeric(F.col("x0"), F.col("xt_x"))
    return rounded(df.withColumn("x0", x0).select("k", "t", "x0", mean.alias("mean"), var.alias("var"), logvar.alias("logvar")))


def _post(prior: list[str]) -> list[str]:
    raw = [f"(CASE WHEN t = 0 THEN {p} ELSE abar_prev * {p} + (1 - abar_prev) / {K}.0::double END) * {_mix(f'ct = {j}', 'alpha')}" for j, p in enumerate(prior)]
    return [f"(({r}) / ({' + '.join(raw)}))" for r in raw]


_HOT = [f"(CASE WHEN c = {j} THEN 1.0::double ELSE 1e-30 END)" for j in range(K)]


@query("f06_posterior_categorical", f"WITH {_NZ} SELECT k, t, " + ", ".join(f"{R(p)} AS p{j}" for j, p in enumerate(_post(_HOT))) + " FROM nz")
def f06(spark, d):
    df = D.with_schedule(noised(spark, d), _schedule(), ("alpha", "abar_prev"))
    post = D.posterior_categorical(log_one_hot(F.col(CODE), K), log_one_hot(F.col(f"xt_{CODE}"), K), K)
    df = df.withColumn("post", post)
    return rounded(df.select("k", "t", *[F.exp(F.col("post")[j]).alias(f"p{j}") for j in range(K)]))


_PAIR = "concat_ws('#', k, cast(repeat AS varchar))"
_PAIRS = f"""{SCH}, {_X}, pr0 AS (SELECT x.*, repeat, {_PAIR} AS pair FROM x, range(1, 3) AS r(repeat)),
 pr1 AS (SELECT *, cast({S.index('42/t', 'pair', T)} AS integer) AS t, {S.normal('42/eps/x', 'pair')} AS eps FROM pr0),
 nz AS (SELECT *, sqrt(abar) * x + sqrt(1 - abar) * eps AS xt, {_gumbel(_LOGQ, f'42/cat/{CODE}', 'pair')} AS ct FROM pr1 JOIN sch USING (t))"""


@query("f07_training_pairs", f"WITH {_PAIRS} SELECT pair, t, {R('eps')} AS eps_x, {R('xt')} AS xt_x, ct AS xt_{CODE}, " + ", ".join(
    f"{R(p)} AS p{j}" for j, p in enumerate(_post(_HOT))) + f", CASE WHEN {S.uniform('42/drop', 'pair')} >= 0.1 THEN y END AS y FROM nz")
def f07(spark, d):
    out = D.training_pairs(scaled_price(spark, d), ["x"], {CODE: K}, _schedule(), F.col("k"), repeats=2, label="y", label_dropout=0.1)
    return rounded(out.select("pair", "t", "eps_x", "xt_x", f"xt_{CODE}", *[F.exp(F.col(f"post_{CODE}")[j]).alias(f"p{j}") for j in range(K)], "y"))


# ---- losses of a simple denoiser: unit-variance noise guess, marginal category guess ----

_TRUE, _MODEL = _post(_HOT), _post(_SHARE)
_KL = " + ".join(f"{a} * ln({a} / {b})" for a, b in zip(_TRUE, _MODEL))
_NLL = "CASE c " + " ".join(f"WHEN {j} THEN -ln({b})" for j, b in enumerate(_MODEL)) + " END"
_NUM = "(sqrt(1 - abar) * xt - eps) * (sqrt(1 - abar) * xt - eps)"
_LOSS = f"{_NZ}, ls AS (SELECT t, {_NUM} AS num, CASE WHEN t = 0 THEN {_NLL} ELSE {_KL} END AS cat FROM nz)"
_LOSS_COLS = f"count(*) AS n, {R('avg(num)')} AS loss_num, {R('avg(cat)')} AS loss_cat, {R('avg(num) + avg(cat)')} AS loss"


def guessed(spark, d):
    df = D.with_schedule(noised(spark, d), _schedule(), ("sqrt_1m_abar",))
    return df.withColumn("guess_x", F.col("sqrt_1m_abar") * F.col("xt_x")).withColumn("logits", _marginal(spark, d)).drop("sqrt_1m_abar")


@query("f10_diffusion_losses_kl", f"WITH {_LOSS} SELECT {_LOSS_COLS} FROM ls")
def f10(spark, d):
    return rounded(D.diffusion_losses(guessed(spark, d), {"eps_x": "guess_x"}, {CODE: (K, "logits")}, _schedule()))


@query("f10_diffusion_losses_by_step", f"WITH {_LOSS} SELECT t, {_LOSS_COLS} FROM ls GROUP BY t")
def f10t(spark, d):
    return rounded(D.diffusion_losses(guessed(spark, d), {"eps_x": "guess_x"}, {CODE: (K, "logits")}, _schedule(), by_step=True))


_CE = "CASE c " + " ".join(f"WHEN {j} THEN -ln({s})" for j, s in enumerate(_SHARE)) + " END"


@query("f10_diffusion_losses_ce", f"WITH {_NZ}, ls AS (SELECT {_NUM} AS num, {_CE} AS cat FROM nz) SELECT {_LOSS_COLS} FROM ls")
def f10c(spark, d):
    return rounded(D.diffusion_losses(guessed(spark, d), {"eps_x": "guess_x"}, {CODE: (K, "logits")}, _schedule(), kind="ce"))


_HX = "(0.8 * {x} + 0.1 * " + S.normal("42/h/{c}", "k") + ")"


def _mmc(c: str) -> str:
    return f"(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) * 2 - 1)"


_HS = "h AS (SELECT k, " + ", ".join(f"{_mmc(c)} AS r_{c}, {_HX.format(x=_mmc(c), c=c)} AS g_{c}" for c in DIMS) + f" FROM ({S.LINE}))"
_ALL = " UNION ALL ".join(f"SELECT g_{c} AS v FROM h" for c in DIMS)


@query("f11_sample_health", f"WITH {_HS}, al AS ({_ALL}), fl AS (SELECT stddev_pop(v) < 0.1 OR avg((abs(v) > 0.99)::double) > 0.5 AS collapsed FROM al) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'avg(g_{c})')} AS gen_mean, {R(f'avg(r_{c})')} AS train_mean, {R(f'stddev_pop(g_{c})')} AS gen_std, {R(f'stddev_pop(r_{c})')} AS train_std, "
    f"{R(f'avg((abs(g_{c}) > 0.95)::double)')} AS beyond, (SELECT collapsed FROM fl) AS collapsed FROM h" for c in DIMS))
def f11(spark, d):
    df, _, _ = line_layout(spark, d)
    real = P.scale(df, P.fit_minmax(df, DIMS)).select("k", *DIMS)
    gen = real.withColumns({c: F.lit(0.8) * F.col(c) + F.lit(0.1) * normal(f"42/h/{c}", F.col("k")) for c in DIMS})
    return rounded(D.sample_health(gen, real, DIMS))


# ---- synthesizer -----------------------------------------------------------------------

_SC = "sc AS (SELECT l_returnflag AS component, " + ", ".join(f"{_mmc(c)} AS v{i}" for i, c in enumerate(DIMS)) + f", l_linestatus_code FROM ({CODED}))"


def scaled_lines(spark, d):
    df, layout, dic = line_layout(spark, d)
    xs, ys = P.fit_minmax(df, NUMERIC), P.fit_minmax(df, [TARGET])
    return P.scale(P.scale(df, xs), ys), xs, ys, layout, dic


@query("f08_component_statistics", f"WITH {_SC} SELECT component, count(*) AS n, " + ", ".join(f"{R(f'avg(v{i})')} AS mean_{i}" for i in range(4)) + ", " + ", ".join(
    f"{R(f'covar_pop(v{i}, v{j})')} AS cov_{i}_{j}" for i in range(4) for j in range(i, 4)) + " FROM sc GROUP BY component")
def f08(spark, d):
    df = scaled_lines(spark, d)[0].withColumn("component", F.col("l_returnflag"))
    return rounded(Y.component_statistics(df, DIMS, "component"))


@query("f08_component_shares", f"""WITH {_SC}, c AS (SELECT component, l_linestatus_code AS code, count(*) AS n FROM sc GROUP BY 1, 2)
 SELECT component, 'l_linestatus_code' AS "column", code, n, {R('(n + 1.0::double) / (sum(n) OVER (PARTITION BY component) + 2)')} AS share FROM c""")
def f08s(spark, d):
    df = scaled_lines(spark, d)[0].withColumn("component", F.col("l_returnflag"))
    return rounded(Y.component_shares(df, {"l_linestatus_code": 2}, "component"))


def generate(spark, d, n: int | None = None, label: str | None = None, guidance: float = 1.0, variant: str = "posterior", components: int = 4, steps: int = T):
    """Fit on all line items and generate as many rows, decoded to original units and values."""
    scaled, xs, ys, layout, dic = scaled_lines(spark, d)
    scaled = cut_lineage(scaled)
    codes = {f"{c}_code": layout.cardinality[c] for c in CATS}
    model = Y.fit_synthesizer(scaled, DIMS, codes, condition="l_returnflag", components=components)
    out = Y.sample_synthesizer(spark, model, D.noise_schedule(steps), scaled.count() if n is None else n, label, guidance, variant)
    return P.decode_synthetic(out, xs, ys, dic, CATS)


@query("f09_sample_synthesizer")
def f09(spark, d):
    return rounded(generate(spark, d), 4)


@query("f09_sample_conditional_guided")
def f09c(spark, d):
    return rounded(generate(spark, d, label="R", guidance=1.5), 4)


@query("f09_sample_simple_variant")
def f09s(spark, d):
    return rounded(generate(spark, d, variant="simple"), 4)


@query("f09_synthesizer_fidelity")
def f09f(spark, d):
    syn = cut_lineage(generate(spark, d))
    real = table(spark, d, "lineitem")
    ks = H.ks_two_sample(real, syn, DIMS).select("column", "ks")
    # one row per column on both sides
    return rounded(H.compare_moments(real, syn, DIMS).join(F.broadcast(ks), "column"), 4)


# the whole sampler in SQL: four steps, two components, two numeric dimensions and one category
FEW, WIDE, LEVELS = 4, ("l_quantity", TARGET), 3
LANES = len(WIDE) + LEVELS


def _model_sql() -> str:
    """CTE mo: one row with weight, mean, covariance and category shares of both components, sorted by label."""
    per = f"""sc AS (SELECT l_linestatus AS comp, {_mmc(WIDE[0])} AS v0, {_mmc(WIDE[1])} AS v1, {CODE} AS code FROM ({CODED})),
 cs AS (SELECT row_number() OVER (ORDER BY comp) - 1 AS k, count(*) AS n, avg(v0) AS m0, avg(v1) AS m1, covar_pop(v0, v0) + {Y.RIDGE} AS a, covar_pop(v0, v1) AS b, covar_pop(v1, v1) + {Y.RIDGE} AS e,
  {', '.join(f'(count_if(code = {j}) + 1.0::double) / (count(*) + {LEVELS}) AS p{j}' for j in range(LEVELS))} FROM sc GROUP BY comp)"""
    cols = ("n", "m0", "m1", "a", "b", "e", *[f"p{j}" for j in range(LEVELS)])
    return per + ", mo AS (SELECT " + ", ".join(f"max({c}) FILTER (WHERE k = {k}) AS {c}_{k}" for k in (0, 1) for c in cols) + " FROM cs)"


def _step_sql(t: int) -> str:
    """CTE s<t> from s<t+1>: one reverse step."""
    at = t * LANES
    comp = ", ".join(f"""ln(n_{k}) - 0.5 * ((d0{k} * d0{k} * s11{k} - 2 * d0{k} * d1{k} * s01{k} + d1{k} * d1{k} * s00{k}) / det{k} + ln(det{k})) AS base{k},
   ln(abar * [p0_{k}, p1_{k}, p2_{k}][c + 1] + (1 - abar) / {LEVELS}) AS seen{k}, (s11{k} * d0{k} - s01{k} * d1{k}) / det{k} AS y0{k}, (s00{k} * d1{k} - s01{k} * d0{k}) / det{k} AS y1{k}""" for k in (0, 1))
    sizes = ", ".join(f"x0 - sqrt(abar) * m0_{k} AS d0{k}, x1 - sqrt(abar) * m1_{k} AS d1{k}, abar * a_{k} + 1 - abar AS s00{k}, abar * b_{k} AS s01{k}, abar * e_{k} + 1 - abar AS s11{k}" for k in (0, 1))
    dets = ", ".join(f"s00{k} * s11{k} - s01{k} * s01{k} AS det{k}" for k in (0, 1))
    clean = [f"r0 * (m{i}_0 + sqrt(abar) * ({u}_0 * y00 + {w}_0 * y10)) + (1 - r0) * (m{i}_1 + sqrt(abar) * ({u}_1 * y01 + {w}_1 * y11))" for i, (u, w) in enumerate((("a", "b"), ("b", "e")))]
    prior = [f"(q0 * p{j}_0 + (1 - q0) * p{j}_1)" for j in range(LEVELS)]
    if t:
        prior = [f"(abar_prev * {p} + (1 - abar_prev) / {LEVELS})" for p in prior]
    scores = ", ".join(f"ln({p}) + ln((1 - alpha) / {LEVELS} + alpha * (c = {j})::int) - ln(-ln({S.counter_uniform('ca', at + len(WIDE) + j)}))" for j, p in enumerate(prior))
    spread = "exp(0.5 * greatest(least(ln(greatest(post_var, 1e-20)), 2), -20))"
    moved = ", ".join(f"coef1 * ((x{i} - sqrt(1 - abar) * (x{i} - sqrt(abar) * f{i}) / sqrt(1 - abar)) / sqrt(abar)) + coef2 * x{i}" + (f" + {spread} * {S.counter_normal('ca', 'cb', at + i)}" if t else "") + f" AS x{i}" for i in (0, 1))
    return f"""s{t} AS (SELECT row, ca, cb, {moved}, list_position(sc, list_max(sc)) - 1 AS c FROM (SELECT *, {clean[0]} AS f0, {clean[1]} AS f1, [{scores}] AS sc FROM (
  SELECT *, 1 / (1 + exp(base1 + seen1 - base0 - seen0)) AS r0, 1 / (1 + exp(base1 - base0)) AS q0 FROM (SELECT *, {comp} FROM (SELECT *, {dets} FROM (
   SELECT *, {sizes} FROM s{t + 1}, mo, (SELECT * FROM sch WHERE t = {t})))))))"""


_FIRST = ", ".join(f"{S.counter_normal('ca', 'cb', FEW * LANES + i)} AS x{i}" for i in range(len(WIDE)))
_FIRST_SCORES = ", ".join(f"-ln(-ln({S.counter_uniform('ca', FEW * LANES + len(WIDE) + j)}))" for j in range(LEVELS))
_STEPS = f"""WITH {_schedule_sql(FEW)}, {_model_sql()}, st AS (SELECT row, {S.counter_base(42, 'row')} AS ca, {S.counter_base(42, 'row', 1)} AS cb FROM range((SELECT count(*) FROM lineitem)) AS r(row)),
 s{FEW} AS (SELECT * EXCLUDE (sc), list_position(sc, list_max(sc)) - 1 AS c FROM (SELECT *, {_FIRST}, [{_FIRST_SCORES}] AS sc FROM st)), {', '.join(_step_sql(t) for t in reversed(range(FEW)))}"""


@query("f09_sample_steps", f"{_STEPS} SELECT row, {R('x0')} AS l_quantity, {R('x1')} AS {TARGET}, c::integer AS {CODE} FROM s0")
def f09t(spark, d):
    """As many rows as line items by four reverse steps, in scaled units."""
    scaled = scaled_lines(spark, d)[0]
    model = Y.fit_synthesizer(scaled, WIDE, {CODE: LEVELS}, condition="l_linestatus")
    return rounded(Y.sample_synthesizer(spark, model, D.noise_schedule(FEW), table(spark, d, "lineitem").count()))


# ---- oversamplers ----------------------------------------------------------------------

_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DOC_COLS) + ")"
_DK = "cast(doc_id AS varchar)"
_SMOTE = f"""d AS ({DOCS}), n AS (SELECT quality, count(*) AS n FROM d GROUP BY 1),
 mi AS (SELECT d.*, row_number() OVER (ORDER BY {S.digest(42, _DK)}, {_DK}) - 1 AS idx FROM d WHERE quality = 0),
 nb AS (SELECT a.idx, b.doc_id AS pid, row_number() OVER (PARTITION BY a.doc_id ORDER BY {_DIST}, cast(b.doc_id AS varchar)) AS rk FROM mi a, mi b WHERE a.doc_id <> b.doc_id),
 dr AS (SELECT i, {S.index('42/base', 'i', '(SELECT n FROM n WHERE quality = 0)')} AS idx,
   {S.index('42/pick', 'i', 5)} + 1 AS rk, {S.uniform('42/gap', 'i')} AS u FROM range((SELECT max(n) - min(n) FROM n)) AS r(i))"""


@query("e10_smote", f"WITH {_SMOTE} SELECT i, 0 AS quality, {R('u')} AS u, " + ", ".join(f"{R(f'a.{c} + u * (b.{c} - a.{c})', 4)} AS {c}" for c in DOC_COLS)
       + " FROM dr JOIN mi a USING (idx) JOIN nb USING (idx, rk) JOIN d b ON b.doc_id = nb.pid")
def e10(spark, d):
    out = O.smote(labelled_documents(spark, d), F.col("doc_id"), DOC_COLS, "quality")
    return rounded(out, 4, u=6)


@query("e10_smote_class_counts", "SELECT quality, max(count(*)) OVER () AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def e10c(spark, d):
    docs = labelled_documents(spark, d)
    new = O.smote(docs, F.col("doc_id"), DOC_COLS, "quality")
    return docs.select("quality").unionByName(new.select("quality")).groupBy("quality").agg(F.count("*").alias("n"))


@query("e10_smote_categories", f"WITH {_SMOTE}, vt AS (SELECT nb.idx, b.lang, count(*) AS n FROM nb JOIN d b ON b.doc_id = nb.pid WHERE rk <= 5 GROUP BY 1, 2), "
       + "best AS (SELECT idx, lang FROM vt QUALIFY row_number() OVER (PARTITION BY idx ORDER BY n DESC, lang) = 1) "
       + f"SELECT i, 0 AS quality, {R('u')} AS u, " + ", ".join(f"{R(f'a.{c} + u * (b.{c} - a.{c})', 4)} AS {c}" for c in DOC_COLS)
       + ", best.lang AS lang FROM dr JOIN mi a USING (idx) JOIN nb USING (idx, rk) JOIN d b ON b.doc_id = nb.pid JOIN best USING (idx)")
def e10v(spark, d):
    return rounded(O.smote(labelled_documents(spark, d), F.col("doc_id"), DOC_COLS, "quality", cats=["lang"]), 4, u=6)


_BOX = """q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events),
 w AS (SELECT med, (SELECT min(value) FROM events WHERE value >= q1 - 1.5 * (q3 - q1)) AS low, (SELECT max(value) FROM events WHERE value <= q3 + 1.5 * (q3 - q1)) AS high FROM q),
 mm AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
 h AS (SELECT event_id, value, med, mn < low AS has_low, mx > high AS has_high,
  greatest(least((value - med) / (CASE WHEN value < med THEN low ELSE high END - med), 1), 0) AS h FROM events, w, mm),
 ph AS (SELECT event_id, value, med, CASE WHEN (value < med AND has_low) OR (value >= med AND has_high) THEN h * h * (3 - 2 * h) ELSE 0 END AS phi FROM h),
 rg AS (SELECT *, CASE WHEN phi >= 0.5 AND value < med THEN 'low' WHEN phi >= 0.5 THEN 'high' ELSE 'common' END AS region FROM ph)"""


@query("e11_smogn_relevance", f"WITH {_BOX} SELECT event_id, {R('phi')} AS phi, region FROM rg")
def e11r(spark, d):
    e = table(spark, d, "events")
    box = O.box_points(e, "value")
    return rounded(e.select("event_id", O.relevance(F.col("value"), box).cast("double").alias("phi"), O.region_of(F.col("value"), box).alias("region")))


@query("e11_smogn_regions", f"""WITH {_BOX}, sz AS (SELECT region, count(*) AS n FROM rg GROUP BY 1), b AS (SELECT sum(n) / count(*) AS b, count(*) AS bumps, sum(n) AS total FROM sz),
 sc AS (SELECT bumps * b / (SELECT sum(b * b / n) FROM sz, b) AS s, b FROM b), f AS (SELECT region, n, round(b * b / n * s / n, 1) AS factor FROM sz, sc)
 SELECT region, n, factor, CASE WHEN factor >= 1 THEN n ELSE cast(ceil(round(factor * n, 9)) AS bigint) END AS kept,
 CASE WHEN factor >= 1 THEN cast(round((factor - 1) * n) AS bigint) ELSE 0 END AS added FROM f""")
def e11p(spark, d):
    return O.smogn_regions(table(spark, d, "events"), "value")


_SMOGN = f"""{_BOX}, ev AS (SELECT event_id, cast(event_id AS varchar) AS id, epoch_us(ts) / 60000000.0::double AS minute, cast(user_id AS double) AS user, event_type, value FROM events),
 st AS (SELECT avg(minute) AS mm, stddev_pop(minute) AS sm, avg("user") AS mu, stddev_pop("user") AS su FROM ev),
 e AS (SELECT ev.*, region, (minute - mm) / sm AS z0, ("user" - mu) / su AS z1 FROM ev JOIN rg USING (event_id), st),
 sz AS (SELECT region, count(*) AS n FROM e GROUP BY 1), b AS (SELECT sum(n) / count(*) AS b, count(*) AS bumps FROM sz), sc AS (SELECT bumps * b / (SELECT sum(b * b / n) FROM sz, b) AS s, b FROM b),
 f AS (SELECT region, n, round(b * b / n * s / n, 1) AS factor, CASE WHEN factor > 1 AND n > 1 THEN cast(round((factor - 1) * n) AS bigint) ELSE 0 END AS added FROM sz, sc),
 kept AS (SELECT e.* FROM e JOIN f USING (region) QUALIFY factor >= 1 OR row_number() OVER (PARTITION BY region ORDER BY {S.digest('42/keep', 'id')}, id) <= ceil(round(factor * n, 9))),
 grow AS (SELECT region, n, added, coalesce(sum(added) OVER (ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f WHERE added > 0),
 ke AS (SELECT least({O.NEIGHBORS}, min(n) - 1) AS k FROM grow),
 nu AS (SELECT e.*, row_number() OVER (PARTITION BY region ORDER BY {S.digest('42/smogn', 'id')}, id) - 1 AS idx FROM e WHERE region IN (SELECT region FROM grow)),
 pr AS (SELECT a.region, a.idx, a.id, b.id AS pid, sqrt((b.z0 - a.z0) * (b.z0 - a.z0) + (b.z1 - a.z1) * (b.z1 - a.z1)) AS dist FROM nu a JOIN nu b ON a.region = b.region),
 md AS (SELECT region, idx, median(dist) / 2 AS safe FROM pr GROUP BY 1, 2),
 nb AS (SELECT region, idx, pid, dist, row_number() OVER (PARTITION BY region, idx ORDER BY dist, pid) AS rk FROM pr WHERE id <> pid QUALIFY rk <= (SELECT k FROM ke)),
 dr AS (SELECT region, i, {S.index('42/base', 'i', 'n')} AS idx, {S.index('42/pick', 'i', '(SELECT k FROM ke)')} + 1 AS rk, {S.uniform('42/gap', 'i')} AS u
  FROM (SELECT region, n, unnest(range(start::bigint, (start + added)::bigint)) AS i FROM grow)),
 sd AS (SELECT region, stddev_pop(minute) AS s_minute, stddev_pop("user") AS s_user, stddev_pop(value) AS s_value FROM nu GROUP BY 1),
 nw AS (SELECT dr.region, i, u, a.minute AS a_minute, b.minute AS b_minute, a."user" AS a_user, b."user" AS b_user, a.value AS a_value, b.value AS b_value, a.event_type AS a_type, b.event_type AS b_type, dist < safe AS near, sd.*
  FROM dr JOIN nu a ON a.region = dr.region AND a.idx = dr.idx JOIN nb ON nb.region = dr.region AND nb.idx = dr.idx AND nb.rk = dr.rk JOIN nu b ON b.region = dr.region AND b.id = nb.pid
  JOIN md ON md.region = dr.region AND md.idx = dr.idx JOIN sd ON sd.region = dr.region)"""


def _grown(c: str) -> str:
    return R(f"CASE WHEN near THEN a_{c} + u * (b_{c} - a_{c}) ELSE a_{c} + {O.PERTURBATION} * s_{c} * {S.normal(f'42/jitter/{c}', 'i')} END", 3)


@query("e11_smogn", f"""WITH {_SMOGN} SELECT region, {R('minute', 3)} AS minute, {R('"user"', 3)} AS "user", {R('value', 3)} AS value, event_type, 'kept' AS origin FROM kept
 UNION ALL SELECT region, {_grown('minute')}, {_grown('user')}, {_grown('value')}, CASE WHEN near AND u >= 0.5 THEN b_type ELSE a_type END, CASE WHEN near THEN 'interpolated' ELSE 'jittered' END FROM nw""")
def e11(spark, d):
    minute = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000.0)).alias("minute")
    e = table(spark, d, "events").select("event_id", minute, F.col("user_id").cast("double").alias("user"), "event_type", "value")
    return rounded(O.smogn(e, F.col("event_id"), ["minute", "user"], "value", cats=["event_type"]), 3)
