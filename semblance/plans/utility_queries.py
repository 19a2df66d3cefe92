"""Registered queries: models, metrics and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.operators import models as M
from semblance.operators import sampling as A
from semblance.operators import privacy as V
from semblance.operators import utility as U
from semblance.operators.frames import cut_lineage
from semblance.operators.layout import Layout
from semblance.operators.prepare import fit_standard, scale, split_random
from semblance.operators.privacy import privacy_utility_table
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, NUMERIC, TARGET, R, lines, rounded
from semblance.plans.prepare_queries import line_layout
from semblance.plans.registry import query, table
from semblance.plans.report_queries import BAND_SQL, N_TYPES, PART_BASE, PART_CAT, attack_sql, auc_sql, part_copy, part_parts, part_runs, part_syn_sql
from semblance.plans.sampling_queries import DOC_COLS, DOCS, _doc_split

DIMS = (*NUMERIC, TARGET)
_LSPLIT = f"ls AS ({S.split('(' + S.LINE + ')', 'k')}), tr AS (SELECT * FROM ls WHERE NOT is_test), te AS (SELECT * FROM ls WHERE is_test)"


def _syn_sql(seed: int = 42, scale_by: float = 0.1, tag: str = "") -> str:
    """Noise copy of the training part as CTE syn<tag>."""
    cols = ", ".join(f"{c} + {scale_by}::double * (SELECT stddev_pop({c}) FROM tr) * {S.normal(f'{seed}/{c}', 'i')} AS {c}" for c in DIMS)
    return f"""nn{tag} AS ({S.numbered('tr', seed, 'k')}), syn{tag} AS (SELECT i, {cols}, {', '.join(CATS)} FROM
 (SELECT i, {S.draw(seed, 'i', '(SELECT count(*) FROM tr)')} AS idx FROM range((SELECT count(*) FROM tr)) AS r(i)) JOIN nn{tag} USING (idx))"""


def _parts(spark, d):
    s = split_random(lines(spark, d).select("k", *DIMS, *CATS), F.col("k"))
    return s.where("NOT is_test").drop("is_test"), s.where("is_test").drop("is_test")


def _noise(train, seed: int = 42, scale_by: float = 0.1):
    return A.noise_relative(train, F.col("k"), NUMERIC, TARGET, scale_by=scale_by, seed=seed)


# One-hot levels of the regression table.
LEVELS = {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O")}
HOT = tuple(f"{c}_{v}" for c, values in LEVELS.items() for v in values)
FEATURES = (*NUMERIC, *HOT)
HEAVY = 10_000.0
MODELS = {"Ridge": U.LinearSpec(FEATURES), "Ridge numeric": U.LinearSpec(NUMERIC), "Ridge heavy": U.LinearSpec(FEATURES, HEAVY)}
SCENARIOS = {"Original": ("tr",), "+ Noise": ("tr", "syn"), "Noise only": ("syn",), "Strong noise only": ("syn_s",)}


def hot(df):
    """Category levels as 0/1 columns beside the numeric ones."""
    return df.select("*", *[(F.col(c) == v).cast("double").alias(f"{c}_{v}") for c, values in LEVELS.items() for v in values])


def _pieces(spark, d):
    train, test = _parts(spark, d)
    train = cut_lineage(train)
    return {"tr": hot(train), "syn": hot(_noise(train)), "syn_s": hot(_noise(train, 43, 1.0))}, hot(test)


_HOT_SQL = ", ".join(f"({c} = '{v}')::double AS {c}_{v}" for c, values in LEVELS.items() for v in values)


def hot_sql(src: str) -> str:
    return f"SELECT {', '.join(DIMS)}, {_HOT_SQL} FROM {src}"


def system_sql(model: str, scenario: str, src: str, cols, target: str, alpha: float) -> str:
    """One row: model, scenario, feature means mx, target mean my and the rows of the penalised normal equations."""
    gram = ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" + (f" + {alpha}" if a == b else "") for b in cols) + f", covar_pop({a}, {target}) * count(*)]" for a in cols)
    return f"SELECT '{model}' AS model, '{scenario}' AS scenario, [{', '.join(f'avg({c})' for c in cols)}] AS mx, avg({target}) AS my, [{gram}] AS m FROM {src}"


def solved_sql(systems: str, out: str = "fits") -> str:
    """CTEs ending in <out>(model, scenario, b, intercept): Gauss-Jordan elimination, one step per column."""
    return f"""el_{out} AS (SELECT model, scenario, mx, my, m, 1 AS k FROM ({systems})
  UNION ALL SELECT model, scenario, mx, my, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END), k + 1 FROM el_{out} WHERE k <= len(m)),
 co_{out} AS (SELECT model, scenario, mx, my, list_transform(m, lambda r: r[len(r)]) AS b FROM el_{out} WHERE k = len(m) + 1),
 {out} AS (SELECT model, scenario, b, my - list_dot_product(b, mx) AS intercept FROM co_{out})"""


def _union(scenario: str) -> str:
    return "(" + " UNION ALL ".join(hot_sql(p) for p in SCENARIOS[scenario]) + ")"


SCORES = f"""{_LSPLIT}, {_syn_sql()}, {_syn_sql(43, 1.0, '_s')}, {solved_sql(' UNION ALL '.join(system_sql(m, s, _union(s), spec.cols, TARGET, spec.alpha) for m, spec in MODELS.items() for s in SCENARIOS))},
 lt AS (SELECT {TARGET} AS y, [{', '.join(FEATURES)}]::double[] AS x FROM ({hot_sql('te')})),
 pr AS (SELECT model, scenario, y, intercept + list_dot_product(b, x[1:len(b)]) AS p FROM lt, fits),
 scores AS (SELECT model, scenario, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pr GROUP BY 1, 2)"""


def scores(spark, d):
    parts, test = _pieces(spark, d)
    return U.tstr_linear(parts, SCENARIOS, test, MODELS, TARGET)


@query("g03_ridge_closed_form_1", f"""SELECT {R('covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1.0)', 4)} AS coef,
 {R('avg(l_extendedprice) - covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1.0) * avg(l_quantity)', 4)} AS intercept FROM lineitem""")
def g03a(spark, d):
    m = M.ridge_closed_form(table(spark, d, "lineitem"), ["l_quantity"], TARGET)
    return rounded(spark.createDataFrame([(m.coef[0], m.intercept)], "coef double, intercept double"), 4)


@query("g03_ridge_closed_form_2", f"""WITH c AS (SELECT count(*) AS n, var_pop(l_quantity) * n + 100 AS a, var_pop(l_tax) * n + 100 AS e, covar_pop(l_quantity, l_tax) * n AS o,
  covar_pop(l_quantity, l_extendedprice) * n AS p, covar_pop(l_tax, l_extendedprice) * n AS q FROM lineitem)
 SELECT {R('(p * e - o * q) / (a * e - o * o)', 4)} AS coef_quantity, {R('(a * q - o * p) / (a * e - o * o)', 4)} AS coef_tax FROM c""")
def g03b(spark, d):
    m = M.ridge_closed_form(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], TARGET, 100.0)
    return rounded(spark.createDataFrame([m.coef], "coef_quantity double, coef_tax double"), 4)


@query("g05_regression_metrics", f"""WITH RECURSIVE {SCORES} SELECT model, scenario, n, {R('rmse', 4)} AS rmse, {R('mae', 4)} AS mae, {R('r2')} AS r2 FROM scores""")
def g05(spark, d):
    return rounded(scores(spark, d), 4, r2=6)


# a fixed rule as classifier: documents beyond a length and a line count are predicted good
_RULE = "CASE WHEN n_chars > 800 AND n_breaks < 12 THEN 1 ELSE 0 END"


def ruled_documents(spark, d):
    from semblance.plans.sampling_queries import labelled_documents

    rule = ((F.col("n_chars") > 800) & (F.col("n_breaks") < 12)).cast("int")
    return labelled_documents(spark, d).withColumn("prediction", rule)


_CONF = f"WITH d AS (SELECT quality AS y, {_RULE} AS p FROM ({DOCS}))"
_CLASS = f"""{_CONF}, cls AS (SELECT unnest([0, 1]) AS c),
 pc AS (SELECT c, (SELECT count(*) FROM d WHERE y = c) AS support, (SELECT count(*) FROM d WHERE p = c) AS predicted, (SELECT count(*) FROM d WHERE y = c AND p = c) AS hits FROM cls),
 pr AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM pc),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("g06_classification_metrics", f"""{_CLASS} SELECT {R('sum(hits) / sum(support)')} AS accuracy, {R('max(f1) FILTER (WHERE c = 1)')} AS f1,
 {R('sum(f1 * support) / sum(support)')} AS weighted_f1, cast(sum(support) AS bigint) AS n FROM f""")
def g06(spark, d):
    return rounded(U.classification_metrics(ruled_documents(spark, d), "quality"))


@query("g07_confusion_matrix", f"{_CONF} SELECT y, count(*) FILTER (WHERE p = 0) AS p_0, count(*) FILTER (WHERE p = 1) AS p_1 FROM d GROUP BY y")
def g07(spark, d):
    return U.confusion_matrix(ruled_documents(spark, d), "quality")


@query("g08_classification_report", f"""{_CLASS} SELECT cast(c AS varchar) AS "row", {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1, support FROM f
 UNION ALL SELECT 'accuracy', {R('sum(hits) / sum(support)')}, {R('sum(hits) / sum(support)')}, {R('sum(hits) / sum(support)')}, cast(sum(support) AS bigint) FROM f
 UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, cast(sum(support) AS bigint) FROM f
 UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')}, {R('sum(f1 * support) / sum(support)')}, cast(sum(support) AS bigint) FROM f""")
def g08(spark, d):
    return rounded(U.classification_report(ruled_documents(spark, d), "quality"))


_TIDY = f"""{SCORES}, td AS (SELECT model, scenario, 'rmse' AS metric, rmse AS value FROM scores UNION ALL SELECT model, scenario, 'r2', r2 FROM scores),
 b AS (SELECT model, metric, value AS baseline FROM td WHERE scenario = 'Original')"""


@query("g10_delta_table", f"""WITH RECURSIVE {_TIDY} SELECT model, scenario, metric, {R('value', 4)} AS value, {R('baseline', 4)} AS baseline, {R('value - baseline', 4)} AS delta,
 {R('(value - baseline) * 100 / abs(baseline)', 3)} AS percent, {R('greatest(value * 100 / baseline, 0)', 3)} AS percent_of_baseline,
 CASE WHEN metric = 'rmse' THEN value < baseline ELSE value > baseline END AS better FROM td JOIN b USING (model, metric)
 WHERE scenario <> 'Original'""")
def g10(spark, d):
    t = U.tidy(scores(spark, d), ["rmse", "r2"])
    return rounded(U.delta_table(t), 4, percent=3, percent_of_baseline=3)


_METHODS = """ms AS (SELECT 'Original' AS method, 'augment' AS use, model, r2 FROM scores WHERE scenario = 'Original'
 UNION ALL SELECT 'Noise', 'augment', model, r2 FROM scores WHERE scenario = '+ Noise' UNION ALL SELECT 'Noise', 'replace', model, r2 FROM scores WHERE scenario = 'Noise only'
 UNION ALL SELECT 'Strong noise', 'replace', model, r2 FROM scores WHERE scenario = 'Strong noise only'),
 mm AS (SELECT method, use, avg(r2) AS mean_r2, count(r2) AS n_models FROM ms GROUP BY 1, 2)"""


def _methods(s):
    kind = F.col("scenario")
    method = F.when(kind == "Original", "Original").when(kind == "Strong noise only", "Strong noise").otherwise("Noise")
    use = F.when(kind.isin("Noise only", "Strong noise only"), "replace").otherwise("augment")
    return s.select(method.alias("method"), use.alias("use"), "model", "r2")


@query("g11_method_summary", f"""WITH RECURSIVE {SCORES}, {_METHODS} SELECT method, use, {R('mean_r2')} AS mean_r2, n_models,
 mean_r2 = max(mean_r2) OVER (PARTITION BY use) AS best, mean_r2 = min(mean_r2) OVER (PARTITION BY use) AS worst,
 mean_r2 >= 0.95 * (SELECT mean_r2 FROM mm WHERE method = 'Original') AS near_original FROM mm WHERE method <> 'Original'""")
def g11(spark, d):
    return rounded(U.method_summary(_methods(scores(spark, d))))


@query("g12_win_count", f"""WITH RECURSIVE {SCORES}, w AS (SELECT model, max(rmse) FILTER (WHERE scenario = 'Noise only') AS a, max(rmse) FILTER (WHERE scenario = 'Strong noise only') AS b FROM scores GROUP BY 1),
 c AS (SELECT count(*) FILTER (WHERE a < b) AS wins, count(*) FILTER (WHERE a >= b) AS losses FROM w)
 SELECT wins, losses, CASE WHEN wins > losses THEN 'Noise only' WHEN wins = losses THEN 'mixed' ELSE 'Strong noise only' END AS verdict FROM c""")
def g12(spark, d):
    return U.win_count(scores(spark, d), "Noise only", "Strong noise only")


@query("g12_best_baseline", f"""WITH RECURSIVE {SCORES}, b AS (SELECT model, arg_min(scenario, rmse) AS best_baseline, min(rmse) AS baseline_rmse FROM scores
  WHERE scenario IN ('+ Noise', 'Strong noise only') GROUP BY model), c AS (SELECT model, rmse AS candidate_rmse FROM scores WHERE scenario = 'Noise only')
 SELECT model, best_baseline, {R('baseline_rmse', 4)} AS baseline_rmse, {R('candidate_rmse', 4)} AS candidate_rmse,
 CASE WHEN candidate_rmse < baseline_rmse THEN 'BETTER' ELSE 'WORSE' END AS status FROM b JOIN c USING (model)""")
def g12b(spark, d):
    return rounded(U.best_baseline(scores(spark, d), "Noise only", ["+ Noise", "Strong noise only"]), 4)


def _tested_sql(fit: str, src: str) -> str:
    """R2 of the one model of a CTE on a source."""
    p = f"((SELECT intercept FROM {fit}) + list_dot_product((SELECT b FROM {fit}), [{', '.join(FEATURES)}]::double[]))"
    return f"(SELECT 1 - sum(({TARGET} - {p}) * ({TARGET} - {p})) / (var_pop({TARGET}) * count(*)) FROM ({hot_sql(src)}))"


def _one_sql(src: str) -> str:
    return solved_sql(system_sql("Ridge", src, f"({hot_sql(src)})", FEATURES, TARGET, 1.0), f"f_{src}")


@query("g13_bidirectional", f"WITH RECURSIVE {_LSPLIT}, {_syn_sql()}, {_one_sql('tr')}, {_one_sql('syn')} " + " UNION ALL ".join(
    f"SELECT '{a}' AS trained_on, '{b}' AS tested_on, {R(_tested_sql(f'f_{s}', t))} AS r2"
    for a, s in (("real", "tr"), ("synthetic", "syn")) for b, t in (("real", "te"), ("synthetic", "syn"))))
def g13(spark, d):
    train, test = _parts(spark, d)
    train = cut_lineage(train)
    parts = {"real": hot(train), "test": hot(test), "synthetic": hot(_noise(train))}
    return rounded(U.bidirectional_linear(parts, {"real": "test", "synthetic": "synthetic"}, MODELS["Ridge"], TARGET))


_RUNS = f"WITH RECURSIVE {_LSPLIT}, " + ", ".join(f"{_syn_sql(s, tag=f'_{s}')}, {_one_sql(f'syn_{s}')}" for s in U.seeds(5)) + ", runs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS run, {_tested_sql(f'f_syn_{s}', 'te')} AS r2" for i, s in enumerate(U.seeds(5))) + ")"


@query("g14_multi_seed", f"{_RUNS} SELECT count(*) AS n_runs, {R('avg(r2)')} AS mean, {R('stddev_pop(r2)')} AS std, {R('min(r2)')} AS min, {R('max(r2)')} AS max FROM runs")
def g14(spark, d):
    train, test = _parts(spark, d)
    train = cut_lineage(train)
    return rounded(U.seed_summary(U.multi_seed_linear(lambda s: hot(_noise(train, s)), hot(test), MODELS["Ridge"], TARGET)))


_BAND = "CASE WHEN max(r2) > 0.9 THEN 'HIGH' WHEN max(r2) > 0.7 THEN 'MODERATE' WHEN max(r2) > 0.5 THEN 'MODERATE-LOW' ELSE 'LOW' END"
_BAND_SHORT = "CASE WHEN max(r2) > 0.9 THEN 'HIGH' WHEN max(r2) > 0.7 THEN 'MODERATE' ELSE 'LOW' END"


@query("g15_baseline_band", f"WITH RECURSIVE {SCORES} SELECT {R('max(r2)')} AS best_r2, arg_max(model, r2) AS best_model, {_BAND} AS band FROM scores WHERE scenario = 'Original'")
def g15(spark, d):
    return rounded(U.baseline_band(scores(spark, d).where("scenario = 'Original'")))


@query("g15_baseline_band_short", f"WITH RECURSIVE {SCORES} SELECT {R('max(r2)')} AS best_r2, arg_max(model, r2) AS best_model, {_BAND_SHORT} AS band FROM scores WHERE scenario = 'Original'")
def g15b(spark, d):
    return rounded(U.baseline_band(scores(spark, d).where("scenario = 'Original'"), with_moderate_low=False))


# ---- forests and boosting (compared by score, not by SQL) ------------------------------


def _features(df, layout: Layout):
    """Scaled numeric columns and one-hot columns as plain doubles."""
    cols = [*NUMERIC]
    out = df
    for c, values in (("l_returnflag", ("A", "N", "R")), ("l_linestatus", ("F", "O"))):
        for v in values:
            out = out.withColumn(f"{c}_{v}", (F.col(c) == v).cast("double"))
            cols.append(f"{c}_{v}")
    return out, cols


@query("g02_fit_regressors")
def g02(spark, d):
    train, test = _parts(spark, d)
    layout = Layout(NUMERIC, TARGET, CATS)
    train, cols = _features(train, layout)
    test, _ = _features(test, layout)
    return rounded(U.tstr({"Original": train}, test, M.fit_regressors(cols, TARGET), TARGET), 4)


@query("g04_fit_classifiers")
def g04(spark, d):
    train, test = _doc_split(spark, d)
    params = fit_standard(train, DOC_COLS)
    return rounded(U.tstr({"Original": scale(train, params)}, scale(test, params), M.fit_classifiers(DOC_COLS, "quality"), "quality", "classification"))


@query("g09_tstr")
def g09(spark, d):
    train, test = _parts(spark, d)
    layout = Layout(NUMERIC, TARGET, CATS)
    # the copy is read by two scenarios
    syn = cut_lineage(_noise(train).drop("i"))
    train, cols = _features(train, layout)
    syn, _ = _features(syn, layout)
    test, _ = _features(test, layout)
    scen = {"Original": train, "+ Noise": train.unionByName(syn), "Noise only": syn}
    models = M.fit_regressors(cols, TARGET)
    return rounded(U.tstr(scen, test, {n: models[n] for n in ("Random Forest", "Ridge")}, TARGET), 4)


# ---- privacy against utility -----------------------------------------------------------

_PU = (("noise 0.1", 42, 0.1), ("noise 1.0", 43, 1.0))


_PART_FEATURES = ("p_size", *[f"x{j}" for j in range(N_TYPES)])


def _part_hot(df):
    return df.select("p_size", "p_retailprice", *[(F.col(f"{PART_CAT}_code") == j).cast("double").alias(f"x{j}") for j in range(N_TYPES)])


def _part_hot_sql(src: str) -> str:
    return f"SELECT p_size::double AS p_size, p_retailprice, {', '.join(f'(code = {j})::double AS x{j}' for j in range(N_TYPES))} FROM {src}"


@query("p08_privacy_utility_table", f"WITH RECURSIVE {PART_BASE}, " + ", ".join(
    f"{part_syn_sql(s, k, f'_{s}')}, {attack_sql(f'_{s}', n)}" for n, s, k in _PU) + ", every AS ("
    + " UNION ALL ".join(f"SELECT * FROM att_{s}" for _, s, _ in _PU) + f"), {auc_sql('every', 'res')}, "
    + solved_sql(" UNION ALL ".join(system_sql("ridge", n, f"({_part_hot_sql(f'psyn_{s}')})", _PART_FEATURES, "p_retailprice", 1.0) for n, s, _ in _PU))
    + f""", pr AS (SELECT scenario AS run, p_retailprice AS y, intercept + list_dot_product(b, [{', '.join(_PART_FEATURES)}]::double[]) AS p FROM ({_part_hot_sql('pte')}), fits),
 ut AS (SELECT run, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pr GROUP BY run)
 SELECT run AS method, {R('r2')} AS r2, {R('auc')} AS auc, {R('1 - auc')} AS privacy FROM res JOIN ut USING (run)""")
def p08(spark, d):
    from semblance.operators.privacy import attack_auc

    train, hold, _ = part_parts(spark, d)
    parts = {n: _part_hot(part_copy(train, s, k)) for n, s, k in _PU}
    r2 = U.tstr_linear(parts, {n: (n,) for n in parts}, _part_hot(hold), {"ridge": U.LinearSpec(_PART_FEATURES)}, "p_retailprice")
    auc = attack_auc(part_runs(spark, d, _PU)).select(F.col("run").alias("method"), "auc")
    return rounded(privacy_utility_table(r2.select(F.col("scenario").alias("method"), "r2"), auc))


# ---- the verdict on line items ---------------------------------------------------------

_COMBOS = len(LEVELS["l_returnflag"]) * len(LEVELS["l_linestatus"])
_CODE = "(list_position(['A', 'N', 'R'], l_returnflag) - 1) * 2 + list_position(['F', 'O'], l_linestatus) - 1"
_SCALED = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(DIMS))
_HOT_GAP = " + ".join(
    [f"(CASE WHEN (a // 2 = {j}) <> (b // 2 = {j}) THEN 1 / (h{j} * h{j}) ELSE 0 END)" for j in range(3)] + [f"(CASE WHEN (a % 2 = {j}) <> (b % 2 = {j}) THEN 1 / (h{3 + j} * h{3 + j}) ELSE 0 END)" for j in range(2)])
_NEAR = " + ".join(f"(x.z{i} - y.z{i}) * (x.z{i} - y.z{i})" for i in range(4))
# one-hot blocks add a constant per pair of category combinations; other combinations matter only where that is below the own nearest
_LINE_ATTACK = f"""{_LSPLIT}, {_syn_sql()}, mo AS (SELECT {', '.join(f'avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}' for i, c in enumerate(DIMS))},
  {', '.join(f'coalesce(nullif(stddev_pop({c}), 0), 1) AS h{j}' for j, c in enumerate(HOT))} FROM (SELECT *, {_HOT_SQL} FROM syn)),
 ra AS (SELECT 'member' AS role, k AS id, {_CODE} AS cc, {_SCALED} FROM tr, mo UNION ALL SELECT 'nonmember', k, {_CODE}, {_SCALED} FROM te, mo), sy AS (SELECT {_CODE} AS cc, {_SCALED} FROM syn, mo),
 gp AS (SELECT a, b, {_HOT_GAP} AS gap FROM (SELECT unnest(range({_COMBOS})) AS a), (SELECT unnest(range({_COMBOS})) AS b), mo),
 ow AS (SELECT role, id, any_value(x.cc) AS cc, {', '.join(f'any_value(x.z{i}) AS z{i}' for i in range(4))}, min({_NEAR}) AS d2 FROM ra x JOIN sy y ON y.cc = x.cc GROUP BY role, id),
 ot AS (SELECT role, id, min(gap + {_NEAR}) AS d2 FROM (SELECT ra.*, d2 FROM ra LEFT JOIN ow USING (role, id)) x JOIN gp ON gp.a = x.cc AND gp.b <> x.cc AND (x.d2 IS NULL OR gp.gap < x.d2) JOIN sy y ON y.cc = gp.b GROUP BY role, id),
 att AS (SELECT '0' AS run, role, ra.id, sqrt(least(coalesce(ow.d2, ot.d2), coalesce(ot.d2, ow.d2))) AS distance FROM ra LEFT JOIN ow USING (role, id) LEFT JOIN ot USING (role, id))"""


@query("p06_privacy_verdict_lineitem", f"""WITH {_LINE_ATTACK}, {auc_sql('att', 'res')} SELECT run, {R('auc')} AS auc, {R('tpr1')} AS tpr_at_1_fpr, {R('tpr5')} AS tpr_at_5_fpr,
 {R('member_mean')} AS member_mean, {R('nonmember_mean')} AS nonmember_mean, n_member, n_nonmember, auc < 0.6 AS safe, {BAND_SQL.format(a='auc')} AS band FROM res""")
def p06l(spark, d):
    df, layout, _ = line_layout(spark, d)
    # the split is written once: the copy's draws and both sides read it several times
    s = cut_lineage(split_random(df, F.col("k")))
    train, hold = s.where("NOT is_test"), s.where("is_test")
    syn = A.noise_relative(train, F.col("k"), NUMERIC, TARGET)
    key = F.col("k")
    feats = [V.attack_features(train, layout, key), V.attack_features(hold, layout, key), V.attack_features(syn, layout, F.col("i"))]
    return rounded(V.privacy_verdict(V.attack_distances(*feats)))
