"""Registered queries: bootstrap, noise, labels, oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.operators import layout as L
from semblance.operators import sampling as A
from semblance.operators.prepare import split_stratified
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, NUMERIC, TARGET, R, line_key, lines, rounded
from semblance.plans.prepare_queries import CODED, line_layout
from semblance.plans.registry import query, table

DIMS = (*NUMERIC, TARGET)
NUMBERED = S.numbered(f"({S.LINE})", 42, "k")
BOOT = f"""n AS ({NUMBERED}), dr AS (SELECT i, {S.draw(42, 'i', '(SELECT count(*) FROM n)')} AS idx FROM range((SELECT count(*) FROM n)) AS r(i)),
 b AS (SELECT dr.i, n.* EXCLUDE (idx) FROM dr JOIN n USING (idx))"""


def line_cols(spark, d):
    return lines(spark, d).select("k", *DIMS, *CATS)


def noisy_lines(spark, d, seed: int = 42, scale_by: float = 0.1):
    """The synthetic copy used by the report queries: noise scaled to each column's std."""
    return A.noise_relative(line_cols(spark, d), F.col("k"), NUMERIC, TARGET, scale_by=scale_by, seed=seed)


def noisy_sql(seed: int = 42) -> str:
    """CTEs ending in ``syn``, the SQL of :func:`noisy_lines`."""
    boot = BOOT.replace("'42", f"'{seed}").replace("42/draw", f"{seed}/draw")
    cols = ", ".join(f"{c} + 0.1 * (SELECT stddev_pop({c}) FROM lineitem) * {S.normal(f'{seed}/{c}', 'i')} AS {c}" for c in DIMS)
    return f"{boot}, syn AS (SELECT i, {cols}, {', '.join(CATS)} FROM b)"


@query("e01_bootstrap", f"WITH {BOOT} SELECT i, k FROM b")
def e01(spark, d):
    return A.bootstrap(lines(spark, d).select("k"), F.col("k"))


@query("e02_noise_absolute", f"WITH {BOOT} SELECT i, " + ", ".join(
    f"{R(f'{c} + 0.1 * ' + S.normal(f'42/{c}', 'i'))} AS {c}" for c in NUMERIC) + f", {TARGET} FROM b")
def e02(spark, d):
    return rounded(A.noise_absolute(line_cols(spark, d), F.col("k"), NUMERIC).select("i", *NUMERIC, TARGET))


@query("e03_noise_relative", f"WITH {noisy_sql()} SELECT i, " + ", ".join(f"{R(c)} AS {c}" for c in DIMS) + f", {', '.join(CATS)} FROM syn")
def e03(spark, d):
    return rounded(noisy_lines(spark, d).select("i", *DIMS, *CATS))


@query("e04_noise_hybrid", f"WITH c AS ({CODED}), {BOOT.replace('(' + S.LINE + ')', 'c')} SELECT i, " + ", ".join(
    f"{R(f'{c} + 0.1 * ' + S.normal(f'42/{j}', 'i'))} AS h{j}" for j, c in enumerate(DIMS)) + ", " + ", ".join(
    f"(l_returnflag_code = {j})::double AS h{4 + j}" for j in range(3)) + ", " + ", ".join(
    f"(l_linestatus_code = {j})::double AS h{7 + j}" for j in range(2)) + " FROM b")
def e04(spark, d):
    df, layout, _ = line_layout(spark, d)
    h = A.noise_hybrid(L.assemble(df, layout, keep=["k"]), F.col("k"), len(DIMS))
    return rounded(h.select("i", *[F.col("hybrid")[j].alias(f"h{j}") for j in range(9)]))


@query("e05_sample_marginal_categories", f"""WITH n AS ({NUMBERED}),
 g AS (SELECT o_orderkey, {S.index('42/marginal', 'o_orderkey', '(SELECT count(*) FROM n)')} AS idx FROM orders)
 SELECT o_orderkey, l_returnflag, l_linestatus FROM g JOIN n USING (idx)""")
def e05(spark, d):
    gen = table(spark, d, "orders").select("o_orderkey")
    return A.sample_marginal_categories(gen, F.col("o_orderkey"), lines(spark, d), line_key(), CATS)


# labelled documents: quality classes with the document's size and text statistics
DOCS = """SELECT d.doc_id, l.quality, cast(d.n_chars AS double) AS n_chars, cast(length(d.text) - length(replace(d.text, ' ', '')) AS double) AS n_blanks,
 cast(length(d.text) - length(replace(d.text, chr(10), '')) AS double) AS n_breaks, d.lang FROM documents d JOIN labels l USING (doc_id)"""
DOC_COLS = ("n_chars", "n_blanks", "n_breaks")


def labelled_documents(spark, d):
    docs = table(spark, d, "documents")
    t = F.col("text")
    stats = docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("double").alias("n_blanks"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("n_breaks"), "lang",
    )
    return stats.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


_DSPLIT = f"d AS ({DOCS}), s AS ({S.split('d', 'cast(doc_id AS varchar)', by='quality')}), tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test)"
_ZS = ", ".join(f"({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_pop({c}) FROM tr) AS {c}" for c in DOC_COLS)
_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DOC_COLS) + ")"


def _knn_label_sql(k: int) -> str:
    return f"""WITH {_DSPLIT}, zt AS (SELECT doc_id, quality, {_ZS} FROM tr), ze AS (SELECT doc_id, {_ZS} FROM te),
 p AS (SELECT a.doc_id, b.doc_id AS pid, b.quality, {_DIST} AS dist FROM ze a, zt b),
 near AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dist, pid) <= {k}),
 v AS (SELECT doc_id, quality, count(*) AS n FROM near GROUP BY 1, 2)
 SELECT doc_id, quality FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, quality) = 1"""


_TRAIN = f"WITH {_DSPLIT} SELECT quality FROM tr"


def _doc_split(spark, d):
    s = split_stratified(labelled_documents(spark, d), F.col("doc_id"), "quality")
    return s.where("NOT is_test").drop("is_test"), s.where("is_test").drop("is_test")


def _knn_labels(spark, d, k):
    train, test = _doc_split(spark, d)
    return A.assign_labels_knn(test.drop("quality"), "doc_id", train, "doc_id", DOC_COLS, "quality", k)


@query("e06_assign_labels_knn1", _knn_label_sql(1))
def e06a(spark, d):
    return _knn_labels(spark, d, 1)


@query("e06_assign_labels_knn5", _knn_label_sql(5))
def e06b(spark, d):
    return _knn_labels(spark, d, 5)


@query("e07_assign_labels_proportional", f"""WITH c AS (SELECT quality, sum(count(*)) OVER (ORDER BY quality) / sum(count(*)) OVER () AS cum FROM labels GROUP BY quality)
 SELECT doc_id, (SELECT min(quality) FROM c WHERE cum > u) AS quality FROM (SELECT doc_id, {S.uniform('42/label', 'doc_id')} AS u FROM documents)""")
def e07(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return A.assign_labels_proportional(docs, F.col("doc_id"), table(spark, d, "labels"), "quality")


_AUTO = f"""k AS ({_knn_label_sql(5)}), nc AS (SELECT count(DISTINCT quality) >= 2 AS ok FROM k),
 cum AS (SELECT quality, sum(count(*)) OVER (ORDER BY quality) / sum(count(*)) OVER () AS cum FROM ({_TRAIN}) GROUP BY quality)
 SELECT doc_id, CASE WHEN ok THEN k.quality ELSE (SELECT min(quality) FROM cum WHERE cum.cum > {S.uniform('42/label', 'doc_id')}) END AS quality,
 ok AS score_alone, CASE WHEN ok THEN 'knn' ELSE 'proportional' END AS used FROM k, nc"""


@query("e08_assign_labels_auto", f"WITH {_AUTO}")
def e08(spark, d):
    train, test = _doc_split(spark, d)
    out, used = A.assign_labels_auto(test.drop("quality"), "doc_id", train, "doc_id", DOC_COLS, "quality")
    return out.select("doc_id", "quality", "score_alone", F.lit(used).alias("used"))


@query("e09_minority_deficit", """SELECT quality, count(*) AS n, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) - count(*) AS deficit
 FROM labels GROUP BY quality""")
def e09(spark, d):
    return A.minority_deficit(table(spark, d, "labels"), "quality")


@query("e12_augment", f"WITH {BOOT} SELECT 'real' AS origin, k FROM ({S.LINE}) UNION ALL SELECT 'synthetic', k FROM b")
def e12(spark, d):
    real = lines(spark, d).select("k")
    return A.augment(real, A.bootstrap(real, F.col("k")).select("k"))


@query("e12_replace", f"WITH {BOOT} SELECT 'synthetic' AS origin, k FROM b")
def e12r(spark, d):
    return A.replace(A.bootstrap(lines(spark, d).select("k"), F.col("k")).select("k"))
