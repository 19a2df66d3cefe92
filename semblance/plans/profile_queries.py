"""Registered queries: profiling and column selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from semblance.functions.text import extract_dims_pitch
from semblance.operators import profile as P
from semblance.operators.frames import ensure_checkpoint_dir
from semblance.operators.prepare import split_random
from semblance.plans import sqltext as S
from semblance.plans.inputs import GAPPY, NUMERIC, RAW_PARTS, TARGET, R, gappy_lines, lines, raw_parts, rounded
from semblance.plans.registry import query, table

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
_TYPE = "CASE typeof({c}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SQL_TYPES.items()) + " END"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("b01_profile_columns", _union(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", any_value({_TYPE.format(c=c)}) AS type, count({c}) AS non_null, "
    f"count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct FROM lineitem" for i, c in enumerate(LINEITEM)))
def b01(spark, d):
    return P.profile_columns(table(spark, d, "lineitem"))


_B02 = _union(f"SELECT {i} AS p, '{c}' AS c, {_TYPE.format(c=c)} AS t, count({c}) AS n FROM lineitem GROUP BY 3" for i, c in enumerate(LINEITEM))


@query("b02_type_summary", f"""SELECT t AS type, CASE t WHEN 'string' THEN 'categorical' WHEN 'timestamp_ntz' THEN 'datetime' ELSE 'numeric' END AS kind,
 count(*) AS n_columns, string_agg(c, ',' ORDER BY p) AS columns, cast(sum(n) AS bigint) AS n_values FROM ({_B02}) GROUP BY t""")
def b02(spark, d):
    return P.type_summary(table(spark, d, "lineitem"))


_B03 = (*NUMERIC, TARGET)


@query("b03_describe_numeric", _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, "
    f"{R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max, count(*) - count({c}) AS missing FROM ({GAPPY})" for c in _B03))
def b03(spark, d):
    return rounded(P.describe_numeric(gappy_lines(spark, d), _B03), 4)


_B04 = ("p_brand", "p_type", "grade")


@query("b04_top_values", _union(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, {R(f'count(*) * 100.0::double / (SELECT count(*) FROM ({RAW_PARTS}))')} AS percent "
    f"FROM ({RAW_PARTS}) WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 5)" for c in _B04))
def b04(spark, d):
    return rounded(P.top_values(raw_parts(spark, d), _B04, 5))


@query("b05_value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def b05(spark, d):
    return P.value_counts(table(spark, d, "events"), "event_type")


_RAW_COLS = ("p_partkey", "dims_text", "descr", "size_code", "grade", "price_text", "p_brand", "p_type", "p_size", "p_retailprice", "reading")
_MISS = _union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, {R(f'(count(*) - count({c})) * 100.0::double / count(*)')} AS percent FROM ({RAW_PARTS})"
    for c in _RAW_COLS)


@query("b06_missing_report", f"""WITH m AS (SELECT * FROM ({_MISS}) WHERE n_missing > 0)
 SELECT *, greatest((SELECT count(*) FROM m) - 3, 0) AS n_more FROM m ORDER BY n_missing DESC, "column" LIMIT 3""")
def b06(spark, d):
    return rounded(P.missing_report(raw_parts(spark, d), 3))


@query("b07_head_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3")
def b07(spark, d):
    return P.head_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), ["o_orderkey"])


@query("b08_target_stats", f"""SELECT count(l_quantity) AS count, count(*) - count(l_quantity) AS missing, min(l_quantity) AS min, max(l_quantity) AS max,
 {R('avg(l_quantity)')} AS mean, {R('median(l_quantity)')} AS median, {R('stddev_samp(l_quantity)')} AS std FROM ({GAPPY})""")
def b08(spark, d):
    return rounded(P.target_stats(gappy_lines(spark, d), "l_quantity"))


_PCTS = (10, 25, 50, 75, 90, 95)


@query("b09_target_percentiles", _union(
    f"SELECT {p} AS percent, {R(f'quantile_cont(l_extendedprice, {p / 100})', 4)} AS value FROM lineitem" for p in _PCTS))
def b09(spark, d):
    return rounded(P.target_percentiles(table(spark, d, "lineitem"), "l_extendedprice", _PCTS), 4)


@query("b10_fill_report", f"""SELECT 'price' AS target, 'price_text' AS "column", 'found' AS status, count(price_text) AS filled,
 {R('count(price_text) * 100.0::double / count(*)')} AS percent FROM ({RAW_PARTS})
 UNION ALL SELECT 'margin', 'margin_percent', 'NOT FOUND', NULL, NULL""")
def b10(spark, d):
    return rounded(P.fill_report(raw_parts(spark, d), {"price": "price_text", "margin": "margin_percent"}))


@query("b11_corr_with_target", _union(
    f"SELECT '{c}' AS \"column\", {R(f'corr({c}, l_extendedprice)')} AS r FROM ({GAPPY})" for c in NUMERIC))
def b11(spark, d):
    return rounded(P.corr_with_target(gappy_lines(spark, d), NUMERIC, TARGET))


@query("b12_target_by_category", f"""SELECT p_brand AS category, {R('avg(p_retailprice)', 4)} AS mean, {R('stddev_samp(p_retailprice)', 4)} AS std,
 count(*) AS count FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6""")
def b12(spark, d):
    return rounded(P.target_by_category(table(spark, d, "part"), "p_brand", "p_retailprice", 6), 4)


_PITCH = r"^[MØ]?(\d+(?:[.,]\d+)?)[xX]\d+[.,]\d+[xX](\d+(?:[.,]\d+)?)"
_PLAIN = r"^[MØ]?(\d+(?:[.,]\d+)?)[xX](\d+(?:[.,]\d+)?)"


def _group(p: str, g: int) -> str:
    return f"try_cast(replace(regexp_extract(dims_text, '{p}', {g}), ',', '.') AS double)"


PITCH_DIMS = f"""SELECT p_partkey, CASE WHEN regexp_matches(dims_text, '{_PITCH}') THEN {_group(_PITCH, 1)} ELSE {_group(_PLAIN, 1)} END AS cap,
 CASE WHEN regexp_matches(dims_text, '{_PITCH}') THEN {_group(_PITCH, 2)} WHEN {_group(_PLAIN, 2)} <= 500 THEN {_group(_PLAIN, 2)} END AS boy
 FROM ({RAW_PARTS})"""


@query("b13_extraction_coverage", _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS parsed, {R(f'count({c}) * 100.0::double / count(*)')} AS percent, min({c}) AS min, max({c}) AS max FROM ({PITCH_DIMS})"
    for c in ("cap", "boy")))
def b13(spark, d):
    cap, boy = extract_dims_pitch(F.col("dims_text"))
    return rounded(P.extraction_coverage(raw_parts(spark, d).select(cap.alias("cap"), boy.alias("boy")), ["cap", "boy"]))


def _side(c: str, s: str, cond: str) -> str:
    f = f"FILTER (WHERE {cond})"
    return (f"{R(f'min({c}) {f}', 4)} AS {s}_min, {R(f'max({c}) {f}', 4)} AS {s}_max, {R(f'avg({c}) {f}', 4)} AS {s}_mean, "
            f"{R(f'stddev_samp({c}) {f}', 4)} AS {s}_std")


_CMP = S.split(f"({S.LINE})", "k")


@query("b14_compare_splits", _union(
    f"SELECT '{c}' AS \"column\", {_side(c, 'train', 'NOT is_test')}, {_side(c, 'test', 'is_test')} FROM ({_CMP})" for c in _B03))
def b14(spark, d):
    s = split_random(lines(spark, d).select("k", *_B03), F.col("k"))
    return rounded(P.compare_splits(s.where("NOT is_test"), s.where("is_test"), _B03), 4)


# ---- column rules ----------------------------------------------------------------------

_MIXED_COLS = ("k", "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity", "price_text", "l_returnflag", "code_text", "fill_low", "tax_kod")
_MIXED = f"""SELECT k, l_orderkey, l_shipdate, l_linenumber, l_quantity,
 concat(cast(cast(round(l_extendedprice * 100) AS bigint) // 100 AS varchar), ',', lpad(cast(cast(round(l_extendedprice * 100) AS bigint) % 100 AS varchar), 2, '0')) AS price_text,
 l_returnflag, cast(l_linenumber AS varchar) AS code_text, CASE WHEN {S.uniform('fill', 'k')} < 0.2 THEN l_tax END AS fill_low, l_tax AS tax_kod FROM ({S.LINE})"""


def mixed_lines(spark, d):
    from semblance.functions.rand import uniform

    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return lines(spark, d).select(
        "k", "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity",
        F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")).alias("price_text"),
        "l_returnflag", F.col("l_linenumber").cast("string").alias("code_text"),
        F.when(uniform("fill", F.col("k")) < 0.2, F.col("l_tax")).alias("fill_low"), F.col("l_tax").alias("tax_kod"),
    )


_NUM = {"l_orderkey", "l_linenumber", "l_quantity", "fill_low", "tax_kod"}
_TXT = {"k", "price_text", "l_returnflag", "code_text"}


def _kind_sql(c: str) -> str:
    if "date" in c:
        return "'date'"
    if c in _NUM:
        return "'numeric'"
    return f"CASE WHEN bool_and(regexp_matches({c}, '^[.,-]*[0-9][0-9.,-]*$')) AND count(DISTINCT {c}) > 20 THEN 'numeric*' ELSE 'categorical' END"


@query("c01_infer_kinds", f"WITH m AS ({_MIXED}) " + _union(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", {_kind_sql(c)} AS kind, {R(f'count({c}) * 100.0::double / count(*)')} AS filled_percent, "
    f"count(DISTINCT {c}) AS n_distinct FROM m" for i, c in enumerate(_MIXED_COLS)))
def c01(spark, d):
    return rounded(P.infer_kinds(mixed_lines(spark, d)))


def _select_sql(mode: str) -> str:
    names = P.NUMERIC_MODE_EXCLUDED if mode == "numeric" else P.FULL_MODE_EXCLUDED
    parts = []
    for c in _MIXED_COLS:
        if c == "l_quantity":
            continue
        hit = next((p for p in names if p in c), None)
        fill = f"count({c}) / count(*)"
        if hit:
            dec, why = "'drop'", f"'name contains {hit}'"
        elif mode == "numeric":
            parsed = f"count(try_cast(replace(replace(trim({c}), '.', ''), ',', '.') AS double)) / count(*)" if c in _TXT else "0"
            ok = f"{fill} >= 0.3" if c in _NUM else f"{parsed} > 0.5 AND {parsed} >= 0.3"
            dec = f"CASE WHEN {ok} THEN 'numeric' ELSE 'drop' END"
            why = f"CASE WHEN {ok} THEN '{'numeric type' if c in _NUM else 'parseable text'}' ELSE 'not numeric or too empty' END"
        else:
            n = f"count(DISTINCT {c})"
            if c in _NUM:
                kind = f"CASE WHEN {n} > 10 THEN 'numeric' ELSE 'categorical' END"
            elif c in _TXT:
                like = f"count(*) FILTER (WHERE regexp_matches({c}, '^[., -]*[0-9][0-9., -]*$')) > 0.8 * count({c})"
                kind = f"CASE WHEN {like} AND {n} > 20 THEN 'numeric' WHEN {n} <= 50 THEN 'categorical' ELSE 'drop' END"
            else:
                kind = "'drop'"
            dec = f"CASE WHEN {fill} < 0.5 THEN 'drop' ELSE {kind} END"
            why = f"CASE WHEN {fill} < 0.5 THEN 'too empty' WHEN {kind} = 'drop' THEN 'no usable type' ELSE 'kept' END"
        parts.append(f"SELECT '{c}' AS \"column\", {dec} AS decision, {why} AS reason FROM m")
    return f"WITH m AS ({_MIXED}) SELECT DISTINCT * FROM ({_union(parts)})"


@query("c09_select_columns_numeric", _select_sql("numeric"))
def c09n(spark, d):
    return P.select_columns(mixed_lines(spark, d), "l_quantity", "numeric")


@query("c09_select_columns_full", _select_sql("full"))
def c09f(spark, d):
    return P.select_columns(mixed_lines(spark, d), "l_quantity", "full")


# ---- mergeable states ------------------------------------------------------------------

_SKETCHED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_REGISTERS = " UNION ALL ".join(f"SELECT '{c}' AS col, md5(cast({c} AS varchar)) AS h FROM orders WHERE {c} IS NOT NULL" for c in _SKETCHED if c != "o_totalprice")


@query("b01_distinct_sketch", f"""WITH hs AS ({_REGISTERS}), rg AS (SELECT col, ('0x' || substr(h, 1, 3))::int AS register, max(53 - CASE WHEN ('0x' || substr(h, 4, 13))::bigint > 0 THEN length(bin(('0x' || substr(h, 4, 13))::bigint)) ELSE 0 END) AS rank FROM hs GROUP BY 1, 2),
 sm AS (SELECT col, count(*) AS filled, sum(pow(2.0::double, -rank)) + 4096 - count(*) AS inverse FROM rg GROUP BY col), es AS (SELECT *, 0.7213::double / (1 + 1.079::double / 4096) * 4096 * 4096 / inverse AS raw FROM sm)
 SELECT col AS "column", {R('CASE WHEN raw <= 2.5 * 4096 AND filled < 4096 THEN 4096.0::double * ln(4096.0::double / (4096 - filled)) ELSE raw END')} AS n_distinct, true AS merge_equals_whole, true AS within_five_errors FROM es""")
def b01s(spark, d):
    """States of two halves are stored, read back, merged, and compared with the state of the whole and with the exact counts."""
    from semblance.operators import sketches as K

    cols = [c for c in _SKETCHED if c != "o_totalprice"]
    o = table(spark, d, "orders").select(*cols)
    odd = F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == 1
    merged = K.merge_distinct(*[_stored(spark, K.distinct_state(part, cols)) for part in (o.where(odd), o.where(~odd))])
    differ = merged.exceptAll(K.distinct_state(o, cols)).unionByName(K.distinct_state(o, cols).exceptAll(merged)).count()
    exact = P.distinct_counts(o, cols)
    truth = F.create_map(*[F.lit(x) for c in cols for x in (c, float(exact[c]))])[F.col("column")]
    near = F.abs(F.col("n_distinct") - truth) <= 5 * 1.04 / 64.0 * truth
    return rounded(K.distinct_estimates(merged).select("column", "n_distinct", F.lit(differ == 0).alias("merge_equals_whole"), near.alias("within_five_errors")))


_GROWTH = "(1.01::double / 0.99::double)"
_PERCENTS = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)


@query("b09_quantile_sketch", f"""WITH vs AS (SELECT o_totalprice - 100000 AS v FROM orders), bk AS (SELECT sign(v)::int AS side, CASE WHEN v <> 0 THEN ceil(ln(abs(v)) / ln({_GROWTH}))::int ELSE 0 END AS bucket, count(*) AS n FROM vs GROUP BY 1, 2),
 cu AS (SELECT *, sum(n) OVER (ORDER BY side * bucket + side * 1048576) AS upto, sum(n) OVER () AS total FROM bk), ps AS (SELECT unnest([{', '.join(map(str, _PERCENTS))}]::double[]) AS prob),
 ex AS (SELECT prob, floor(prob * ((SELECT count(*) FROM vs) - 1)) AS spot FROM ps), so AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM vs)
 SELECT 'price' AS "column", ps.prob, {R(f'side * pow({_GROWTH}, bucket) * 2 / ({_GROWTH} + 1)', 3)} AS value, abs(side * pow({_GROWTH}, bucket) * 2 / ({_GROWTH} + 1) - v) <= 0.0100001 * abs(v) AS within_error
 FROM ps JOIN ex USING (prob) JOIN so ON r = spot JOIN cu ON floor(ps.prob * (total - 1)) < upto AND floor(ps.prob * (total - 1)) >= upto - n""")
def b09s(spark, d):
    """Percentiles from the merged states of two halves, and whether they are within 1 % of the exact ones."""
    from semblance.operators import sketches as K
    from semblance.operators.ranks import order_statistics

    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("price"))
    odd = F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == 1
    merged = K.merge_quantiles(*[_stored(spark, K.quantile_state(part, ["price"])) for part in (o.where(odd), o.where(~odd))])
    spots = {p: int(p * (o.count() - 1)) for p in _PERCENTS}
    exact = order_statistics(o, {"price": sorted(set(spots.values()))})["price"]
    truth = F.create_map(*[F.lit(x) for p in _PERCENTS for x in (p, float(exact[spots[p]]))])[F.col("prob")]
    return rounded(K.quantile_estimates(merged, _PERCENTS).withColumn("within_error", F.abs(F.col("value") - truth) <= 0.0100001 * F.abs(truth)), 3)


def _stored(spark, state):
    """A state written to and read from a table of its own."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/state-{uuid.uuid4().hex}"
    state.write.parquet(path)
    return spark.read.parquet(path)
