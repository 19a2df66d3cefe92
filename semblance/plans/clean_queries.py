"""Registered queries: text parsing, row filters, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from semblance.functions import text as X
from semblance.operators import clean as C
from semblance.plans import sqltext as S
from semblance.plans.inputs import GAPPY, RAW_PARTS, gappy_lines, lines, locale_sql, locale_text, null_sql, null_where, raw_parts
from semblance.plans.profile_queries import PITCH_DIMS
from semblance.plans.registry import query, table

_PARSE = "try_cast(replace(replace(trim({c}), '.', ''), ',', '.') AS double)"


@query("c02_parse_locale_number", f"SELECT k, price_text, {_PARSE.format(c='price_text')} AS price FROM (SELECT k, {locale_sql('l_extendedprice')} AS price_text FROM ({S.LINE}))")
def c02(spark, d):
    t = lines(spark, d).select("k", locale_text(F.col("l_extendedprice")).alias("price_text"))
    return t.withColumn("price", X.parse_locale_number(F.col("price_text")))


@query("c03_filter_keywords", f"SELECT p_partkey, descr FROM ({RAW_PARTS}) WHERE contains(lower(descr), 'özel') OR contains(lower(descr), 'ozel')")
def c03(spark, d):
    return C.filter_keywords(raw_parts(spark, d), "descr").select("p_partkey", "descr")


_DIMS = r"^M(\d+(?:[.,]\d+)?)[xX](\d+(?:[.,]\d+)?)"


@query("c04_extract_dims_simple", f"""SELECT p_partkey, try_cast(replace(regexp_extract(dims_text, '{_DIMS}', 1), ',', '.') AS double) AS cap,
 try_cast(replace(regexp_extract(dims_text, '{_DIMS}', 2), ',', '.') AS double) AS boy FROM ({RAW_PARTS})""")
def c04(spark, d):
    cap, boy = X.extract_dims_simple(F.col("dims_text"))
    return raw_parts(spark, d).select("p_partkey", cap.alias("cap"), boy.alias("boy"))


@query("c05_extract_dims_pitch", PITCH_DIMS)
def c05(spark, d):
    cap, boy = X.extract_dims_pitch(F.col("dims_text"))
    return raw_parts(spark, d).select("p_partkey", cap.alias("cap"), boy.alias("boy"))


def _word(t: str) -> str:
    return f"contains(upper(descr), ' {t} ') OR ends_with(upper(descr), ' {t}')"


@query("c06_classify_token", f"SELECT p_partkey, CASE WHEN {_word('FT')} THEN 'FT' WHEN {_word('HT')} THEN 'HT' ELSE 'Belirsiz' END AS process FROM ({RAW_PARTS})")
def c06(spark, d):
    return raw_parts(spark, d).select("p_partkey", X.classify_token(F.col("descr")).alias("process"))


@query("c07_simplify_size", f"""SELECT p_partkey, CASE WHEN trim(size_code) LIKE 'M%' AND NOT contains(size_code, '.') THEN trim(size_code) ELSE 'Other' END AS size
 FROM ({RAW_PARTS})""")
def c07(spark, d):
    return raw_parts(spark, d).select("p_partkey", X.simplify_size(F.col("size_code")).alias("size"))


@query("c08_prefix_bucket", f"""SELECT p_partkey, CASE WHEN g = 'OZEL' THEN 'OZEL' WHEN g LIKE 'OZEL+A%' THEN 'OZEL+A' WHEN g LIKE 'OZEL+R%' THEN 'OZEL+R'
 WHEN g LIKE 'OZEL+T%' THEN 'OZEL+T' ELSE 'Other' END AS grade FROM (SELECT p_partkey, upper(trim(grade)) AS g FROM ({RAW_PARTS}))""")
def c08(spark, d):
    return raw_parts(spark, d).select("p_partkey", X.prefix_bucket(F.col("grade")).alias("grade"))


@query("c10_drop_null_rows", f"SELECT k, l_quantity, l_returnflag FROM ({GAPPY}) WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def c10(spark, d):
    return C.drop_null_rows(gappy_lines(spark, d), ["l_quantity", "l_returnflag"]).select("k", "l_quantity", "l_returnflag")


@query("c11_keep_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def c11(spark, d):
    return C.keep_positive(table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("c12_binary_target", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders")
def c12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.binary_target(F.col("o_orderstatus"), "F").alias("y"))


@query("c13_parse_target", f"""SELECT k, {_PARSE.format(c='price')} AS price FROM (SELECT k, {null_sql(locale_sql('l_extendedprice'), 'y', 'k')} AS price FROM ({S.LINE}))
 WHERE price IS NOT NULL""")
def c13(spark, d):
    t = lines(spark, d).select("k", locale_text(F.col("l_extendedprice")).alias("price"))
    return C.parse_target(t.select("k", null_where("price", "y", F.col("k")).alias("price")), "price")
