"""Working tables derived from the given ones, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.rand import row_key, uniform
from semblance.plans import sqltext as S
from semblance.plans.registry import table


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column so that engines agree; +0.0 removes negative zero."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append((F.round(F.col(f.name), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def R(x: str, digits: int = 6) -> str:
    return f"(round(cast({x} AS double), {digits}) + 0.0::double)"


def line_key() -> Column:
    return row_key(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("k", line_key())


def null_where(c: str, seed: str, key: Column, share: float = 0.1) -> Column:
    """The column with about ``share`` of its values blanked by hash."""
    return F.when(uniform(f"null/{seed}", key) >= share, F.col(c))


def null_sql(c: str, seed: str, k: str, share: float = 0.1) -> str:
    return f"CASE WHEN {S.uniform(f'null/{seed}', k)} >= {share} THEN {c} END"


# Numeric columns, target and categories of the regression table.
NUMERIC = ("l_quantity", "l_discount", "l_tax")
TARGET = "l_extendedprice"
CATS = ("l_returnflag", "l_linestatus")


def gappy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with hash-placed nulls in one numeric and one text column and a constant column."""
    df = lines(spark, d)
    return df.select(
        "k", null_where("l_quantity", "q", F.col("k")).alias("l_quantity"), "l_discount", "l_tax", "l_extendedprice",
        null_where("l_returnflag", "f", F.col("k"), 0.3).alias("l_returnflag"), "l_linestatus", F.lit("A").alias("plant"),
    )


GAPPY = (
    f"SELECT k, {null_sql('l_quantity', 'q', 'k')} AS l_quantity, l_discount, l_tax, l_extendedprice, "
    f"{null_sql('l_returnflag', 'f', 'k', 0.3)} AS l_returnflag, l_linestatus, 'A' AS plant FROM ({S.LINE})"
)


def locale_text(c: Column) -> Column:
    """Money as text with . for thousands and , for decimals (below one million)."""
    cents = F.round(c * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    head = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0")))
    return F.concat(F.coalesce(head, whole.cast("string")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def locale_sql(c: str) -> str:
    cents = f"cast(round({c} * 100) AS bigint)"
    whole = f"({cents} // 100)"
    return (
        f"(CASE WHEN {whole} >= 1000 THEN concat(cast({whole} // 1000 AS varchar), '.', lpad(cast({whole} % 1000 AS varchar), 3, '0')) "
        f"ELSE cast({whole} AS varchar) END || ',' || lpad(cast({cents} % 100 AS varchar), 2, '0'))"
    )


def raw_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a raw catalogue: sizes, descriptions, grades and prices as text, with gaps."""
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    length = (F.lit(10) + k % 900).cast("string")
    kind = k % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("M"), size, F.lit("x"), length))
        .when(kind == 1, F.concat(F.lit("M"), size, F.lit("X"), length, F.lit(",5")))
        .when(kind == 2, F.concat(F.lit("Ø"), size, F.lit(".91x1,25x"), length, F.lit(",50")))
        .when(kind == 3, F.concat(F.lit("M"), size, F.lit("x1,00x"), length))
        .otherwise(F.concat(F.lit("XM"), size, F.lit("x"), length))
    )
    tail = F.element_at(F.array(*[F.lit(x) for x in (" FT", " ft b", " HT", "FT x", " HT FT ")]), (kind + 1).cast("int"))
    grade = F.element_at(F.array(*[F.lit(x) for x in (" ozel ", "OZEL+A2", "ozel+r", "OZEL+T9", "OZEL+X")]), (kind + 1).cast("int"))
    code = F.when(kind == 0, F.concat(F.lit(" M"), size)).when(kind == 1, F.concat(F.lit("M"), size, F.lit("A"))).when(
        kind == 2, F.concat(F.lit("M"), size, F.lit(".5"))).when(kind == 3, F.concat(size, F.lit("/8"))).otherwise(F.lit("M"))
    word = F.element_at(F.array(F.lit("özel "), F.lit("std "), F.lit("OZEL "), F.lit(""), F.lit("Özel-")), (kind + 1).cast("int"))
    out = p.select(
        k.alias("p_partkey"), text.alias("dims_text"), F.concat(word, F.col("p_name"), tail).alias("descr"), code.alias("size_code"),
        grade.alias("grade"), locale_text(F.col("p_retailprice")).alias("price_text"), "p_brand", "p_type", "p_size", "p_retailprice",
        F.when(kind == 4, -1.0).otherwise(F.col("p_size").cast("double")).alias("reading"),
    )
    gaps = ("dims_text", "descr", "size_code", "grade", "price_text")
    return out.withColumns({c: null_where(c, c, F.col("p_partkey")) for c in gaps})


def _pick(options: tuple[str, ...]) -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


_LEN = "cast(10 + p_partkey % 900 AS varchar)"
_RAW = f"""SELECT p_partkey,
 CASE p_partkey % 5 WHEN 0 THEN concat('M', p_size, 'x', {_LEN}) WHEN 1 THEN concat('M', p_size, 'X', {_LEN}, ',5')
  WHEN 2 THEN concat('Ø', p_size, '.91x1,25x', {_LEN}, ',50') WHEN 3 THEN concat('M', p_size, 'x1,00x', {_LEN})
  ELSE concat('XM', p_size, 'x', {_LEN}) END AS dims_text,
 concat({_pick(('özel ', 'std ', 'OZEL ', '', 'Özel-'))}, p_name, {_pick((' FT', ' ft b', ' HT', 'FT x', ' HT FT '))}) AS descr,
 CASE p_partkey % 5 WHEN 0 THEN concat(' M', p_size) WHEN 1 THEN concat('M', p_size, 'A') WHEN 2 THEN concat('M', p_size, '.5')
  WHEN 3 THEN concat(p_size, '/8') ELSE 'M' END AS size_code,
 {_pick((' ozel ', 'OZEL+A2', 'ozel+r', 'OZEL+T9', 'OZEL+X'))} AS grade,
 {locale_sql('p_retailprice')} AS price_text, p_brand, p_type, p_size, p_retailprice,
 CASE WHEN p_partkey % 5 = 4 THEN -1.0::double ELSE cast(p_size AS double) END AS reading FROM part"""
_GAPS = ("dims_text", "descr", "size_code", "grade", "price_text")
_PART_GAPS = ", ".join(f"{null_sql(c, c, 'p_partkey')} AS {c}" for c in _GAPS)
RAW_PARTS = f"SELECT * REPLACE ({_PART_GAPS}) FROM ({_RAW})"
