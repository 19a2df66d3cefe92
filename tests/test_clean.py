import pytest
from pyspark.sql import functions as F

from semblance.functions import text as X
from semblance.operators.clean import drop_null_rows, filter_keywords, keep_positive, parse_target


def values(spark, col, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(col(F.col("s"))).collect()]


def test_locale_numbers(spark):
    rows = ["1.234,56", " 7 ", "12.5", "abc", "", None, "-3,5"]
    assert values(spark, X.parse_locale_number, rows) == [1234.56, 7.0, 125.0, None, None, None, -3.5]


def test_simple_dims(spark):
    rows = ["M8x25", "M8X25,5", "XM8x25", None, "M8x1,00x50"]
    assert values(spark, lambda c: F.struct(*X.extract_dims_simple(c)), rows) == [(8.0, 25.0), (8.0, 25.5), (None, None), (None, None), (8.0, 1.0)]


def test_pitch_dims(spark):
    rows = ["M8x1,00x50", "Ø8.91x67,50", "M16x12015071", "M8x1x50", None]
    want = [(8.0, 50.0), (8.91, 67.5), (16.0, None), (8.0, 1.0), (None, None)]
    assert values(spark, lambda c: F.struct(*X.extract_dims_pitch(c)), rows) == want


def test_tokens_sizes_grades(spark):
    assert values(spark, X.classify_token, ["A FT B", "A FT", "FT A", "A FT HT", "a ht", None]) == ["FT", "FT", "Belirsiz", "FT", "HT", "Belirsiz"]
    assert values(spark, X.simplify_size, ["M10", "M10A", "M10.5", "3/8", "M", None]) == ["M10", "M10A", "Other", "Other", "M", "Other"]
    assert values(spark, X.prefix_bucket, [" ozel ", "OZEL+A2", "OZEL+X", None]) == ["OZEL", "OZEL+A", "Other", "Other"]


def test_row_filters(spark):
    df = spark.createDataFrame([("Özel x", 1.0), ("ozel", -1.0), (None, 2.0), ("std", None)], "s string, v double")
    assert filter_keywords(df, "s").count() == 2
    assert drop_null_rows(df, ["s", "v"]).count() == 2
    assert keep_positive(df, ["v"]).count() == 2
    texts = spark.createDataFrame([("1,5",), ("x",), (None,)], "y string")
    assert [r.y for r in parse_target(texts, "y").collect()] == [pytest.approx(1.5)]
