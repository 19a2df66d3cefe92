"""Typed forms of marked texts against one pattern per form."""

from pyspark.sql import functions as F

from semblance.llm import decontaminate as D

TEXTS = ["We saw Anna, Bob paid 3.50 usd or 1,000 km. By 5 P.M. Reá 3 left", "call Jó5 Ann x́5 kg, the Zoe.5 the Éva,7", "", None, "... , .", "7 kg 7 Kg. #@& the #Ann @Bob 5,,5 l"]


def test_typed_forms_share_their_number_pattern(spark):
    """One pattern for numbers and units serves both forms: a text is not searched for them twice."""
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string").select("id", D.marked_text(F.col("text")).alias("m"))
    typed = D.numbers_typed(F.col("m"))
    rest = r"([#@&])[^\x20\x09-\x0D]+"
    rows = marked.select("m", D.canonical(typed).alias("slots"), F.regexp_replace("m", rest, "$1").alias("slots_plain"), D.with_names(typed).alias("names"), F.regexp_replace(F.translate("m", "@", ""), rest, "$1").alias("names_plain")).collect()
    assert any("@" in r.m for r in rows) and any("&" in r.m for r in rows)
    for r in rows:
        assert "." not in r.m and "," not in r.m
        assert (r.slots, r.names) == (r.slots_plain, r.names_plain)
