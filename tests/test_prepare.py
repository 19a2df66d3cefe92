import pytest
from pyspark.sql import functions as F

from semblance.functions.arrays import argmax
from semblance.operators import layout as L
from semblance.operators import prepare as P
from semblance.sources import io
from semblance.streaming.apply import prepare_stream, write_prepared


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(500).select("id", (F.col("id") * F.col("id") % 97).cast("double").alias("a"), F.lit(3.0).alias("c"), (F.col("id") % 4).cast("string").alias("s"))


@pytest.mark.parametrize("fit", [P.fit_minmax, P.fit_standard, lambda d, c: P.fit_quantile_normal(d, c, "raw")])
def test_inverse(df, fit):
    params = fit(df, ["a", "c"])
    back = P.unscale(P.scale(df, params), params).join(df.select("id", F.col("a").alias("a0"), F.col("c").alias("c0")), "id")
    assert back.where((F.abs(F.col("a") - F.col("a0")) > 1e-6) | (F.abs(F.col("c") - F.col("c0")) > 1e-6)).count() == 0


def test_minmax_keeps_out_of_range_values(spark, df):
    params = P.fit_minmax(df, ["a"])
    assert P.scale(spark.createDataFrame([(1000.0,)], "a double"), params).first().a > 1


def test_rare_groups(spark):
    rows = [("x",)] * 50 + [("y",)] * 49
    d = spark.createDataFrame(rows, "s string")
    got = P.group_rare(d, P.fit_frequent(d, ["s"]), ["s"]).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"x": 50, "Other": 49}
    assert P.drop_constant_categories(d.withColumn("k", F.lit("A")), ["s", "k"]).columns == ["s"]


def test_codes_are_in_text_order_and_unseen_fails(spark):
    d = spark.createDataFrame([("10",), ("2",), ("1",)], "s string")
    dic = L.fit_dictionary(d, ["s"])
    assert {r.value: r.idx for r in dic.collect()} == {"10": 1, "2": 2, "1": 0}
    with pytest.raises(Exception, match="unseen value"):
        L.label_encode(spark.createDataFrame([("7",)], "s string"), dic, ["s"]).collect()


def test_first_maximum_wins(spark):
    assert spark.range(1).select(argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))).first()[0] == 0


def test_bundle_and_params_round_trip(spark, df, tmp_path):
    dic = L.fit_dictionary(df, ["s"])
    layout = L.Layout(("a",), "c", ("s",), L.cardinalities(dic))
    io.save_prepared(df, layout, dic, str(tmp_path / "b"))
    rows, kept, dic2 = io.load_prepared(spark, str(tmp_path / "b"))
    assert rows.count() == 500 and kept == layout and dic2.count() == 4
    for p in (P.fit_minmax(df, ["a"]), P.fit_quantile_normal(df, ["a"])):
        io.save_params(spark, p, str(tmp_path / p.kind))
        assert io.load_params(spark, str(tmp_path / p.kind)) == p
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xlsx")


def test_transforms_run_on_streams(spark, df, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.select("id", "a").write.parquet(src)
    stream = spark.readStream.schema("id long, a double").parquet(src)
    params = P.fit_minmax(df, ["a"])
    write_prepared(prepare_stream(stream, limits=P.fit_clip(df, ["a"]), scalers=[params]), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 500
