"""Registered queries: round trips through the sources and sinks, on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from semblance.operators import prepare as P
from semblance.operators.frames import ensure_checkpoint_dir
from semblance.plans import sqltext as S
from semblance.plans.inputs import CATS, NUMERIC, TARGET, R, lines, rounded
from semblance.plans.prepare_queries import CODED, line_layout, split_lines
from semblance.plans.registry import query, table
from semblance.plans.utility_queries import _TIDY, scores
from semblance.operators.utility import tidy
from semblance.sources import io

DIMS = (*NUMERIC, TARGET)


def _folder(spark) -> str:
    """A fresh folder beside the checkpoints, on storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"


@query("a01_read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a01(spark, d):
    path = f"{_folder(spark)}/customer"
    table(spark, d, "customer").write.option("header", True).csv(path)
    back = io.read_table(spark, path, "csv")
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("a02_write_synthetic", f"SELECT p_size, p_type, {R('p_retailprice')} AS target FROM part")
def a02(spark, d):
    path = f"{_folder(spark)}/synthetic"
    io.write_synthetic(table(spark, d, "part").select("p_size", "p_retailprice", "p_type"), path, "csv", target="p_retailprice")
    return rounded(io.read_table(spark, path, "csv", "p_size int, p_type string, target double"))


@query("a03_export_split", f"""WITH s AS ({S.split('(' + S.LINE + ')', 'k')}) SELECT count(*) AS n_samples, 3::bigint AS n_features,
 count(*) FILTER (WHERE NOT is_test) AS train_size, count(*) FILTER (WHERE is_test) AS test_size, 'lineitem' AS name, 42::bigint AS seed FROM s""")
def a03(spark, d):
    s = split_lines(spark, d).select("k", "is_test", *DIMS)
    path = _folder(spark)
    io.export_split(s.where("NOT is_test").drop("is_test"), s.where("is_test").drop("is_test"), path, "lineitem", NUMERIC, TARGET)
    meta = io.read_metadata(spark, path)
    cols = ("n_samples", "n_features", "train_size", "test_size", "name", "seed")
    return spark.createDataFrame([tuple(meta[c] for c in cols)], "n_samples bigint, n_features bigint, train_size bigint, test_size bigint, name string, seed bigint")


@query("a04_save_load_prepared", f"SELECT k, {', '.join(DIMS)}, l_returnflag_code, l_linestatus_code FROM ({CODED})")
def a04(spark, d):
    df, layout, dic = line_layout(spark, d)
    path = _folder(spark)
    io.save_prepared(df.select("k", *DIMS, *[f"{c}_code" for c in CATS]), layout, dic, path)
    back, kept, _ = io.load_prepared(spark, path)
    return back.select("k", *kept.dims, *[f"{c}_code" for c in kept.categorical])


@query("a05_save_load_params", "SELECT k, " + ", ".join(
    R(f"({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) * 2 - 1") + f" AS {c}" for c in DIMS) + f" FROM ({S.LINE})")
def a05(spark, d):
    df = lines(spark, d).select("k", *DIMS)
    path = _folder(spark)
    io.save_params(spark, P.fit_minmax(df, DIMS), path)
    return rounded(P.scale(df, io.load_params(spark, path)))


@query("a06_write_results", f"WITH RECURSIVE {_TIDY} SELECT model, scenario, metric, {R('value', 4)} AS value FROM td")
def a06(spark, d):
    path = _folder(spark)
    io.write_results(tidy(scores(spark, d), ["rmse", "r2"]), path)
    return rounded(io.read_results(spark, path, "model string, scenario string, metric string, value double"), 4)
