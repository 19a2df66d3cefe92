"""Shuffle files are dropped once what was made of them is written or read."""

import os
import time

from pyspark.sql import functions as F

from semblance.operators import utility as U
from semblance.operators.frames import RELEASE, cut_lineage, drop_checkpoint


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {x for x in names if x.startswith("shuffle") and x.endswith(".data")}


def _left(spark, before):
    """New shuffle files, once the removal that runs beside the driver is through."""
    for _ in range(50):
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_checkpoint_leaves_no_shuffle_files(spark):
    before, was = _shuffled(spark), spark.conf.get(RELEASE, None)
    df = cut_lineage(spark.range(10_000).repartition(5).groupBy((F.col("id") % 1_000).alias("g")).count().repartition(3, "g"))
    assert not _left(spark, before) and spark.conf.get(RELEASE, None) == was
    assert df.count() == 1_000 and df.agg(F.sum("count")).first()[0] == 10_000


def test_runs_lie_on_disk_one_at_a_time(spark):
    rows = spark.range(4_000).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 2.0 + F.col("id") % 3).alias("y"))
    before, seen = _shuffled(spark), []

    def make(seed):
        seen.append(_left(spark, before))
        return rows.select((F.col("x") + F.lit(float(seed % 5))).alias("x"), "y").repartition(6)

    out = U.multi_seed_linear(make, rows, U.LinearSpec(("x",)), "y", n_runs=3).collect()
    assert seen == [set()] * 3 and not _left(spark, before)
    assert [r["run"] for r in out] == [0, 1, 2] and out[0]["r2"] > 0.9


def test_dropped_checkpoint_leaves_no_files_and_others_stay(spark):
    def files(df):
        return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")

    first = cut_lineage(spark.range(100))
    second = cut_lineage(first.where("id < 50"))
    assert os.path.isdir(files(first))
    drop_checkpoint(first)
    drop_checkpoint(second.where("id < 10"))  # not itself a checkpoint
    assert not os.path.exists(files(first)) and os.path.isdir(files(second)) and second.count() == 50
