"""Reading raw tables; writing synthetic tables, splits, prepared bundles, parameters and results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semblance.operators.layout import Layout
from semblance.operators.prepare import Params

# Readable suffixes.
SUFFIXES = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Table from a delimited file with header, parquet, ORC or JSON lines; the format follows the suffix.

    Give a schema for large text files: inferring types reads them twice.
    """
    suffix = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file format: {suffix}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if SUFFIXES[suffix] == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, sep="\t" if suffix == "tsv" else ",")
    return reader.format(SUFFIXES[suffix]).load(path)


def write_synthetic(df: DataFrame, path: str, fmt: str = "csv", target: str | None = None, rename: str = "target", mode: str = "errorifexists") -> None:
    """Feature columns first, then the target under its published name; header, no row number."""
    out = df if target is None else df.select(*[c for c in df.columns if c != target], F.col(target).alias(rename))
    writer = out.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def _write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON record through Spark's writer, so it lands on the same storage as the data."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def export_split(
    train: DataFrame, test: DataFrame, path: str, name: str, features: Sequence[str], target: str, task: str = "regression", seed: int = 42
) -> dict:
    """Write train and test and a metadata record; returns the record."""
    spark = train.sparkSession
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")
    n_train, n_test = (spark.read.parquet(f"{path}/{s}").count() for s in ("train", "test"))
    record = {
        "name": name, "task": task, "n_samples": n_train + n_test, "n_features": len(features), "feature_names": list(features),
        "target": target, "train_size": n_train, "test_size": n_test, "seed": seed,
    }
    if task == "classification":
        record["n_classes"] = spark.read.parquet(f"{path}/train").select(target).distinct().count()
    _write_record(spark, record, f"{path}/metadata")
    return record


def read_metadata(spark: SparkSession, path: str) -> dict:
    return _read_record(spark, f"{path}/metadata")


def save_prepared(df: DataFrame, layout: Layout, dictionary: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Prepared rows, the category dictionary and the named layout."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/rows")
    dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    _write_record(df.sparkSession, json.loads(layout.to_json()), f"{path}/layout")


def load_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, Layout, DataFrame]:
    layout = Layout.from_json(json.dumps(_read_record(spark, f"{path}/layout")))
    return spark.read.parquet(f"{path}/rows"), layout, spark.read.parquet(f"{path}/dictionary")


def save_params(spark: SparkSession, params: Params, path: str) -> None:
    """Fitted parameters as a small parquet table (never pickled)."""
    params.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> Params:
    return Params.from_frame(spark.read.parquet(path))


def write_results(df: DataFrame, path: str) -> None:
    """Tidy result rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return read_table(spark, path, "json", schema)
