"""Words, row keys and intermediate tables shared by the text operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain lower() does it faster where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs without the six ASCII spaces; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def index_range(n: Column) -> Column:
    """0 .. n-1, empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def packed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``row`` (all columns, so that no name can clash), ``id``, ``th`` (text hash) and ``text``.

    (id, th) is the key of a row: rows equal in both are the same document told twice and get
    the same result. Null ids and texts are values like others; join them with ``same_key``.
    """
    return docs.select(F.struct("*").alias("row"), F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        named = tempfile.mkdtemp(prefix="semblance-llm-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], fields: str, text: str = "text") -> DataFrame:
    """Columns made from whole texts in Arrow batches; the other columns pass untouched.

    ``make`` runs once in each task and gives a function from a batch's texts to new columns.
    """
    kept = [c for c in df.columns if c != text]
    # a schema object, not text: names of columns and of fields inside them may be anything
    schema = T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            new = work(b.column(b.schema.get_field_index(text)).to_pylist())
            names = kept + list(new)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept] + [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage, survives lost executors and is computed once. ``drop``
    deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/semblance-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in [p for t, p in self.tables if any(t is x for x in tables)]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
