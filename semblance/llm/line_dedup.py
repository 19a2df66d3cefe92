"""Line dedup: overlapping three-line windows, repeated ones found over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import index_range, let, packed, same_key

WINDOW = 3


def line_windows(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, pos, h1, h2): each run of ``window`` lines that has a word, as a 128-bit hash."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def hashed(ls, i):
        run = [ls[i + k] for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit(7), *run).alias("h2"), F.concat(*run).rlike(r"[^\x20\x09-\x0D]").alias("worded"))

    windows = let(lines, lambda ls: F.transform(index_range(F.size(ls) - (window - 1)), lambda i: hashed(ls, i)))
    return base.select("id", "th", F.inline(windows)).where("worded").drop("worded")


def covered_lines(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, covered): sorted positions of the lines that later occurrences of windows cover.

    Occurrences are ordered by id (null last), text hash and position; the first of each window
    stays. The hot windows are counted before the shuffle, and the join back is a plain one whose
    large partitions Spark splits. Positions are gathered per document only.
    """
    wins = line_windows(base, window)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "pos")
    firsts = wins.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = wins.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))
    spread = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(window)])))
    return starts.select("id", "th", F.array_sort(F.array_distinct(spread)).alias("covered"))


def line_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``row`` (its columns), ``clean_text``, ``n_lines``, ``covered`` (removed positions).

    Lines end at \\n and are compared exactly. A window occurs later if an equal one stands at a
    smaller (id, text hash, position); all its lines go, overlapping ones once. By that order every
    line that goes still stands somewhere in the corpus. Windows without a word are ignored. Texts
    of fewer than ``window`` lines have no window and stay; null and empty texts have one empty
    line, and null stays null. Rows equal in id and text are one document told twice: they keep the
    same lines. Null ids come last in the order. An empty table gives an empty one.
    """
    base = packed(docs, ident, text)
    gone = covered_lines(base, window)
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    rest = let(lines, lambda ls: F.array_join(F.transform(F.array_except(index_range(F.size(ls)), F.col("covered")), lambda i: ls[i]), "\n"))
    return base.join(gone, same_key(base, gone), "left").select(
        "row", F.when(F.col("covered").isNull(), F.col("text")).otherwise(rest).alias("clean_text"),
        F.size(lines).alias("n_lines"), F.coalesce("covered", F.array().cast("array<int>")).alias("covered"),
    )
