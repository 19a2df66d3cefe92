"""Benchmark decontamination by templates with typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, index_range, let, packed, words

WINDOW = 8
SHARE = 0.5
#: So many tokens on end are a leak, whatever the length of the item.
RUN = 30
BROADCAST_WINDOWS = 500_000

# Units after numbers.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|mile|miles|ft|feet|inch|inches|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|l|ml|litres|liters|gallons|usd|eur|dollars|euros|cents|percent|mph|kmh|degrees"


def marked_text(text: Column) -> Column:
    """The text with numbers as #1, names as @Name and units as &kg, and no other marks but spaces.

    Numbers are runs of digits with points or commas. Names are capitalised words after a lower-case
    word, a number or a comma, so first words of sentences are none. Units stand after numbers.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,]+", "")
    numbers = F.regexp_replace(plain, r"(?<![\p{L}\p{N}.,])(?=\p{N})[\p{N}.,]+(?![\p{L}\p{N}])", "#$0")
    names = F.regexp_replace(numbers, r"(?<=[\p{Ll}\p{N},][\x20\x09-\x0D])(?=\p{Lu})\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "@$0")
    units = F.regexp_replace(names, rf"(?i)(#[\p{{N}}.,]+[\x20\x09-\x0D]+)({UNITS})(?![\p{{L}}\p{{N}}])", "$1&$2")
    return F.lower(F.replace(F.replace(units, F.lit("."), F.lit("")), F.lit(","), F.lit("")))


def numbers_typed(marked: Column) -> Column:
    """Typed placeholders for numbers and units of a marked text; names, which begin their words, keep their marks."""
    return F.regexp_replace(marked, r"([#&])[^\x20\x09-\x0D]+", "$1")


def canonical(typed: Column) -> Column:
    """Placeholders for the names too."""
    return F.regexp_replace(typed, r"@[^\x20\x09-\x0D]+", "@")


def with_names(typed: Column) -> Column:
    """As ``canonical``, but with names as plain words, so that case does not matter."""
    return F.replace(typed, F.lit("@"), F.lit(""))


def plain(marked: Column) -> Column:
    """Without marks: what the text says."""
    return F.translate(marked, "#@&", "")


def hashed(tokens: Column, window: int) -> Column:
    """(pos, h) of each window of ``window`` tokens."""
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda t: F.transform(index_range(F.size(t) - (window - 1)), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[t[i + k] for k in range(window)]).alias("h"))))


def template_windows(df: DataFrame, keep: list[str], window: int) -> DataFrame:
    """(keep, pos, h): hashes of ``window`` canonical tokens, one row each; windows with names once more with these as words."""
    both = let(numbers_typed(F.col("marked")), lambda t: F.struct(hashed(words(canonical(t)), window).alias("slots"), hashed(words(with_names(t)), window).alias("names")))
    wins = let(both, lambda w: F.concat(w["slots"], F.filter(w["names"], lambda x, i: x["h"] != w["slots"][i]["h"])))
    return df.select(*keep, F.inline(wins))


def short_leaks(base: DataFrame, items: DataFrame, window: int, few: bool) -> DataFrame | None:
    """(id, th, item, n) for items of fewer than ``window`` tokens: all of them in a row, slot values too."""
    mine = items.select("item", words(plain(F.col("marked"))).alias("t")).select("item", F.size("t").alias("n"), F.xxhash64("t").alias("h")).where(F.col("n").between(1, window - 1))
    sizes = sorted(r["n"] for r in mine.select("n").distinct().collect())  # fewer than ``window`` numbers
    if not sizes:
        return None

    def told(n: int) -> Column:
        return F.array_distinct(F.transform(index_range(F.size("t") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("t", i + 1, n)).alias("h"))))

    wins = base.select("id", "th", words(plain(marked_text(F.col("text")))).alias("t")).select("id", "th", F.inline(F.concat(*map(told, sizes))))
    return wins.join(F.broadcast(mine) if few else mine, ["n", "h"]).select("id", "th", "item", "n").distinct()


def runs(pairs: Column) -> Column:
    """Arrays of pairs whose positions follow each other; ``pairs`` are in order of ``p``."""
    return let(pairs, lambda x: F.transform(F.array_distinct(F.transform(x, lambda q, i: q["p"] - i)), lambda d: F.filter(x, lambda q, i: q["p"] - i == d)))


def slots(pairs: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(pairs, lambda q: q["slot"]), lambda q: F.struct(q["item"].alias("item"), q["doc"].alias("doc"))))


def consistent(pairs: Column) -> Column:
    """Each slot value of the item stands for one value in the document."""
    return let(slots(pairs), lambda s: F.size(F.array_distinct(F.transform(s, lambda q: q["item"]))) == F.size(s))


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(id, th, item, share, n_windows, same_slots): documents that hold a benchmark item, once per item.

    Windows of ``window`` canonical tokens of documents and items are joined by hash; windows with
    names also with these as lower-case words, which finds copies in other case. Matches of one
    document and item are split by the distance of their positions (an alignment); an alignment
    counts if each slot value of the item stands for one value in the document wherever it occurs.
    An item leaks if consistent alignments cover ``share`` of its tokens or more, or if an alignment
    holds ``run`` tokens on end that are consistent or verbatim (alignments inconsistent as a whole
    included). same_slots: all slot values are those of the item. Items of fewer tokens than
    ``window`` leak where all their tokens stand in a row, slot values included. Null and empty
    texts never match. Rows equal in id and text give one row per item; null ids and items are
    values like others.

    The windows of the benchmark are broadcast if counted to be few; the matches are grouped by
    document, so a passage in a third of all documents is spread as they are.
    """
    scratch = Scratch(docs.sparkSession)
    base = packed(docs, ident, text)
    items = scratch.keep(benchmark.select(F.col(item).alias("item"), marked_text(F.col(item_text)).alias("marked")))
    items = items.select(F.xxhash64("item", "marked").alias("ikey"), "item", "marked").dropDuplicates(["ikey"])
    theirs = scratch.keep(template_windows(items, ["ikey"], window).withColumnRenamed("pos", "item_pos"))
    few = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    mine = template_windows(base.select("id", "th", marked_text(F.col("text")).alias("marked")), ["id", "th"], window)
    matched = mine.join(F.broadcast(theirs) if few else theirs, "h")
    aligned = matched.groupBy("id", "th", "ikey", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("starts"))
    aligned = scratch.keep(aligned)
    by_doc = aligned.groupBy("id", "th").agg(F.collect_list(F.struct("ikey", "shift", "starts")).alias("found"))
    mine = base.join(by_doc.select(F.col("id").alias("fid"), F.col("th").alias("fth"), "found"), F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")))
    texts = mine.select("id", "th", words(marked_text(F.col("text"))).alias("tokens"), "found").dropDuplicates(["id", "th"])
    wide = texts.select("id", "th", "tokens", F.inline("found"))
    their_tokens = items.select("ikey", "item", words(F.col("marked")).alias("item_tokens"))
    wide = wide.join(F.broadcast(their_tokens) if few else their_tokens, "ikey")

    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(window)])))))
    wide = wide.select("id", "th", "ikey", "item", "item_tokens", "tokens", "shift", covered.alias("covered"))
    token = F.transform("covered", lambda p: F.struct(p.alias("p"), F.col("item_tokens")[p].alias("mine"), F.col("tokens")[p + F.col("shift")].alias("theirs")))
    pairs = F.transform(token, lambda q: F.struct(q["p"].alias("p"), plain(q["mine"]).alias("item"), plain(q["theirs"]).alias("doc"), q["mine"].rlike("^[#@&]").alias("slot")))
    judged = wide.select("id", "th", "ikey", "item", F.size("item_tokens").alias("n"), pairs.alias("pairs"))
    judged = judged.withColumn("whole", consistent(F.col("pairs")))
    verbatim = F.filter("pairs", lambda q: q["item"] == q["doc"])
    long = F.filter(F.concat(F.filter(runs(F.col("pairs")), consistent), runs(verbatim)), lambda r: F.size(r) >= run)
    none = F.filter(F.array(F.col("pairs")), lambda _: F.lit(False))
    judged = judged.withColumn("long", F.when(F.size("pairs") >= run, long).otherwise(none))
    judged = judged.select("id", "th", "ikey", "item", "n", (F.size("long") > 0).alias("is_long"), F.when(F.col("whole"), F.col("pairs")).otherwise(F.flatten("long")).alias("pairs")).where(F.size("pairs") > 0)
    same = F.forall("pairs", lambda q: ~q["slot"] | (q["item"] == q["doc"]))
    judged = judged.select("id", "th", "ikey", "item", "n", "is_long", F.transform("pairs", lambda q: q["p"]).alias("covered"), same.alias("same"))
    good = judged.groupBy("id", "th", "ikey", "item", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered_tokens"), F.bool_or("is_long").alias("is_long"), F.bool_and("same").alias("same_slots"))
    found = good.select("id", "th", "item", (F.col("covered_tokens") / F.col("n")).alias("share"), "covered_tokens", "same_slots", "is_long").where((F.col("share") >= share) | F.col("is_long")).drop("is_long")
    short = short_leaks(base, items, window, few)
    if short is not None:
        found = found.unionByName(short.select("id", "th", "item", F.lit(1.0).alias("share"), F.col("n").alias("covered_tokens"), F.lit(True).alias("same_slots")))
    return found.groupBy("id", "th", "item").agg(F.max("share").alias("share"), F.max("covered_tokens").alias("covered_tokens"), F.bool_or("same_slots").alias("same_slots"))
