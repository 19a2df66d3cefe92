"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import LOWER, UPPER, Scratch

WORDS = 8
BITS_PER_URL = 16
BROADCAST_FILTER_BYTES = 64 << 20
BLOCK_BYTES = 8 * WORDS + 8

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www. and port, path without its last slash, query without tracking fields, no fragment."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":[0-9]*$", "")
    path = F.regexp_replace(url_path(url), r"/$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(r"^(utm_[a-z]+|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each of the eight words of the block, from six hash bits each."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (block, w0 .. w7): bits of each block or-ed together."""
    bits = _bits(F.col("key"))
    return keys.select(_place(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_blocks(keys: int) -> int:
    return max(1, math.ceil(keys * BITS_PER_URL / (64 * WORDS)))


def probed_keys(df: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """The columns of ``df`` and ``maybe``: all eight bits of the key are set in its block."""
    hit = F.lit(True)
    for i, b in enumerate(_bits(key)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return df.withColumn("block", _place(key, blocks)).join(bloom, "block", "left").select(*df.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def possible_hits(df: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``df`` whose key may be in a filter that is small enough to broadcast."""
    return probed_keys(df, key, F.broadcast(bloom), blocks).where("maybe").drop("maybe")


def listed_keys(urls: DataFrame, listed: DataFrame, url: str = "url", broadcast_bytes: int = BROADCAST_FILTER_BYTES) -> DataFrame:
    """(key, maybe, listed) of each row of ``urls`` (columns kept in ``row``).

    ``listed`` has a column url. Each of its canonical URLs sets eight bits of one 64-byte block. The
    filter is a table of blocks: broadcast if its size, which follows from the number of listed
    URLs, is at most ``broadcast_bytes``, and joined by block otherwise. Only possible hits go on
    to the exact hash join with the listed URLs, which removes the false positives.
    """
    scratch = Scratch(urls.sparkSession)
    keys = scratch.keep(listed.select(canonical_url(F.col("url")).alias("key")).where("key != ''").distinct())
    blocks = filter_blocks(keys.count())
    bloom = bloom_blocks(keys, blocks)
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    probe = urls.select(F.struct("*").alias("row"), canonical_url(F.col(url)).alias("key"))
    probed = probed_keys(probe, F.col("key"), bloom, blocks)
    probed = scratch.keep(probed)
    exact = keys.withColumn("listed", F.lit(True))
    hits = probed.where("maybe").join(exact, "key", "left").select("row", "key", "maybe", F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.unionByName(probed.where("NOT maybe").select("row", "key", "maybe", F.lit(False).alias("listed")))


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, broadcast_bytes: int = BROADCAST_FILTER_BYTES) -> DataFrame:
    """One row per input row: row, host, path, rule, verdict, canonical, maybe_listed, listed.

    The longest rule that fits decides; without one, listed URLs are blocked and others allowed. A
    null URL or one without :// has empty host and path, fits no rule and has an empty canonical
    URL, which is never listed: allow. Equal rows get equal results; empty tables and lists do.
    Only the columns given in ``pages`` travel, so select the needed ones first.
    """
    checked = listed_keys(pages, listed, url, broadcast_bytes)
    link = F.col("row")[url]
    checked = checked.select("row", url_host(link).alias("host"), url_path(link).alias("path"), "key", "maybe", "listed")
    rule = match_rule(F.col("host"), F.col("path"), rules)
    return checked.select(
        "row", "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("key").alias("canonical"), F.col("maybe").alias("maybe_listed"), "listed",
    )
