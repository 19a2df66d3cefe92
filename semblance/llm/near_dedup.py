"""MinHash near-dedup with HyperMinHash registers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, map_texts
from semblance.llm.url_filter import BLOCK_BYTES, BROADCAST_FILTER_BYTES, bloom_blocks, filter_blocks, possible_hits

SHINGLE, THRESHOLD = 3, 0.85
BUCKET_BITS, BUCKETS, MANTISSA = 7, 128, 10
BANDS, ROWS = 25, 5
BLOCK_SHINGLES = 500_000
#: Rows without a doc_id get a node number from here on; real ids may lie there too.
NO_ID = 1 << 62
_U = np.uint64
_MIX = tuple(_U(x | 1) for x in np.random.default_rng(1).integers(1 << 62, 1 << 63, 64, dtype=np.uint64))
_PROBES = np.argsort(np.random.default_rng(2).random((BUCKETS, BUCKETS)), axis=1)


def _scramble(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> _U(31))) * _MIX[60]
    x = (x ^ (x >> _U(29))) * _MIX[61]
    return x ^ (x >> _U(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII spaces only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = h[: n - size + 1] * _MIX[0]
    for k in range(1, size):
        total = total + h[k : n - size + 1 + k] * _MIX[k]
    return np.unique(_scramble(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros and mantissa bits of each bucket's least hash.

    Empty buckets take the register of the first filled one in a fixed order of their own, so that
    registers of short texts still agree as often as their sets do.
    """
    rest_bits = 64 - BUCKET_BITS
    first = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << _U(rest_bits))
    least = hashes[np.minimum(first, len(hashes) - 1)]
    filled = (first < len(hashes)) & ((least >> _U(rest_bits)) == np.arange(BUCKETS, dtype=np.uint64))
    rest = (least & _U((1 << rest_bits) - 1)) | _U(1)
    top = np.frexp(rest.astype(np.float64))[1] - 1  # place of the leading one
    top = np.where(rest >> top.astype(np.uint64) == 0, top - 1, top).astype(np.uint64)
    zeros = _U(rest_bits - 1) - top
    mantissa = np.where(top >= MANTISSA, rest >> np.maximum(top, _U(MANTISSA)) - _U(MANTISSA), rest << _U(MANTISSA) - np.minimum(top, _U(MANTISSA))) & _U((1 << MANTISSA) - 1)
    regs = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    if not filled.all():
        donors = np.take_along_axis(_PROBES, np.argmax(filled[_PROBES], axis=1)[:, None], axis=1)[:, 0]
        regs = np.where(filled, regs, regs[donors])
    return regs


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[50]
    for k in range(ROWS):
        keys = _scramble(keys ^ (rows[:, k] * _MIX[k]))
    return keys.view(np.int64)


def estimated_jaccard(equal: np.ndarray) -> np.ndarray:
    """From the share of equal registers, without what equal leading zeros and mantissas agree on by chance."""
    chance = 0.169919 * 2.0 ** (1 - MANTISSA)
    return np.maximum(equal - chance, 0) / (1 - chance)


def least_estimate(threshold: float, n: np.ndarray) -> np.ndarray:
    """Six standard deviations below the threshold for registers filled by n shingles."""
    filled = BUCKETS * (1 - np.exp(-n / BUCKETS))
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))


def sketches(base: DataFrame, size: int) -> DataFrame:
    """(id, n, f1, f2, regs, bands) from (id, text); f1, f2: 128-bit digest of the set."""
    def make():
        def work(texts):
            n, f1, f2, regs, bands = [], [], [], [], []
            for t in texts:
                s = shingle_set(t, size)
                a, b = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s)), f1.append(int(a)), f2.append(int(b))
                r = registers(s) if len(s) else None
                regs.append(None if r is None else r.tobytes()), bands.append(None if r is None else band_keys(r))
            return {"n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "regs": pa.array(regs, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))}

        return work

    return map_texts(base, make, "n long, f1 long, f2 long, regs binary, bands array<long>")


def likely(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose registers do not rule the threshold out."""
    a = heads.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    b = heads.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    joined = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ra, rb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                est = estimated_jaccard((ra == rb).mean(axis=1))
                yield pdf.loc[est >= least_estimate(threshold, np.minimum(pdf["na"], pdf["nb"]).to_numpy()), ["a", "b"]]

    return joined.mapInPandas(estimate, "a long, b long")


def texts_of(base: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of the documents in ``ids``, written once.

    A Bloom filter of the ids, broadcast as long as its size allows, keeps most other texts out of
    the shuffle; the exact semi-join decides.
    """
    ids = scratch.keep(ids)
    blocks = filter_blocks(ids.count())
    if blocks * BLOCK_BYTES <= BROADCAST_FILTER_BYTES:
        base = possible_hits(base, F.col("id"), bloom_blocks(ids.select(F.col("id").alias("key")), blocks), blocks)
    return scratch.keep(base.join(ids, "id", "left_semi"))


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.empty(0, np.uint64)  # pairs come sorted by a: its set is used again
        for pdf in batches:
            good = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if last is None or last[0] != a or last[1] != ta:
                    last, held = (a, ta), shingle_set(ta, size)
                other = shingle_set(tb, size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(held) + len(other) - both))
            yield pdf.loc[good, ["a", "b"]]

    return scratch.keep(joined.mapInPandas(verify, "a long, b long").distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the least node reachable, for the nodes of ``edges`` (a, b).

    Rounds of least label among the neighbours, then the label of the label, until nothing
    changes. Counts and minima are combined before the shuffles; large partitions of the plain
    joins are split by Spark, also for a hub with a third of the edges.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    changed = True
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = scratch.keep(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = scratch.keep(step.join(jump, "comp").select("node", F.col("next").alias("comp"), (F.col("old") != F.col("next")).alias("moved")))
        changed = not new.where("moved").isEmpty()
        scratch.drop(step, labels)
        labels = new
    scratch.drop(both)
    return labels.select("node", "comp")


class Block:
    """The shingle sets of some documents, from shingle to documents."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.nodes, self.comps = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.sizes = np.array([len(r[2]) for r in rows], np.int64)
        keys = np.concatenate([r[2] for r in rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.repeat(np.arange(len(rows)), self.sizes)[order]

    def links(self, comp: int, shingles: np.ndarray, percent: int) -> list[int]:
        """Nodes of other components that the percentage links with these shingles."""
        low, high = np.searchsorted(self.keys, shingles, "left"), np.searchsorted(self.keys, shingles, "right")
        runs = high - low
        at = np.arange(runs.sum()) + np.repeat(low - np.cumsum(runs) + runs, runs)
        both = np.bincount(self.owners[at], minlength=len(self.nodes))
        fit = (self.comps != comp) & (both > 0) & (100 * both >= percent * (self.sizes + len(shingles) - both))
        return self.nodes[fit].tolist()


def block_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components in the same bucket, from members (key, node, comp, n).

    The members of a bucket are dealt to blocks of about ``BLOCK_SHINGLES`` shingles. All members
    outside the bucket's largest component visit every block, so each two components meet, while
    the members of the largest one are compared with the others only. A task holds the sets of one
    block and lets the visitors stream past; only links leave it, on full sets.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("mass"))
    main = sizes.groupBy("key").agg(F.max_by("comp", "m").alias("main"), F.ceil(F.sum("mass") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = members.join(main, "key").select("key", "node", "comp", "blocks", (F.col("comp") != F.col("main")).alias("visits"))
    dealt = dealt.join(texts.withColumnRenamed("id", "node"), "node")
    own = dealt.select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "node", "comp", "text")
    visit = dealt.where("visits").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node", "comp", "text")
    ordered = own.unionByName(visit).repartition("key", "block").sortWithinPartitions("key", "block", "role")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, rows, block = None, [], None
        for pdf in batches:
            out = []
            for key, part, role, node, comp, text in zip(*(pdf[c] for c in ("key", "block", "role", "node", "comp", "text")), strict=True):
                if here != (key, part):
                    here, rows, block = (key, part), [], None
                shingles = shingle_set(text, size)
                if role == 0:
                    rows.append((node, comp, shingles))
                elif rows:
                    block = block or Block(rows)
                    out += [(min(x, node), max(x, node)) for x in block.links(comp, shingles, percent)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return ordered.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 85) -> DataFrame:
    """One row per input row: id, th, n_shingles, component_id, kept.

    Texts are linked if their sets of word shingles have 100 * intersection >= percent * union;
    component_id is the least id that links reach. Equal sets are one class, found by a 128-bit
    digest and represented by its least id. HyperMinHash registers of a class are banded; every
    member of a bucket is first compared with the bucket's least member: an estimate from the registers,
    corrected for chance, drops pairs six deviations below the threshold, and the full sets decide
    on the others. In buckets that still hold several components, members of different ones are
    compared on full sets, block by block. No pair inside a component is made, no bucket is cut, and
    only links leave the blocks.

    25 bands of 5 registers miss a pair at the threshold of 0.85 (0.8) with a chance of 1e-6 (1e-4),
    and less above. Null and empty texts have an empty set and stand alone. A row without id gets a
    node number from its text; its component_id is null if it reaches no real id, and rows that
    share a text and have no id are one node. Rows that share an id and a text are one document;
    where texts of one id differ, each row has the component of its own text. Kept: the row has the least
    id of its component, or is the first node of a component without ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    threshold = percent / 100
    made_up = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2)
    base = docs.select(F.coalesce(F.col(ident).cast("long"), made_up).alias("id"), F.col(ident).alias("given"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    sketched = scratch.keep(sketches(base, size))
    whole = sketched.where("n > 0")
    classes = whole.groupBy("f1", "f2").agg(F.min("id").alias("node"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    member = sketched.join(classes, ["f1", "f2"], "left").select("given", "id", "th", "n", F.when(F.col("n") > 0, F.coalesce("node", "id")).otherwise(F.col("id")).alias("node"), "regs", "bands")
    rows = scratch.keep(member.select("given", "id", "th", "n", "node"))
    heads = scratch.keep(member.where("n > 0 AND id = node").select("node", "n", "regs", "bands"))
    scratch.drop(sketched)

    bands = heads.select("node", F.explode("bands").alias("key"))
    pivots = scratch.keep(bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("far"), F.count("*").alias("n_key")).where("a < far").drop("far"))
    star = bands.join(pivots, "key").where("node > a").select("a", F.col("node").alias("b")).distinct()
    star = scratch.keep(star)
    texts = texts_of(base.select("id", "text"), star.select(F.explode(F.array("a", "b")).alias("id")).distinct(), scratch)
    links = linked(scratch.keep(likely(star, heads, threshold)), texts, size, percent, scratch)
    labels = components(links, scratch)

    named = F.coalesce("comp", "node")
    crowded = bands.join(pivots.where("n_key > 2").select("key"), "key").join(heads.select("node", "n"), "node")
    crowded = scratch.keep(crowded.join(labels, "node", "left").select("key", "node", "n", named.alias("comp")))
    mixed = crowded.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    found = scratch.keep(block_links(crowded.join(mixed, "key", "left_semi"), texts, size, percent))
    if not found.isEmpty():
        labels = components(links.unionByName(found), scratch)
    done = rows.join(labels, "node", "left").select("given", "id", "th", F.col("n").alias("n_shingles"), named.alias("comp"))
    # the least node is the least id, unless nodes without id may be smaller than real ids
    plain = done.where(F.col("comp") < NO_ID).withColumn("component_id", F.col("comp"))
    high = done.where(F.col("comp") >= NO_ID)
    least = high.where("given IS NOT NULL").groupBy("comp").agg(F.min(F.col("given").cast("long")).alias("component_id"))
    every = plain.unionByName(high.join(least, "comp", "left").select(plain.columns))
    kept = F.when(F.col("component_id").isNotNull(), F.col("given").cast("long").eqNullSafe(F.col("component_id"))).otherwise(F.col("id") == F.col("comp"))
    return every.select(F.col("given").alias("id"), "th", "n_shingles", "component_id", kept.alias("kept"))
