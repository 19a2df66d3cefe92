"""Interpolating oversamplers: SMOTE for classes, SMOGN for a numeric target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.rand import draw_index, normal, uniform
from semblance.operators.cells import below_half_median
from semblance.operators.frames import cut_lineage, lookup
from semblance.operators.neighbors import knn_join
from semblance.operators.prepare import fit_standard, scale
from semblance.operators.ranks import exact_quantiles, hash_cut, number_groups

# Neighbours, relevance threshold and perturbation of the published methods.
NEIGHBORS = 5
RELEVANCE = 0.5
PERTURBATION = 0.02
BOX_WHISKER = 1.5


def class_targets(sizes: dict, strategy: dict | None = None) -> dict:
    """How many new rows each class needs: up to the largest class, or to the given total sizes."""
    top = max(sizes.values())
    want = {c: top for c in sizes} if strategy is None else strategy
    return {c: want[c] - n for c, n in sorted(sizes.items()) if want.get(c, n) > n}


def fallback_strategy(sizes: dict, n_synthetic: int) -> dict:
    """Total class sizes that spread ``n_synthetic`` rows: a third of them plus a third of the originals per class."""
    third = n_synthetic // 3 + sum(sizes.values()) // 3
    return {c: max(n, third) for c, n in sizes.items()}


def _piecewise(i: Column, needs: dict, value: dict) -> Column:
    """Value of the class that draw number i belongs to (classes in order)."""
    out, run = None, 0
    for c, n in needs.items():
        run += n
        v = F.lit(value[c])
        out = F.when(i < run, v) if out is None else out.when(i < run, v)
    return out


def _pairs(df: DataFrame, key: Column, cols: Sequence[str], extra: Sequence[str], group: str, k: int, seed: int | str, near_cols: Sequence[str]) -> DataFrame:
    """(group, idx, rank, a, b, distance): every row of each group beside each of its k nearest rows.

    ``a`` and ``b`` are structs of ``cols`` and ``extra``; idx numbers rows inside the group.
    """
    body = F.struct(*[F.col(c) for c in [*cols, *extra]])
    numbered, _ = number_groups(df.withColumn("_id", key.cast("string")).withColumn("_body", body), seed, F.col("_id"), group)
    base = cut_lineage(numbered.select(
        F.col(group).alias("_g"), "idx", "_id", "_body", F.array(*[F.col(c).cast("double") for c in near_cols]).alias("_vec")))
    vecs = base.select("_g", F.col("_id").alias("qid"), F.col("_vec").alias("vec"))
    near = cut_lineage(knn_join(vecs, vecs.withColumnRenamed("qid", "pid"), k, by="_g", exclude_self=True))
    left = base.select("_g", "idx", F.col("_id").alias("qid"), F.col("_body").alias("a"))
    right = base.select("_g", F.col("_id").alias("pid"), F.col("_body").alias("b"))
    # a qid has k rows; a pid can be the neighbour of very many rows (all copies share theirs), so its hot keys are split off
    out = lookup(near, right, ["_g", "pid"], how="inner").join(left, ["_g", "qid"])
    return cut_lineage(out.select("_g", "idx", "rank", "a", "b", "distance"))


def smote(
    df: DataFrame, key: Column, cols: Sequence[str], label: str, k: int = NEIGHBORS, strategy: dict | None = None, cats: Sequence[str] = (),
    codes_as_numbers: bool = False, seed: int = 42,
) -> DataFrame:
    """New rows for every class below its wanted size: x + u (neighbour - x) with u uniform.

    Returns the new rows only (``i``, label, columns, and ``u``); augment the real table with them.
    Categories take the most frequent value among the base row's neighbours, or are interpolated
    as codes with ``codes_as_numbers``. Rows with a null label belong to no class.
    """
    df = df.where(F.col(label).isNotNull())
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    needs = class_targets(sizes, strategy)
    numeric = [*cols, *(cats if codes_as_numbers else [])]
    votes = [] if codes_as_numbers else list(cats)
    spark = df.sparkSession
    if not needs:
        return df.select(F.lit(0).cast("bigint").alias("i"), label, *numeric, *votes, F.lit(0.0).alias("u")).limit(0)
    k_eff = min(k, min(sizes[c] for c in needs) - 1)
    if k_eff < 1:
        raise ValueError("a class to be oversampled has one row only: it has no neighbour of its own class")
    small = df.where(F.col(label).isin(*needs))
    pairs = _pairs(small, key, numeric, votes, label, k_eff, seed, cols)
    if votes:
        tall = pairs.select("_g", "idx", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col("b")[c].cast("string").alias("v")) for c in votes])))
        counted = tall.groupBy("_g", "idx", "c", "v").agg(F.count("*").alias("n"))
        best = counted.groupBy("_g", "idx", "c").agg(F.min(F.struct((-F.col("n")).alias("m"), "v"))["v"].alias("v"))
        wide = best.groupBy("_g", "idx").pivot("c", votes).agg(F.first("v"))
        pairs = pairs.join(wide, ["_g", "idx"])
    i = F.col("i")
    drawn = spark.range(sum(needs.values())).select(F.col("id").alias("i")).select(
        "i", _piecewise(i, needs, {c: c for c in needs}).alias("_g"),
        draw_index(f"{seed}/base", i, _piecewise(i, needs, sizes)).alias("idx"),
        (draw_index(f"{seed}/pick", i, k_eff) + 1).cast("int").alias("rank"), uniform(f"{seed}/gap", i).alias("u"),
    )
    rows = lookup(drawn, pairs, ["_g", "idx", "rank"], how="inner")
    moved = [(F.col("a")[c] + F.col("u") * (F.col("b")[c] - F.col("a")[c])).alias(c) for c in numeric]
    return rows.select("i", F.col("_g").alias(label), *moved, *votes, "u")


# ---- SMOGN -----------------------------------------------------------------------------


def box_points(df: DataFrame, target: str) -> dict:
    """Median, whisker ends and range of the target (whiskers at 1.5 interquartile ranges)."""
    q1, med, q3 = exact_quantiles(df, [target], [0.25, 0.5, 0.75])[target]
    lo, hi = q1 - BOX_WHISKER * (q3 - q1), q3 + BOX_WHISKER * (q3 - q1)
    y = F.col(target)
    row = df.agg(F.min(F.when(y >= lo, y)).alias("low"), F.max(F.when(y <= hi, y)).alias("high"), F.min(y).alias("min"), F.max(y).alias("max")).first()
    return {"median": med, "low": row["low"], "high": row["high"], "min": row["min"], "max": row["max"]}


def relevance(y: Column, box: dict) -> Column:
    """0 at the median, 1 at and beyond a whisker that has outliers, cubic with flat ends between.

    A side without outliers has relevance 0.
    """
    def ramp(a: float, b: float) -> Column:
        h = F.greatest(F.least((y - F.lit(a)) / F.lit((b - a) or 1.0), F.lit(1.0)), F.lit(0.0))
        return h * h * (3.0 - 2.0 * h)

    low = ramp(box["median"], box["low"]) if box["min"] < box["low"] else F.lit(0.0)
    high = ramp(box["median"], box["high"]) if box["max"] > box["high"] else F.lit(0.0)
    return F.when(y < box["median"], low).otherwise(high)


def region_of(y: Column, box: dict, threshold: float = RELEVANCE) -> Column:
    rare = relevance(y, box) >= threshold
    return F.when(rare & (y < box["median"]), "low").when(rare, "high").otherwise("common")


def region_plan(sizes: dict[str, int], method: str = "extreme") -> dict[str, float]:
    """Size factor per region: above 1 grows it, below 1 shrinks it.

    ``balance`` aims at equal regions, ``extreme`` at sizes inverse to the present ones with the
    total kept.
    """
    n, bumps = sum(sizes.values()), len(sizes)
    b = n / bumps
    if method == "balance":
        return {r: round(b / s, 1) for r, s in sizes.items()}
    if method != "extreme":
        raise ValueError("method is 'extreme' or 'balance'")
    scale_by = bumps * b / sum(b * b / s for s in sizes.values())
    return {r: round(b * b / s * scale_by / s, 1) for r, s in sizes.items()}


def smogn_regions(df: DataFrame, target: str, method: str = "extreme", threshold: float = RELEVANCE) -> DataFrame:
    """Region, size, factor and resulting number of kept and new rows."""
    box = box_points(df, target)
    sizes = {r["region"]: r["n"] for r in df.groupBy(region_of(F.col(target), box, threshold).alias("region")).agg(F.count("*").alias("n")).collect()}
    plan = region_plan(sizes, method)
    rows = [(r, s, float(plan[r]), *_kept_new(s, plan[r])) for r, s in sorted(sizes.items())]
    return df.sparkSession.createDataFrame(rows, "region string, n bigint, factor double, kept bigint, added bigint")


def _kept_new(size: int, factor: float) -> tuple[int, int]:
    if factor >= 1:
        return size, int(round((factor - 1) * size))
    return -int(-round(factor * size, 9) // 1), 0


def _near_cases(cases: DataFrame, points: DataFrame) -> DataFrame:
    """(vec, distance, _near) for distinct cases of one region."""
    named = cut_lineage(cases.select("vec", "distance", F.monotonically_increasing_id().alias("bid")))
    near = below_half_median(named.select("bid", "vec", "distance"), points)
    return named.join(near, "bid").select("vec", "distance", F.col("near").alias("_near"))


def smogn(
    df: DataFrame, key: Column, cols: Sequence[str], target: str, cats: Sequence[str] = (), k: int = NEIGHBORS, method: str = "extreme",
    threshold: float = RELEVANCE, perturbation: float = PERTURBATION, seed: int = 42,
) -> DataFrame:
    """Rebalanced table: rare target regions grow, the common one shrinks; it replaces the training set.

    A new row lies between a case and one of its k neighbours (by standardised features, in the same
    region) when that neighbour is within the case's safe distance, else it is the case with Gaussian
    jitter. The safe distance is half the median of the case's distances to its whole region, itself
    included; whether a neighbour is nearer follows from counts inside balls, not from all pairs.
    ``origin`` tells kept, interpolated and jittered rows apart.
    """
    box = box_points(df, target)
    if box["min"] >= box["low"] and box["max"] <= box["high"]:
        raise ValueError("the target has no outliers: every relevance is 0")
    tagged = cut_lineage(df.withColumn("region", region_of(F.col(target), box, threshold)).withColumn("_key", key.cast("string")))
    sizes = {r["region"]: r["n"] for r in tagged.groupBy("region").agg(F.count("*").alias("n")).collect()}
    plan = region_plan(sizes, method)
    parts = []
    for r, s in sorted(sizes.items()):
        part = tagged.where(F.col("region") == r)
        if plan[r] < 1:
            part = hash_cut(part, f"{seed}/keep", F.col("_key"), plan[r], flag="_keep").where("_keep").drop("_keep")
        parts.append(part.select("region", *cols, target, *cats, F.lit("kept").alias("origin")))
    needs = {r: _kept_new(s, plan[r])[1] for r, s in sorted(sizes.items()) if plan[r] > 1 and s > 1}
    needs = {r: n for r, n in needs.items() if n > 0}
    if needs:
        grown = tagged.where(F.col("region").isin(*needs))
        z = {c: f"_z_{c}" for c in cols}
        standard = scale(grown.withColumns({v: F.col(c) for c, v in z.items()}), fit_standard(df.withColumns({v: F.col(c) for c, v in z.items()}), list(z.values())))
        placed = cut_lineage(standard)
        k_eff = min(k, min(sizes[r] for r in needs) - 1)
        pairs = _pairs(placed, F.col("_key"), [*cols, target, *z.values()], cats, "region", k_eff, f"{seed}/smogn", list(z.values()))
        sd_cols = [*cols, target]
        sd = {r: {c: p[1] for c, p in fit_standard(placed.where(F.col("region") == r), sd_cols).values.items()} for r in needs}
        i = F.col("i")
        drawn = df.sparkSession.range(sum(needs.values())).select(F.col("id").alias("i")).select(
            "i", _piecewise(i, needs, {r: r for r in needs}).alias("_g"),
            draw_index(f"{seed}/base", i, _piecewise(i, needs, sizes)).alias("idx"),
            (draw_index(f"{seed}/pick", i, k_eff) + 1).cast("int").alias("rank"), uniform(f"{seed}/gap", i).alias("u"),
        )
        rows = cut_lineage(lookup(drawn, pairs, ["_g", "idx", "rank"], how="inner"))
        vec = F.array(*[F.col("a")[v] for v in z.values()])
        cases = rows.select("_g", vec.alias("vec"), "distance").distinct()
        near = None
        for r in needs:  # the regions: low, high, common
            points = placed.where(F.col("region") == r).select(F.col("_key").alias("pid"), F.array(*z.values()).alias("vec"))
            one = _near_cases(cases.where(F.col("_g") == r), points).select(F.lit(r).alias("_g"), "vec", "distance", "_near")
            near = one if near is None else near.unionByName(one)
        rows = lookup(rows.withColumn("vec", vec), near, ["_g", "vec", "distance"], how="inner")
        out = []
        for c in sd_cols:
            between = F.col("a")[c] + F.col("u") * (F.col("b")[c] - F.col("a")[c])
            jitter = F.col("a")[c] + F.lit(perturbation) * _piecewise(i, needs, {r: sd[r][c] for r in needs}) * normal(f"{seed}/jitter/{c}", i)
            out.append(F.when(F.col("_near"), between).otherwise(jitter).alias(c))
        picked = [F.when(F.col("_near") & (F.col("u") >= 0.5), F.col("b")[c]).otherwise(F.col("a")[c]).alias(c) for c in cats]
        origin = F.when(F.col("_near"), "interpolated").otherwise("jittered").alias("origin")
        parts.append(rows.select(F.col("_g").alias("region"), *out, *picked, origin))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
