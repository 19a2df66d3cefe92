"""Membership inference by nearest synthetic neighbour, and distances to real records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.operators.frames import cut_lineage, drop_checkpoint
from semblance.operators.layout import Layout, assemble
from semblance.operators.neighbors import knn_join
from semblance.operators.ranks import exact_quantiles, running_counts

# Verdict limits on the attack AUC and the reported false-positive rates.
SAFE_AUC = 0.6
BANDS = ((0.55, "excellent"), (0.6, "safe"), (0.7, "caution"))
WORST_BAND = "warning"
FPR_BOUNDS = (0.01, 0.05)


def attack_features(df: DataFrame, layout: Layout, key: Column, use_target: bool = True) -> DataFrame:
    """(id, vec): numeric columns, one-hot blocks and (optionally) the target, in original units."""
    used = layout if use_target else Layout(layout.numeric, None, layout.categorical, layout.cardinality)
    return assemble(df.withColumn("id", key), used, "vec", keep=["id"])


def standardize_vectors(frames: Sequence[DataFrame], by: DataFrame) -> list[DataFrame]:
    """Scale ``vec`` of several frames with the mean and population std of one of them."""
    d = by.agg(F.max(F.size("vec"))).first()[0]
    v = [F.col("vec")[i] for i in range(d)]
    row = by.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(v)]).first()
    scaled = F.array(*[(x - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, x in enumerate(v)])
    return [f.withColumn("vec", scaled) for f in frames]


def attack_distances(train: DataFrame, holdout: DataFrame, syn: DataFrame, k: int = 1, run: str = "0") -> DataFrame:
    """(run, role, id, distance): mean distance of each real row to its k nearest synthetic rows.

    Inputs are (id, vec) frames; scaling uses the synthetic rows.
    """
    return attack_distances_by_run({run: (train, holdout, syn)}, k)


def attack_distances_by_run(runs: dict[str, tuple[DataFrame, DataFrame, DataFrame]], k: int = 1) -> DataFrame:
    """The same for several runs of (train, holdout, synthetic): one neighbour search, keyed by run."""
    real, fake, kept = None, None, []
    for run, (train, holdout, syn) in runs.items():
        syn = cut_lineage(syn)  # read for its moments and its rows
        kept.append(syn)
        members, others, copies = standardize_vectors([train, holdout, syn], syn)
        queries = None
        for mark, side in (("m:", members), ("n:", others)):
            one = side.select(F.lit(run).alias("run"), F.concat(F.lit(mark), F.col("id").cast("string")).alias("qid"), "vec")
            queries = one if queries is None else queries.unionByName(one)
        points = copies.select(F.lit(run).alias("run"), F.col("id").alias("pid"), "vec")
        real = queries if real is None else real.unionByName(queries)
        fake = points if fake is None else fake.unionByName(points)
    # scaled inputs are written once: the search reads them several times
    real, fake = cut_lineage(real), cut_lineage(fake)
    for syn in kept:
        drop_checkpoint(syn)
    near = knn_join(real, fake, k, by="run") if len(runs) > 1 else knn_join(real.drop("run"), fake.drop("run"), k).select(F.lit(next(iter(runs))).alias("run"), "*")
    dist = near if k == 1 else near.groupBy("run", "qid").agg(F.avg("distance").alias("distance"))
    # the search is dear and every report reads it several times
    return cut_lineage(dist.select(
        "run", F.when(F.startswith("qid", F.lit("m:")), "member").otherwise("nonmember").alias("role"),
        F.substring("qid", 3, 1 << 20).alias("id"), "distance",
    ))


def _roc_steps(distances: DataFrame) -> DataFrame:
    """Counts per distinct attack score, most member-like first, with running totals.

    The logistic model has one feature, so its ranking is that of the distance, rising or
    falling with the sign of the slope, which is the sign of the gap between the group means.
    """
    means = distances.groupBy("run").agg(
        F.avg(F.when(F.col("role") == "member", F.col("distance"))).alias("m"),
        F.avg(F.when(F.col("role") == "nonmember", F.col("distance"))).alias("n"),
        F.count_if(F.col("role") == "member").alias("n_member"), F.count_if(F.col("role") == "nonmember").alias("n_non"),
    )
    # one row per run
    rows = distances.join(F.broadcast(means), "run")
    gap = F.col("m") - F.col("n")
    order = F.when(gap < 0, F.col("distance")).when(gap > 0, -F.col("distance")).otherwise(F.lit(0.0))
    long = rows.select("run", order.alias("value"), (F.col("role") == "member").cast("long").alias("hit"))
    steps = running_counts(long, "run", {"mem": F.sum("hit"), "non": F.sum(1 - F.col("hit"))})
    return steps.join(F.broadcast(means), "run")


def _summary(distances: DataFrame, bounds: Sequence[float] = FPR_BOUNDS, drop_collinear: bool = True) -> DataFrame:
    """Everything the ROC gives, one row per run, from one aggregation over the steps."""
    after = F.col("after")
    corner = after.isNull() | (after["mem"] != F.col("mem")) | (after["non"] != F.col("non"))
    kept = corner if drop_collinear else F.lit(True)
    fpr, tpr = F.col("cum_non") / F.col("n_non"), F.col("cum_mem") / F.col("n_member")
    wins = F.sum(F.col("mem") * (F.col("n_non") - F.col("cum_non") + F.col("non") / 2))
    return _roc_steps(distances).groupBy("run").agg(
        (wins / (F.first("n_member").cast("double") * F.first("n_non"))).alias("auc"),
        *[F.min(F.when(kept & (fpr >= b), tpr)).alias(f"tpr_at_{round(b * 100)}_fpr") for b in bounds],
        F.first("m").alias("member_mean"), F.first("n").alias("nonmember_mean"),
        F.first("n_member").alias("n_member"), F.first("n_non").alias("n_nonmember"),
    )


def attack_auc(distances: DataFrame) -> DataFrame:
    """Rank AUC of the one-feature attack per run, ties averaged."""
    return _summary(distances).select("run", "auc")


def tpr_at_fpr(distances: DataFrame, bounds: Sequence[float] = FPR_BOUNDS, drop_collinear: bool = True) -> DataFrame:
    """TPR at the first ROC point whose FPR reaches each bound (no interpolation)."""
    out = _summary(distances, bounds, drop_collinear)
    return out.select("run", *[c for c in out.columns if c.startswith("tpr_at_")])


def fit_logistic_by(df: DataFrame, by: str, x: str, label: str, penalty: float = 1.0, tol: float = 1e-10, rounds: int = 50) -> dict:
    """{key: (intercept, slope)} of one-feature logistic models, penalty * slope^2 / 2 on the sum of losses.

    Newton steps for all keys at once: each round is one grouped aggregate (loss, gradient and 2 x 2
    Hessian by key), of which six numbers per key reach the driver. A step that does not lower
    the loss is halved. A key of one class has no finite optimum; its steps end with ``rounds``.
    """
    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    at = {r[by]: (0.0, 0.0) for r in rows.select(by).distinct().collect()}
    best: dict = {}
    step: dict = {}
    kind = dict(df.dtypes)[by]
    for _ in range(rounds):
        open_keys = [k for k in at if k not in best or step[k] is not None]
        if not open_keys:
            break
        # one row per key
        here = df.sparkSession.createDataFrame([(k, *at[k]) for k in open_keys], f"{by} {kind}, _a double, _b double")
        margin = F.col("_a") + F.col("_b") * F.col("x")
        p = 1.0 / (1.0 + F.exp(-margin))
        loss = F.greatest(margin, F.lit(0.0)) - F.col("y") * margin + F.log1p(F.exp(-F.abs(margin)))
        w = p * (1.0 - p)
        sums = rows.join(F.broadcast(here), by).groupBy(by).agg(
            F.sum(loss).alias("f"), F.sum(p - F.col("y")).alias("ga"), F.sum((p - F.col("y")) * F.col("x")).alias("gb"),
            F.sum(w).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w * F.col("x") * F.col("x")).alias("bb")).collect()
        for r in sums:
            k, (a, b) = r[by], at[r[by]]
            f = r["f"] + penalty * b * b / 2.0
            if k in best and not f <= best[k][0] + 1e-12 * abs(best[k][0]):
                step[k] = tuple(s / 2.0 for s in step[k])
            else:
                ga, gb, bb = r["ga"], r["gb"] + penalty * b, r["bb"] + penalty
                det = r["aa"] * bb - r["ab"] ** 2
                best[k] = (f, a, b)
                step[k] = ((r["ab"] * gb - bb * ga) / det, (r["ab"] * ga - r["aa"] * gb) / det) if det > 0 else None
            if step[k] is not None and max(map(abs, step[k])) <= tol * (1.0 + max(abs(best[k][1]), abs(best[k][2]))):
                step[k] = None
            if step[k] is not None:
                at[k] = (best[k][1] + step[k][0], best[k][2] + step[k][1])
    return {k: (a, b) for k, (_, a, b) in best.items()}


def attack_accuracy(distances: DataFrame) -> DataFrame:
    """(run, accuracy): share classified right at 0.5 by a logistic model (L2 penalty 1) fitted on the same rows."""
    data = distances.select("run", "distance", (F.col("role") == "member").cast("int").alias("label"))
    models = fit_logistic_by(data, "run", "distance", "label")
    table = distances.sparkSession.createDataFrame([(k, *m) for k, m in models.items()], f"run {dict(distances.dtypes)['run']}, _a double, _b double")
    said = (F.col("_a") + F.col("_b") * F.col("distance") > 0).cast("int")
    # one row per run
    return data.join(F.broadcast(table), "run").groupBy("run").agg(F.avg((said == F.col("label")).cast("double")).alias("accuracy"))


def auc_band(auc: Column) -> Column:
    out = None
    for limit, name in BANDS:
        out = F.when(auc < limit, name) if out is None else out.when(auc < limit, name)
    return out.otherwise(WORST_BAND)


def privacy_verdict(distances: DataFrame, n_synthetic: int | None = None, drop_collinear: bool = True) -> DataFrame:
    """AUC, TPR at low FPR, mean distances, counts, the safe flag and the band, per run.

    Read it next to a health report of the synthetic rows: a collapsed table also gives AUC 0.5.
    """
    out = _summary(distances, FPR_BOUNDS, drop_collinear)
    out = out.withColumn("safe", F.col("auc") < SAFE_AUC).withColumn("band", auc_band(F.col("auc")))
    return out if n_synthetic is None else out.withColumn("n_synthetic", F.lit(n_synthetic))


def privacy_multi_run(distances: DataFrame) -> DataFrame:
    """Mean and population std of the AUC over runs, and the band of the mean."""
    out = attack_auc(distances).agg(
        F.count("*").alias("n_runs"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
    )
    return out.withColumn("band", auc_band(F.col("auc_mean")))


def privacy_utility_table(utility: DataFrame, privacy: DataFrame) -> DataFrame:
    """Per method: utility, AUC and 1 - AUC, from measured rows only.

    ``utility`` is (method, r2), ``privacy`` is (method, auc).
    """
    return utility.join(privacy, "method").select("method", "r2", "auc", (F.lit(1.0) - F.col("auc")).alias("privacy"))


def closest_records(syn: DataFrame, real: DataFrame) -> DataFrame:
    """(id, nearest, distance): each synthetic row and its nearest real row, scaled by the real rows."""
    fake, known = (cut_lineage(x) for x in standardize_vectors([syn, real], real))
    near = knn_join(fake.select(F.col("id").alias("qid"), "vec"), known.select(F.col("id").alias("pid"), "vec"), 1)
    return near.select(F.col("qid").alias("id"), F.col("pid").alias("nearest"), "distance")


def distance_to_closest_record(syn: DataFrame, real: DataFrame, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of the distance to the closest real record and how many rows are exact copies."""
    near = cut_lineage(closest_records(syn, real))
    q = exact_quantiles(near, ["distance"], probs)["distance"]
    return near.agg(
        F.count("*").alias("n"), F.count_if(F.col("distance") == 0.0).alias("n_copies"), F.avg("distance").alias("mean"),
        *[F.lit(v).alias(f"q{round(p * 100)}") for p, v in zip(probs, q)],
    )
