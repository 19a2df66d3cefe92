"""Bootstrap, noise copies, label assignment and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.rand import draw_index, normal, uniform
from semblance.operators.frames import cut_lineage, lookup
from semblance.operators.neighbors import knn_join
from semblance.operators.prepare import fit_standard, scale
from semblance.operators.ranks import number_rows


def draws(spark, n: int, total: int, seed: str | int, name: str = "i") -> DataFrame:
    """n rows (i, idx) with idx uniform in [0, total)."""
    return spark.range(n).select(F.col("id").alias(name), draw_index(f"{seed}/draw", F.col("id"), total).alias("idx"))


def bootstrap(df: DataFrame, key: Column, n: int | None = None, seed: int = 42) -> DataFrame:
    """n rows with replacement (default: as many as df has); ``i`` numbers the draws.

    Rows are numbered in parallel and joined to the draws on that number, which both sides
    spread evenly.
    """
    numbered, total = number_rows(df, seed, key)
    picks = draws(df.sparkSession, total if n is None else n, total, seed)
    return picks.join(numbered, "idx").drop("idx")


def _jitter(col: str, seed: int, sd: float | Column) -> Column:
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return F.col(col) + sd * normal(f"{seed}/{col}", F.col("i"))


def noise_absolute(df: DataFrame, key: Column, cols: Sequence[str], n: int | None = None, scale_by: float = 0.1, seed: int = 42) -> DataFrame:
    """Bootstrap with N(0, scale) on the features; every other column, the target included, is copied."""
    rows = bootstrap(df, key, n, seed)
    return rows.withColumns({c: _jitter(c, seed, scale_by) for c in cols})


def noise_relative(df: DataFrame, key: Column, cols: Sequence[str], target: str | None = None, n: int | None = None, scale_by: float = 0.1, seed: int = 42) -> DataFrame:
    """Bootstrap with N(0, scale * population std) on features and target; categories are copied."""
    cols = [*cols, *([target] if target else [])]
    sd = {c: p[1] for c, p in fit_standard(df, cols).values.items()}
    rows = bootstrap(df, key, n, seed)
    return rows.withColumns({c: _jitter(c, seed, scale_by * sd[c]) for c in cols})


def noise_hybrid(df: DataFrame, key: Column, n_numeric: int, hybrid: str = "hybrid", n: int | None = None, scale_by: float = 0.1, seed: int = 42) -> DataFrame:
    """Bootstrap of hybrid rows with N(0, scale) on the first ``n_numeric`` dimensions (target included)."""
    rows = bootstrap(df, key, n, seed)
    noise = F.array(*[F.lit(scale_by) * normal(f"{seed}/{j}", F.col("i")) for j in range(n_numeric)])
    head = F.zip_with(F.slice(F.col(hybrid), 1, n_numeric), noise, lambda a, b: a + b)
    tail = F.slice(F.col(hybrid), F.lit(n_numeric + 1), F.greatest(F.size(hybrid) - n_numeric, F.lit(0)))
    return rows.withColumn(hybrid, F.concat(head, tail))


def sample_marginal_categories(generated: DataFrame, gen_key: Column, real: DataFrame, real_key: Column, cats: Sequence[str], seed: int = 42) -> DataFrame:
    """Attach to each generated row all the categories of one randomly drawn real row."""
    numbered, total = number_rows(real.select(*cats, real_key.alias("_rk")), seed, F.col("_rk"))
    drawn = generated.withColumn("idx", draw_index(f"{seed}/marginal", gen_key.cast("string"), total))
    return drawn.join(numbered.drop("_rk"), "idx").drop("idx")


def assign_labels_knn(
    generated: DataFrame, gen_id: str, train: DataFrame, train_id: str, cols: Sequence[str], label: str, k: int = 1, scaled: bool = True
) -> DataFrame:
    """(gen_id, label): majority label of the k nearest training rows, ties to the smallest label.

    Features are standardised with training moments first unless ``scaled=False``.
    """
    gen, real = generated, train
    if scaled:
        params = fit_standard(train, cols)
        gen, real = scale(generated, params), scale(train, params)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    near = cut_lineage(knn_join(
        gen.select(F.col(gen_id).alias("qid"), vec.alias("vec")),
        real.select(F.col(train_id).alias("pid"), vec.alias("vec")), k,
    ))
    labels = train.select(F.col(train_id).alias("pid"), F.col(label).alias(label))
    # copies share their neighbours, so a pid can be hot
    votes = lookup(near, labels, ["pid"], how="inner").groupBy("qid", label).agg(F.count("*").alias("n"))
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("b"))
    return best.select(F.col("qid").alias(gen_id), F.col("b.label").alias(label))


def assign_labels_proportional(generated: DataFrame, key: Column, train: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """Random labels with the class shares of train (classes in ascending order, null first, fill [0, 1))."""
    counts = sorted(((r[label], r["n"]) for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))
    total = sum(n for _, n in counts)
    u, run, out = uniform(f"{seed}/label", key), 0, None
    for value, n in counts[:-1]:
        run += n
        cond = u < F.lit(run / total)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    last = F.lit(counts[-1][0])
    return generated.withColumn(label, last if out is None else out.otherwise(last))


def assign_labels_auto(
    generated: DataFrame, gen_id: str, train: DataFrame, train_id: str, cols: Sequence[str], label: str, k: int = 5, seed: int = 42, scaled: bool = True
) -> tuple[DataFrame, str]:
    """Nearest-neighbour labels when they give two classes or more, else proportional ones.

    Returns the labelled rows and which way was used; ``score_alone`` is false for the fallback,
    whose labels carry no information.
    """
    near = cut_lineage(assign_labels_knn(generated, gen_id, train, train_id, cols, label, k, scaled))
    if near.select(label).distinct().limit(2).count() >= 2:
        return generated.join(near, gen_id).withColumn("score_alone", F.lit(True)), "knn"
    out = assign_labels_proportional(generated, F.col(gen_id), train, label, seed)
    return out.withColumn("score_alone", F.lit(False)), "proportional"


def minority_deficit(df: DataFrame, label: str) -> DataFrame:
    """Per class: size and how many rows it lacks against the largest class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n")).first()[0]
    return counts.withColumn("deficit", F.lit(top) - F.col("n"))


def augment(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic rows together, tagged by ``origin``."""
    return real.withColumn("origin", F.lit("real")).unionByName(synthetic.withColumn("origin", F.lit("synthetic")))


def replace(synthetic: DataFrame) -> DataFrame:
    """Synthetic rows alone, tagged like :func:`augment`."""
    return synthetic.withColumn("origin", F.lit("synthetic"))
