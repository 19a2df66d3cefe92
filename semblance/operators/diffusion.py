"""Diffusion as table operators: schedule, forward noising, posteriors, losses, sample health."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.arrays import TINY, argmax, bind, log_add_exp, log_normalize, log_one_hot, one_hot, total
from semblance.functions.rand import WORD, digest, draw_index, normal, uniform, uniforms
from semblance.operators.frames import melt
from semblance.operators.ranks import number_rows

# Schedule constants and health limits.
COSINE_SHIFT = 0.008
BETA_MIN, BETA_MAX = 1e-4, 0.9999
LINEAR_START, LINEAR_END = 1e-4, 0.02
SCALE_STEPS = 1000.0
VAR_FLOOR = 1e-20
GUMBEL_FLOOR = 1e-30
LOG_FLOOR = 1e-40
COLLAPSE_STD, COLLAPSE_BOUND, COLLAPSE_SHARE = 0.1, 0.99, 0.5
MAX_STEPS = 100_000
#: Up to so many categories expressions are written out; beyond that they are loops over arrays.
WRITTEN_OUT = 16

SCHEDULE_COLUMNS = (
    "beta", "alpha", "abar", "abar_prev", "sqrt_abar", "sqrt_1m_abar", "recip_sqrt_abar", "recipm1_sqrt_abar",
    "post_var", "post_logvar", "coef1", "coef2",
)


@dataclass(frozen=True)
class Schedule:
    """Per-step vectors of length T."""

    values: dict[str, np.ndarray]

    @property
    def steps(self) -> int:
        return len(self.values["beta"])

    def frame(self, spark) -> DataFrame:
        rows = [(t, *[float(self.values[c][t]) for c in SCHEDULE_COLUMNS]) for t in range(self.steps)]
        return spark.createDataFrame(rows, "t int, " + ", ".join(f"{c} double" for c in SCHEDULE_COLUMNS))


def noise_schedule(steps: int, kind: str = "cosine", scaled: bool = False, first_logvar: str = "floor") -> Schedule:
    """Variance schedule of T steps.

    ``kind`` is cosine or linear; ``scaled`` multiplies the linear range by 1000/T. The first
    posterior variance is 0, so its log is floored (``first_logvar='floor'``) or takes the
    second entry (``'second'``).
    """
    if not 1 <= steps <= MAX_STEPS:
        raise ValueError(f"steps must be 1..{MAX_STEPS}")
    if kind == "cosine":
        at = np.cos((np.arange(steps + 1) / steps + COSINE_SHIFT) / (1 + COSINE_SHIFT) * math.pi / 2) ** 2
        beta = np.clip(1.0 - at[1:] / at[:-1], BETA_MIN, BETA_MAX)
    elif kind == "linear":
        factor = SCALE_STEPS / steps if scaled else 1.0
        beta = np.linspace(factor * LINEAR_START, factor * LINEAR_END, steps)
    else:
        raise ValueError("kind is cosine or linear")
    alpha = 1.0 - beta
    abar = np.exp(np.cumsum(np.log(alpha)))
    prev = np.concatenate([[1.0], abar[:-1]])
    var = beta * (1.0 - prev) / (1.0 - abar)
    logvar = np.log(np.maximum(var, VAR_FLOOR))
    if first_logvar == "second" and steps > 1:
        logvar[0] = logvar[1]
    return Schedule({
        "beta": beta, "alpha": alpha, "abar": abar, "abar_prev": prev, "sqrt_abar": np.sqrt(abar),
        "sqrt_1m_abar": np.sqrt(1.0 - abar), "recip_sqrt_abar": np.sqrt(1.0 / abar), "recipm1_sqrt_abar": np.sqrt(1.0 / abar - 1.0),
        "post_var": var, "post_logvar": logvar, "coef1": beta * np.sqrt(prev) / (1.0 - abar),
        "coef2": (1.0 - prev) * np.sqrt(alpha) / (1.0 - abar),
    })


def with_schedule(df: DataFrame, schedule: Schedule, columns: Sequence[str] = SCHEDULE_COLUMNS, more: dict[str, Column] | None = None) -> DataFrame:
    """Join the schedule on ``t``; it has at most 100,000 rows, so it is broadcast. ``more`` are expressions of its columns, computed once a step."""
    derived = [e.alias(n) for n, e in (more or {}).items()]
    return df.join(F.broadcast(schedule.frame(df.sparkSession).select("t", *columns, *derived)), "t")


def draw_steps(df: DataFrame, key: Column, steps: int, seed: int | str = 42) -> DataFrame:
    """Add ``t``, uniform in [0, T)."""
    return df.withColumn("t", draw_index(f"{seed}/t", key, steps).cast("int"))


def noise_numeric(df: DataFrame, cols: Sequence[str], schedule: Schedule, key: Column, seed: int | str = 42) -> DataFrame:
    """Add ``eps_<c>`` and ``xt_<c>`` = sqrt(abar) * x + sqrt(1 - abar) * eps at the row's ``t``."""
    out = with_schedule(df, schedule, ("sqrt_abar", "sqrt_1m_abar"))
    out = out.withColumns({f"eps_{c}": normal(f"{seed}/eps/{c}", key) for c in cols})
    out = out.withColumns({f"xt_{c}": F.col("sqrt_abar") * F.col(c) + F.col("sqrt_1m_abar") * F.col(f"eps_{c}") for c in cols})
    return out.drop("sqrt_abar", "sqrt_1m_abar")


def gumbel_sample(log_probs: Column, k: int, key: Column, seed: int | str = 42) -> Column:
    """Category drawn from log probabilities by the Gumbel-max rule; one digest gives four draws."""
    noisy = F.zip_with(log_probs, uniforms(seed, key, k), lambda lp, x: lp - F.ln(-F.ln(x + GUMBEL_FLOOR) + GUMBEL_FLOOR))
    return argmax(noisy)


def _draw_written_out(df: DataFrame, code: str, k: int, key: Column, seed: str) -> DataFrame:
    """Add ``xt_<code>``: :func:`gumbel_sample` of a block that holds ``_hit`` at the code and ``_miss`` elsewhere, as plain columns."""
    out = df.withColumns({f"_d{b}": digest(f"{seed}/{b}", key) for b in range(-(-k // 4))})

    def noisy(j: int) -> Column:
        u = F.conv(F.substring(F.col(f"_d{j // 4}"), 1 + 8 * (j % 4), 8), 16, 10).cast("bigint") / F.lit(WORD)
        return F.when(F.col(code) == j, F.col("_hit")).otherwise(F.col("_miss")) - F.ln(-F.ln(u + GUMBEL_FLOOR) + GUMBEL_FLOOR)

    names = [f"_g{j}" for j in range(k)]
    out = out.withColumns({n: noisy(j) for j, n in enumerate(names)})
    top = F.greatest(*names) if k > 1 else F.col(names[0])
    out = out.withColumn("_top", top)
    first = F.lit(None).cast("int")
    for j in reversed(range(k)):
        first = F.when(F.col(names[j]) == F.col("_top"), F.lit(j)).otherwise(first)
    return out.withColumn(f"xt_{code}", first).drop("_top", *names, *[f"_d{b}" for b in range(-(-k // 4))])


def mix_uniform(block: Column, share: Column, k: int) -> Column:
    """share * block + (1 - share) / K."""
    return F.transform(block, lambda x: share * x + (F.lit(1.0) - share) / F.lit(float(k)))


def log_mix_uniform(log_block: Column, share: Column, k: int) -> Column:
    """:func:`mix_uniform` in log space."""
    rest = F.ln(F.lit(1.0) - share + LOG_FLOOR) - math.log(k)
    return F.transform(log_block, lambda x: log_add_exp(x + F.ln(share), rest))


def noise_categorical(
    df: DataFrame, code: str, k: int, schedule: Schedule, key: Column, mode: str = "sample", seed: int | str = 42, one_step: bool = False
) -> DataFrame:
    """Noise a category code at the row's ``t``.

    ``mode='probability'`` adds ``pt_<code>``, the mixed probability block; ``mode='sample'`` adds
    ``xt_<code>``, a category drawn from it. ``one_step`` uses alpha_t instead of the running product.
    """
    share = "alpha" if one_step else "abar"
    out = with_schedule(df, schedule, (share,))
    if mode == "probability":
        out = out.withColumn(f"pt_{code}", mix_uniform(one_hot(F.col(code), k), F.col(share), k))
    elif mode == "sample":
        # the block has two different values only
        two = log_mix_uniform(F.array(F.lit(0.0), F.lit(math.log(TINY))), F.col(share), k)
        if k <= WRITTEN_OUT:
            out = with_schedule(df, schedule, (share,), {"_hit": two[0], "_miss": two[1]})
            out = _draw_written_out(out, code, k, key, f"{seed}/cat/{code}").drop("_hit", "_miss")
        else:
            levels = F.sequence(F.lit(0), F.lit(k - 1))
            logp = bind(F.struct(two.alias("p"), F.col(code).alias("c")), lambda x: F.transform(levels, lambda j: F.when(j == x["c"], x["p"][0]).otherwise(x["p"][1])))
            out = out.withColumn(f"xt_{code}", gumbel_sample(logp, k, key, f"{seed}/cat/{code}"))
    else:
        raise ValueError("mode is 'probability' or 'sample'")
    return out.drop(share)


def clean_from_noise(xt: Column, eps: Column, clip: float | None = None) -> Column:
    """x_0 implied by x_t and predicted noise (needs ``abar`` columns of the schedule on the row)."""
    x0 = F.col("recip_sqrt_abar") * xt - F.col("recipm1_sqrt_abar") * eps
    return x0 if clip is None else F.greatest(F.least(x0, F.lit(clip)), F.lit(-clip))


def posterior_numeric(x0: Column, xt: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and log variance of x_{t-1} given x_t and x_0."""
    return F.col("coef1") * x0 + F.col("coef2") * xt, F.col("post_var"), F.col("post_logvar")


def posterior_categorical(log_x0: Column, log_xt: Column, k: int) -> Column:
    """log q(x_{t-1} | x_t, x_0) per category; at t = 0 the first factor is x_0 itself."""
    prior = F.when(F.col("t") == 0, log_x0).otherwise(log_mix_uniform(log_x0, F.col("abar_prev"), k))
    likelihood = log_mix_uniform(log_xt, F.col("alpha"), k)
    return log_normalize(F.zip_with(prior, likelihood, lambda a, b: a + b))


def _pair_posteriors(k: int) -> dict[str, Column]:
    """:func:`posterior_categorical` of two one-hot blocks takes five values a step: ``_b0`` where x_0 and x_t agree and ``_b1``
    beside that, else ``_o0`` at x_0, ``_o1`` at x_t and ``_o2`` at the others."""
    def block(x0: int, xt: int) -> Column:
        return posterior_categorical(log_one_hot(F.lit(x0), k), log_one_hot(F.lit(xt), k), k)

    none = F.lit(None).cast("double")
    both, other = block(0, 0), block(0, min(1, k - 1))
    return {"_b0": both[0], "_b1": both[1] if k > 1 else none, "_o0": other[0], "_o1": other[1] if k > 1 else none, "_o2": other[2] if k > 2 else none}


def _add_pair_posterior(df: DataFrame, code: str, k: int, schedule: Schedule) -> DataFrame:
    """Add ``post_<code>``, the posterior of the clean code and ``xt_<code>`` at the row's ``t``."""
    x0, xt = F.col(code), F.col(f"xt_{code}")
    plain = posterior_categorical(log_one_hot(x0, k), log_one_hot(xt, k), k)
    if k > WRITTEN_OUT:
        return with_schedule(df, schedule, ("alpha", "abar_prev")).withColumn(f"post_{code}", plain).drop("alpha", "abar_prev")
    table = _pair_posteriors(k)
    out = with_schedule(df, schedule, ("alpha", "abar_prev"), table)

    def entry(j: int) -> Column:
        same = F.when(x0 == j, F.col("_b0")).otherwise(F.col("_b1"))
        return F.when(x0 == xt, same).otherwise(F.when(x0 == j, F.col("_o0")).when(xt == j, F.col("_o1")).otherwise(F.col("_o2")))

    # a code that is null or no level has no hit
    level = x0.between(0, k - 1) & xt.between(0, k - 1)
    out = out.withColumn(f"post_{code}", F.when(level, F.array(*[entry(j) for j in range(k)])).otherwise(plain))
    return out.drop("alpha", "abar_prev", *table)


def training_pairs(
    df: DataFrame, numeric: Sequence[str], codes: dict[str, int], schedule: Schedule, key: Column, repeats: int = 1, seed: int = 42,
    label: str | None = None, label_dropout: float = 0.0, batch_size: int | None = None,
) -> DataFrame:
    """What a denoiser learns from: per row and repeat a step, noise, noisy values and target posteriors.

    The label is blanked per row with probability ``label_dropout``; with ``batch_size`` it is
    blanked only where a whole batch drew "drop".
    """
    rows = df.withColumn("_key", key.cast("string")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.withColumn("pair", F.concat_ws("#", "_key", F.col("repeat").cast("string"))).drop("_key")
    pair = F.col("pair")
    out = noise_numeric(draw_steps(rows, pair, schedule.steps, seed), numeric, schedule, pair, seed)
    for c, k in codes.items():
        out = noise_categorical(out, c, k, schedule, pair, "sample", seed)
    for c, k in codes.items():
        out = _add_pair_posterior(out, c, k, schedule)
    if label and label_dropout > 0:
        out = out.withColumn("_drop", uniform(f"{seed}/drop", pair) < label_dropout)
        if batch_size:
            out, _ = number_rows(out, f"{seed}/batch", pair, "_row")
            batch = Window.partitionBy(F.floor(F.col("_row") / batch_size))
            out = out.withColumn("_drop", F.bool_and("_drop").over(batch)).drop("_row")
        out = out.withColumn(label, F.when(~F.col("_drop"), F.col(label))).drop("_drop")
    return out


def diffusion_losses(
    df: DataFrame, eps: dict[str, str], codes: dict[str, tuple[int, str]], schedule: Schedule, kind: str = "kl", by_step: bool = False
) -> DataFrame:
    """Numeric, categorical and total loss over (optionally per step of) noised rows.

    ``eps`` maps true noise columns to predicted ones; ``codes`` maps a clean code column to its
    cardinality and the column holding predicted logits. ``kind='ce'`` is cross-entropy of the
    clean category, ``kind='kl'`` is KL(posterior || model) for t > 0 and the negative log
    likelihood at t = 0 (needs ``xt_<code>``).
    """
    if kind not in ("kl", "ce"):
        raise ValueError("kind is 'kl' or 'ce'")
    out = with_schedule(df, schedule, ("alpha", "abar_prev"))
    sq = [(F.col(p) - F.col(e)) * (F.col(p) - F.col(e)) for e, p in eps.items()]
    num = sum(sq[1:], sq[0]) / len(sq) if sq else F.lit(0.0)
    cats = []
    for c, (k, logits) in codes.items():
        clean, guess = log_one_hot(F.col(c), k), log_normalize(F.col(logits))
        if kind == "ce":
            cats.append(-F.element_at(guess, F.col(c) + 1))
            continue
        noisy = log_one_hot(F.col(f"xt_{c}"), k)
        true, model = posterior_categorical(clean, noisy, k), posterior_categorical(guess, noisy, k)
        kl = total(F.zip_with(true, model, lambda a, b: F.exp(a) * (a - b)))
        nll = -total(F.zip_with(clean, model, lambda a, b: F.exp(a) * b))
        cats.append(F.when(F.col("t") == 0, nll).otherwise(kl))
    cat = sum(cats[1:], cats[0]) / len(cats) if cats else F.lit(0.0)
    scored = out.select("t", num.alias("num"), cat.alias("cat"))
    return scored.groupBy(*(["t"] if by_step else [])).agg(
        F.count("*").alias("n"), F.avg("num").alias("loss_num"), F.avg("cat").alias("loss_cat"), (F.avg("num") + F.avg("cat")).alias("loss")
    )


def sample_health(gen: DataFrame, train: DataFrame, cols: Sequence[str], bound: float = 0.95) -> DataFrame:
    """Per scaled column: mean and population std beside train, the share beyond the bound, and the collapse flag.

    The flag covers the whole sample: overall std below 0.1 or over half of all cells beyond 0.99.
    """
    def stats(df, tag):
        return melt(df, cols).groupBy("column").agg(
            F.avg("value").alias(f"{tag}_mean"), F.stddev_pop("value").alias(f"{tag}_std"),
            F.avg((F.abs("value") > bound).cast("double")).alias(f"{tag}_beyond"), F.count("*").alias(f"{tag}_n"),
            F.avg((F.abs("value") > COLLAPSE_BOUND).cast("double")).alias(f"{tag}_edge"),
        )

    g = stats(gen, "gen")
    # one row per column, so the unpartitioned window is bounded
    every = Window.partitionBy(F.lit(0))
    n = F.sum("gen_n").over(every)
    mean = F.sum(F.col("gen_mean") * F.col("gen_n")).over(every) / n
    second = F.sum((F.col("gen_std") * F.col("gen_std") + F.col("gen_mean") * F.col("gen_mean")) * F.col("gen_n")).over(every) / n
    edge = F.sum(F.col("gen_edge") * F.col("gen_n")).over(every) / n
    spread = F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))
    g = g.withColumn("collapsed", (spread < COLLAPSE_STD) | (edge > COLLAPSE_SHARE))
    t = stats(train, "train").select("column", "train_mean", "train_std")
    return g.join(F.broadcast(t), "column").select("column", "gen_mean", "train_mean", "gen_std", "train_std", F.col("gen_beyond").alias("beyond"), "collapsed")
