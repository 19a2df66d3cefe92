"""Tail probabilities and the normal quantile (public numerical formulas)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Coefficients of Wichura's AS241 (PPND16) normal quantile.
PROBIT_A = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
PROBIT_B = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
PROBIT_C = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
PROBIT_D = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
PROBIT_E = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
PROBIT_F = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
PROBIT_SPLIT = 0.425
PROBIT_CONST = 0.180625
CDF_EDGE = 1e-7


def _ratio(num, den, r):
    return np.polyval(num[::-1], r) / np.polyval(den[::-1], r)


def probit(p: np.ndarray) -> np.ndarray:
    """Inverse standard normal CDF of values strictly inside (0, 1)."""
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    centre = q * _ratio(PROBIT_A, PROBIT_B, PROBIT_CONST - q * q)
    near = np.sign(q) * _ratio(PROBIT_C, PROBIT_D, tail - 1.6)
    far = np.sign(q) * _ratio(PROBIT_E, PROBIT_F, tail - 5.0)
    return np.where(np.abs(q) <= PROBIT_SPLIT, centre, np.where(tail <= 5.0, near, far))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    erf = np.frompyfunc(math.erf, 1, 1)
    return 0.5 * (1.0 + erf(np.asarray(x, dtype=float) / math.sqrt(2.0)).astype(float))


def chi2_tail(x: float | None, dof: int) -> float | None:
    """P(chi-square with dof degrees > x): regularised upper incomplete gamma."""
    if x is None or dof <= 0:
        return None
    if x <= 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a)) if -h + a * math.log(h) - math.lgamma(a) > -745 else 0.0
    if h < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1.0
            term *= h / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = h + 1.0 - a
    c = 1e300
    d = 1.0 / b
    f = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        f *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return min(1.0, f * scale)


def ks_exact_tail(m: int, n: int, gap: int) -> float:
    """P(largest CDF gap of two samples of m and n values >= gap / (m n)) if all orders are equally likely.

    Lattice paths from (0, 0) to (m, n) step by step: the share of paths to (i, j) that have met
    |i n - j m| >= gap, one diagonal at a time, so small tails keep their digits. O(m n) work, O(m) memory.
    """
    if gap <= 0:
        return 1.0
    i = np.arange(m + 1, dtype=np.int64)
    met = np.zeros(m + 1)
    for s in range(1, m + n + 1):
        lo, hi = max(0, s - n), min(s, m)
        at = i[lo : hi + 1]
        before = np.empty(hi - lo + 1)
        before[0] = met[lo - 1] if lo else 0.0
        before[1:] = met[lo:hi]
        now = (at * before + (s - at) * met[lo : hi + 1]) / s
        now[np.abs(at * (n + m) - s * m) >= gap] = 1.0
        met[lo : hi + 1] = now
    return float(met[m])


def normal_tails(df: DataFrame, z: str, name: str) -> DataFrame:
    """Add the two-sided tail probability of a standard normal; null stays null."""

    def run(batches):
        for pdf in batches:
            tails = [None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0)) for x in pdf[z]]
            yield pdf.assign(**{name: pd.Series(tails, index=pdf.index, dtype=float)})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double")
