"""Mergeable states, distinct counts of odd types, quantiles between enclosing edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import sketches as K
from semblance.operators.profile import distinct_counts, profile_columns
from semblance.operators.ranks import exact_quantiles


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_states_merge_to_the_state_of_the_whole(spark):
    rnd = np.random.default_rng(1)
    data = [(int(rnd.integers(0, 30_000)), str(rnd.integers(0, 40)), float(x), None) for x in np.concatenate([rnd.normal(size=20_000) * 1e3, np.zeros(500), [1e-300, -1e300]])]
    df = spark.createDataFrame(data, "a long, b string, x double, e string").cache()
    part = F.col("a") % 3
    parts = [df.where(part == i) for i in range(3)]
    for state, merge, cols in ((K.distinct_state, K.merge_distinct, ["a", "b", "e"]), (K.quantile_state, K.merge_quantiles, ["a", "x"])):
        whole = rows(state(df, cols))
        assert rows(merge(*[state(p, cols) for p in parts])) == whole == rows(merge(state(parts[2], cols), merge(state(parts[1], cols), state(parts[0], cols))))
    found = {r["column"]: r.n_distinct for r in K.distinct_estimates(K.distinct_state(df, ["a", "b", "e"])).collect()}
    exact = distinct_counts(df, ["a", "b", "e"])
    assert set(found) == {"a", "b"} and exact["e"] == 0
    assert all(abs(found[c] - exact[c]) <= 5 * 1.04 / 64 * exact[c] for c in found)
    x = np.sort([r[2] for r in data])
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    for accuracy in (0.01, 0.1):
        got = {r.prob: r.value for r in K.quantile_estimates(K.quantile_state(df, ["x"], accuracy), probs, accuracy).collect()}
        for p in probs:
            true = x[int(p * (len(x) - 1))]
            assert abs(got[p] - true) <= accuracy * abs(true) * (1 + 1e-9)
    assert K.distinct_estimates(K.distinct_state(df.where(F.lit(False)), ["a"])).count() == 0


def test_distinct_counts_of_any_type(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, 0.0D, 'a', array('a, b'), named_struct('u', 1, 'v', 'x'), true, X'01', date'2024-01-01', 1.50BD),
        (1, -0.0D, 'a ', array('a', 'b'), named_struct('u', 1, 'v', CAST(NULL AS STRING)), false, X'0100', date'2024-01-02', 1.50BD),
        (2, double('NaN'), repeat('long', 40), array('a', 'b'), named_struct('u', 1, 'v', 'x'), true, X'01', date'2024-01-02', 2.50BD),
        (NULL, double('NaN'), concat(repeat('long', 40), 'x'), array(CAST(NULL AS STRING)), NULL, NULL, NULL, NULL, NULL) AS t(`a.b`, d, s, l, t, o, y, w, m)""")
    assert distinct_counts(df, df.columns) == {"a.b": 2, "d": 2, "s": 4, "l": 3, "t": 2, "o": 2, "y": 2, "w": 2, "m": 2}
    assert distinct_counts(df, []) == {}
    plain = df.select("d", "s", "o", "m")
    exact, approx = ({r["column"]: (r.non_null, r.n_rows, r.n_distinct) for r in profile_columns(plain, a).collect()} for a in (False, True))
    assert exact == approx == {"d": (4, 4, 2), "s": (4, 4, 4), "o": (3, 4, 2), "m": (3, 4, 2)}


@pytest.mark.parametrize("small", [200_000, 0])
def test_quantiles_of_large_and_small_columns(spark, small):
    rnd = np.random.default_rng(2)
    n = 60_000
    cols = {"normal": rnd.normal(size=n), "ties": np.round(rnd.exponential(size=n), 1), "one": np.full(n, 3.0), "wild": rnd.standard_cauchy(n) ** 3}
    df = spark.createDataFrame([(*map(float, r), None if i % 2 else float(i)) for i, r in enumerate(zip(*cols.values()))], ", ".join(f"{c} double" for c in cols) + ", half double")
    for probs in ([0.0, 0.01, 0.333, 0.5, 0.99, 1.0], [i / 100 for i in range(101)]):
        got = exact_quantiles(df, [*cols, "half"], probs, small=small)
        for c, v in cols.items():
            assert np.allclose(got[c], np.quantile(v, probs))
        assert np.allclose(got["half"], np.quantile(np.arange(0, n, 2), probs))
    few = exact_quantiles(df.limit(3).select("normal", F.lit(None).cast("double").alias("none")), ["normal", "none"], [0.25, 1.0], small=small)
    assert few["none"] == [None, None] and few["normal"][0] <= few["normal"][1]
