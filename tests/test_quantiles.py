"""Exact quantiles against numpy, with ties, heavy values and many refinements."""

from __future__ import annotations

import numpy as np
import pytest

from oddsloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("few", [4, 50_000])
def test_quantiles_equal_numpy(spark, few):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=3000), "b": np.repeat([1.0, 2.0, 5.0], [10, 900, 7]), "c": np.array([4.0]), "d": np.exp(r.normal(size=700) * 20), None: r.integers(0, 5, 50).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(q.g, q.prob): q.quantile for q in exact_quantiles(df, "x", probs, ("g",), few).collect()}
    assert len(got) == 5 * len(probs)
    for g, xs in groups.items():
        assert np.allclose([got[g, p] for p in probs], np.quantile(xs, probs), rtol=1e-12)
    whole = {q.prob: q.quantile for q in exact_quantiles(df, "x", [0.5], (), few).collect()}
    assert whole == {0.5: np.median([x for _, x in rows if x is not None and x == x])}
    assert exact_quantiles(df.filter("false"), "x", [0.5]).collect() == []
