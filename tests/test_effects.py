"""Effects with two-way clustered errors against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from oddsloom.operators import evaluation


def plain(rows):
    g, u, c, x, y = (np.array(k) for k in zip(*rows, strict=True))
    x, y = x.astype(float), y.astype(float)
    for k in np.unique(u):
        at = u == k
        x[at], y[at] = x[at] - x[at].mean(), y[at] - y[at].mean()
    beta = (x @ y) / (x @ x)
    score = x * (y - beta * x)
    both = [f"{a}|{b}" for a, b in zip(u, c, strict=True)]
    meat = [sum(score[np.array(k) == v].sum() ** 2 for v in set(k)) for k in (u.tolist(), c.tolist(), both)]
    return beta, meat[0] ** 0.5 / (x @ x), meat[1] ** 0.5 / (x @ x), max(meat[0] + meat[1] - meat[2], 0) ** 0.5 / (x @ x), len(set(u.tolist())), len(set(c.tolist()))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_two_way_errors_equal_numpy(spark, by):
    r = np.random.default_rng(8)
    shock_u, shock_c = r.normal(size=20), r.normal(size=12)
    rows = []
    for _ in range(1000):
        g, u, c, x = int(r.integers(3)), int(r.integers(20)), int(r.integers(12)), int(r.integers(2))
        rows.append((g, u, c, x, float(0.3 * x + shock_u[u] + shock_c[c] * x + r.normal())))
    df = spark.createDataFrame(rows, "g int, u int, c int, x int, y double")
    got = evaluation.two_way_effect(df, "y", "x", "u", "u", "c", by).collect()
    assert len(got) == (3 if by else 1)
    for one in got:
        own = [k for k in rows if not by or k[0] == one.g]
        assert one.n == len(own)
        assert np.allclose([one.effect, one.se_first, one.se_second, one.se_two_way, one.first_clusters, one.second_clusters], plain(own))
