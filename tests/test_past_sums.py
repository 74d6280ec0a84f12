"""Sums over strictly earlier rows in two levels, against Python: ties in time, several rows a day, decay."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.operators.ratings import DAY_US, with_past


@pytest.mark.parametrize("half_life", [None, 30.0])
def test_past_sums_equal_a_scan(spark, half_life):
    r = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], int((r.integers(0, 60) - 20) * DAY_US + r.integers(0, 4) * 3_600_000_000), float(r.integers(0, 5))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, us long, x double")
    got = {q.id: (q.n, q.s) for q in with_past(df, ["g"], {"n": F.lit(1.0), "s": F.col("x")}, half_life).collect()}
    for k, g, us, _ in rows:
        past = [(t, x) for _, h, t, x in rows if h == g and t < us]
        w = [0.5 ** ((us - t) / DAY_US / half_life) if half_life else 1.0 for t, _ in past]
        assert np.allclose(got[k], (sum(w), sum(a * x for a, (_, x) in zip(w, past, strict=True))), atol=1e-9)
