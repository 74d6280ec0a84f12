"""Residuals of the market: one value of each row throughout, and zeros with the sign that SQL gives them."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from oddsloom.plans import ratings

SF = "/root/testdata/sf0.001"


def test_means_that_change_between_passes_are_taken_once(spark, monkeypatch):
    shaken = F.udf(lambda x: x * float(np.random.default_rng().uniform(0.99, 1.01)), "double").asNondeterministic()
    plain = ratings.quotes
    monkeypatch.setattr(ratings, "quotes", lambda s, d: plain(s, d).withColumn("p_home", shaken("p_home")).withColumn("p_away", shaken("p_away")))
    rows = ratings.m22_a17_market_residuals(spark, SF).toPandas()
    for _, own in rows.groupby("kind"):
        middle = np.sort(own.robust_z)[(len(own) - 1) // 2 : len(own) // 2 + 1]
        assert abs(middle.mean()) < 2e-5
        assert abs(np.median(abs(own.robust_z)) - 1 / 1.4826) < 2e-5


def test_zeros_keep_their_sign(spark):
    xs = [-1e-9, 1e-9, -4e-7, -6e-7, 0.0, -0.0, -1.5, 2.0000005, None]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ratings._rounded("x", 6).alias("y")).collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in xs]
    assert got == want
    assert [math.copysign(1, y) for y in got[:-1]] == [math.copysign(1, y) for y in want[:-1]]
