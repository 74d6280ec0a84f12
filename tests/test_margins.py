"""Margins that need a root are solved once a row, over whole Arrow batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f07_devig_power", "f08_devig_shin", "f09_devig_dispatch"])
def test_each_row_is_solved_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("ArrowEvalUDF") == 1


@pytest.mark.parametrize("how", ["power", "shin"])
def test_books_of_any_size_and_none(spark, how):
    books = [(0, [1.8, 3.6, 4.5]), (1, None), (2, [1.9, 1.9]), (3, []), (4, [2.0, None, 3.0]), (5, [2.5, 3.2, 3.9, 30.0]), (6, [2.0, -3.0, 2.0])]
    rows = spark.createDataFrame(books, "id int, p array<double>").repartition(1)
    got = {r.id: r.q for r in rows.select("id", odds.DEVIG[how](F.col("p")).alias("q")).collect()}
    assert [got[k] for k in (1, 3, 4)] == [None] * 3
    for k in (0, 2, 5):
        assert len(got[k]) == len(books[k][1]) and abs(sum(got[k]) - 1) < 1e-9
    assert got[2][0] == pytest.approx(0.5)
    assert how == "shin" or got[6] is None
