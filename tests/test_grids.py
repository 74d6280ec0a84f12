"""Grids are made in all tasks, and what is read off them equals the same over their cells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import pricing
from oddsloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
GRIDS = ["m01_j17_score_grid", "m02_outcomes", "m03_m04_handicap_settlement", "m03_total_settlement", "t01_top_scores", "t02_consistent_top3", "m05_implied_rates", "m09_predictive_grid"]


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(1, 1.5, 1.5, -0.05), (2, 2.0, 0.8, 0.0), (3, 0.3, 2.9, 0.1), (4, None, 1.0, 0.0), (5, 1.0, 1.0, 0.7)]
    return spark.createDataFrame(rows, "id long, lh double, la double, rho double")


@pytest.mark.parametrize("name", GRIDS)
def test_one_short_file_is_work_for_all_tasks(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4)" in plan
    assert "hashpartitioning" not in plan  # no cell and no match is brought together by a key


def _rows(df, *keys):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_sums_equal_those_over_cells(spark, rates):
    good = rates.filter("id <> 4")
    grid = pricing.score_grid(good, ["id"])
    assert {r.id for r in grid.select("id").distinct().collect()} == {1, 2, 3}
    assert _rows(pricing.outcomes_of(good, ["id"])) == _rows(pricing.outcome_probabilities(grid, ["id"]))
    lines = [-3, -2, 0, 1, 9, 10, 11]
    table = spark.createDataFrame([(x,) for x in lines], "line_q int")
    for total in (False, True):
        assert _rows(pricing.settlements_of(good, lines, ["id"], total)) == _rows(pricing.settlement_distribution(grid, table, ["id"], total))
    assert _rows(pricing.top_of(good, ["id"], 10, 9)) == _rows(pricing.top_scores(grid.withColumn("p", F.round("p", 9)), ["id"], 10).select("id", "h", "a", "place"))


def test_a_row_without_rates_has_no_probabilities(rates):
    got = pricing.outcomes_of(rates.filter("id = 4"), ["id"]).collect()
    assert len(got) == 1 and got[0].home is None and got[0].over_2_5 is None
