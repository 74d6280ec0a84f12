"""A line's figures come out of one sort of its quotes, without a map of all lines."""

from __future__ import annotations

from oddsloom.plans import registry


def test_no_map_of_lines_is_held(spark):
    df = registry.queries()["w07_line_lifecycle"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    assert df.count() == df.select("match_id", "book_id", "market").distinct().count() > 0
