"""Queries that once ran on part of the rows take all of them."""

from __future__ import annotations

from oddsloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def test_every_rated_match_has_a_grid(spark):
    rated = QUERIES["m01_j17_score_grid"](spark, SF).select("match_id").distinct().count()
    assert QUERIES["m09_predictive_grid"](spark, SF).select("match_id").distinct().count() == rated


def test_every_day_is_held_against_the_one_before(spark):
    from oddsloom.sources.bind import pool

    days = {}
    for r in pool(spark, SF).collect():
        days.setdefault(r.snapshot_date, {})[r.match_id, r.market] = (r.label, r.visible)
    names = sorted(days)
    want = {(b, *k) for a, b in zip(names, names[1:]) for k in days[a].keys() | days[b].keys() if days[a].get(k) != days[b].get(k)}
    got = [(r.snapshot_date, r.match_id, r.market) for r in QUERIES["u01_snapshot_diff"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
