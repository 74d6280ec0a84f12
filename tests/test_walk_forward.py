"""Season-forward and monthly walk-forward evaluation cover every season and see earlier results only."""

from __future__ import annotations

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import evaluation, forms, pricing
from oddsloom.plans import registry
from oddsloom.sources.bind import matches

SF = "/root/testdata/sf0.001"


def test_every_season_after_the_first_is_a_fold(spark):
    seasons = Counter(r.season_start for r in matches(spark, SF).collect())
    rows = registry.queries()["m13_m16_walk_forward"](spark, SF).collect()
    assert {(r.half_life, r.fold): r.n for r in rows} == {(h, s): n for h in (180.0, 720.0) for s, n in seasons.items() if s > min(seasons)}


def test_monthly_posteriors_equal_single_fits(spark):
    m = matches(spark, SF)
    monthly = {(r.competition, r.month_us): r.r for r in forms.monthly_posteriors(m, 365.0, least=1).collect()}
    for until in ("1995-03-01", "1997-06-01", "2000-12-01"):
        us = int(datetime.datetime.fromisoformat(f"{until}T00:00:00+00:00").timestamp() * 1e6)
        for r in forms.rating_posteriors(m, until, 365.0).collect():
            got = monthly[r.competition, us]
            assert set(got) == set(r.r)
            for k, v in r.r.items():
                assert got[k].value == pytest.approx(v.value, abs=1e-6) and got[k].cov == pytest.approx(v.cov, abs=1e-6)


def test_forecast_scores_equal_the_grid(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0.3, 0.1, 0.02, 0.004, 0.03), (2, 0, 0, 0.5, -0.2, 0.05, 0.0, 0.01), (3, 1, 3, -0.4, 0.6, 0.2, -0.05, 0.1)], "match_id long, home_goals long, away_goals long, m_h double, m_a double, v_hh double, v_ha double, v_aa double")
    grid = pricing.predictive_grid(rows.withColumn("rho", F.lit(0.0)), ["match_id"])
    p = {(r.match_id, r.h, r.a): r.p for r in grid.collect()}
    sides = {r.match_id: r for r in pricing.outcome_probabilities(grid, ["match_id"]).collect()}
    goals = {r.match_id: (r.home_goals, r.away_goals) for r in rows.collect()}
    import math

    for r in evaluation.score_forecasts(rows).collect():
        (h, a), s = goals[r.match_id], sides[r.match_id]
        hit = (h > a, h == a, h < a)
        assert r.score_nll == pytest.approx(-math.log(p[r.match_id, h, a]))
        assert r.brier == pytest.approx(sum((x - y) ** 2 for x, y in zip((s.home, s.draw, s.away), hit, strict=True)))
        assert r.rps == pytest.approx(((s.home - hit[0]) ** 2 + (s.away - hit[2]) ** 2) / 2)
        assert r.over_brier == pytest.approx((s.over_2_5 - (h + a >= 3)) ** 2)
        better = sum(v > p[r.match_id, h, a] for k, v in p.items() if k[0] == r.match_id)
        assert (r.top1, r.top3) == (better < 1, better < 3)


def test_monthly_walk_forward_compares_the_three(spark):
    rows = registry.queries()["m16_monthly_walk_forward"](spark, SF).collect()
    n = {(r.model, r.season_start): r.n for r in rows}
    seasons = Counter(r.season_start for r in matches(spark, SF).collect())
    assert {r.model for r in rows} == {"A_market", "B_prior", "C_both", "B_prior_all"}
    late = [s for s in seasons if s > min(seasons) + 1]
    assert late and all(n["B_prior_all", s] == seasons[s] and n["A_market", s] == n["B_prior", s] == n["C_both", s] <= seasons[s] for s in late)


def test_a_posterior_meets_pairs_of_teams_and_no_single_match(spark):
    """2,000 fixtures of two pairs: each pair is priced once, and each fixture still has its own row."""
    cov = [[0.01 * (i == j) for j in range(3)] for i in range(3)]
    post = spark.createDataFrame([("x", {"mu": (0.1, 0, cov[0]), "home": (0.2, 1, cov[1]), "att:1": (0.3, 2, cov[2])})], "competition string, r map<string, struct<value: double, at: int, cov: array<double>>>")
    fixtures = spark.range(2000).select(F.col("id").alias("match_id"), F.lit("x").alias("competition"), (F.col("id") % 2 + 1).alias("home_team"), F.lit(3).alias("away_team"))
    df = forms.fixture_priors(fixtures, post)
    assert {r.match_id: round(r.m_h, 9) for r in df.collect()} == {k: 0.3 if k % 2 else 0.6 for k in range(2000)}
    assert "Aggregate [" in df._jdf.queryExecution().optimizedPlan().toString()


def test_fixed_rates_score_as_those_of_no_spread(spark):
    rows = [(k, k // 2 % 4, k // 2 % 3, 0.3, 0.1, v, 0.0, v) for k, v in enumerate([0.0, 1e-18] * 50)]
    df = evaluation.score_forecasts(spark.createDataFrame(rows, "k int, home_goals int, away_goals int, m_h double, m_a double, v_hh double, v_ha double, v_aa double").coalesce(1))
    got = {r.k: tuple(r)[1:] for r in df.collect()}
    assert len(got) == 100 and all(abs(x - y) < 1e-7 for k in range(0, 100, 2) for x, y in zip(got[k], got[k + 1], strict=True))


def test_form_is_worked_out_once_a_kickoff(spark):
    """Copies of matches at one kickoff share their form, and no window of games holds more than the last of each kickoff."""
    rows = [(100 * day + k, day, "x", 2000, k % 2, 2 + k % 3, (day + k) % 4, k % 3) for day in range(1, 20) for k in range(60)]
    m = spark.createDataFrame(rows, "match_id int, day int, competition string, season_start int, home_team int, away_team int, home_goals int, away_goals int").withColumn("kickoff", F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(day)"))
    df = forms.recent_form(m)
    got = df.join(m.select("match_id", "day"), "match_id").groupBy("day", "venue", "team").agg(F.countDistinct("attack", "defence").alias("forms"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in got) == 2 * len(rows) and {r.forms for r in got} == {1}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") >= 2 and "collect_list(struct(us" not in plan.split("Window")[1]
