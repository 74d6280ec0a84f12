"""Invariants of the odds mathematics and the cleaning functions on hand-made rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import odds, scalars
from oddsloom.operators import pricing


def value(spark, column, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(column.alias("x")).first().x


def prices(*p):
    return F.array(*map(F.lit, p))


@pytest.mark.parametrize("how", sorted(odds.DEVIG))
def test_margin_removal_sums_to_one(spark, how):
    p = value(spark, odds.DEVIG[how](prices(1.8, 3.6, 4.5)))
    assert sum(p) == pytest.approx(1, abs=1e-9) and p[0] > p[1] > p[2]


def test_power_and_shin_take_more_from_outsiders(spark):
    plain, power, shin = (value(spark, odds.DEVIG[k](prices(1.3, 5.0, 10.0))) for k in ("multiplicative", "power", "shin"))
    assert power[2] < plain[2] and shin[2] < plain[2] and power[0] > plain[0]


def test_no_root_gives_null(spark):
    assert value(spark, odds.devig_power(prices(1.0, 1.0))) is None
    assert value(spark, odds.devig_shin(prices(2.5, 2.5))) is None


@pytest.mark.parametrize(("raw", "fmt", "error"), [(["0.9", "1.1"], "HK", None), (["-0.1", "1"], "HK", "impossible_hk_value"), (["0.9", "2"], "DECIMAL", "impossible_decimal_value"), (["x", "2"], "DECIMAL", "missing_or_non_numeric"), (["2", "2"], "US", "unverified_odds_format")])
def test_price_formats(spark, raw, fmt, error):
    out = value(spark, odds.decimal_prices(F.array(*map(F.lit, raw)), F.lit(fmt)))
    assert out.error == error and (out.prices is None) == (error is not None)


@pytest.mark.parametrize(("raw", "market", "line"), [("半球", "ah", -0.5), ("受平手/半球", "ah", 0.25), ("受让一球", "ah", 1.0), ("2.5", "ou", 2.5), ("2.5/3", "ou", 2.75), ("-0.25", "ah", -0.25), ("半球/?", "ah", None)])
def test_lines(spark, raw, market, line):
    assert value(spark, scalars.asian_line(F.lit(raw), F.lit(market))) == line


@pytest.mark.parametrize(
    ("raw", "want"),
    [("9-6 02:00", "2026-09-05 18:00:00"), ("12-31 23:00", "2025-12-31 15:00:00"), ("2026,8,6,03,30,00", "2026-09-05 19:30:00"), ("2026,9-1,6,03,30,00", "2026-09-05 19:30:00"), ("2026-09-06T03:00:00+02:00", "2026-09-06 01:00:00"), ("nonsense", None), ("2026,13,6,03,30,00", None), ("", None)],
)
def test_timestamps(spark, raw, want):
    anchor = "2026-01-02 00:00:00" if raw.startswith("12") else "2026-09-06 10:00:00"
    got = value(spark, scalars.timestamp(F.lit(raw), F.lit(anchor).cast("timestamp")).cast("string"))
    assert got == want


@pytest.mark.parametrize(("raw", "want"), [("17.0", "17"), (" b ", "b"), ("", None), (None, None), ("1.5", "1.5")])
def test_identifiers(spark, raw, want):
    assert value(spark, scalars.identifier(F.lit(raw).cast("string"))) == want


def test_ticks(spark):
    got = [value(spark, odds.tick_index(F.lit(c))) for c in (101, 199, 200, 202, 300, 100000, 203)]
    assert got[:4] == [0, 98, 99, 100] and got[4] == 149 and got[5] > got[4] and got[6] is None


def test_names(spark):
    score = lambda a, b: value(spark, scalars.name_score(F.lit(a), F.lit(b)))
    assert score("FC Málaga", "malaga") == 1.0 and score("Real Madrid", "Real Madrid B") == 0.92 and score("Ajax", "Porto") == 0.0


def test_redaction(spark):
    text = "token = abcdef123 and /home/me/file stays out"
    out = value(spark, scalars.redact(F.lit(text)))
    assert "abcdef123" not in out and "/home/me" not in out and value(spark, scalars.has_secret(F.lit(text)))


@pytest.fixture(scope="module")
def grid(spark):
    return pricing.score_grid(spark.createDataFrame([(1, 1.5, 1.5, -0.05), (2, 2.0, 0.8, 0.0)], "id long, lh double, la double, rho double"), ["id"]).cache()


def test_grid_invariants(grid):
    out = {r.id: r for r in pricing.outcome_probabilities(grid, ["id"]).collect()}
    assert out[1].home == pytest.approx(out[1].away) and out[2].home > out[2].away
    assert all(r.home + r.draw + r.away == pytest.approx(1) for r in out.values())


def test_settlements(spark, grid):
    lines = spark.createDataFrame([(k,) for k in (-3, -2, -1, 0, 1, 2)], "line_q int")
    rows = pricing.settlement_distribution(grid, lines, ["id"]).withColumn("w", pricing.win_equivalent()).collect()
    out = {(r.id, r.line_q): r for r in rows}
    home = {r.id: r.home for r in pricing.outcome_probabilities(grid, ["id"]).collect()}
    assert out[1, -2].full_win == pytest.approx(home[1]) and out[1, -2].push == 0 and out[1, -1].half_loss > 0
    for k in (1, 2):
        w = [out[k, q].w for q in (-2, 0, 2)]
        assert w == sorted(w)


def test_implied_rates_come_back(spark, grid):
    o = pricing.outcome_probabilities(grid, ["id"]).selectExpr("id", "home AS q_home", "draw AS q_draw", "away AS q_away", "10 AS line_q", "over_2_5 AS q_over")
    got = {r.id: r for r in pricing.implied_rates(o).collect()}
    assert got[1].lambda_home == pytest.approx(1.5, abs=1e-3) and got[2].lambda_away == pytest.approx(0.8, abs=1e-3)


def test_posterior_between_prior_and_market(spark):
    one = lambda x: F.lit(float(x))
    cols = pricing.log_rate_update([one(0), one(0)], [one(1), one(0), one(1)], [one(1), one(1)], [one(1), one(0), one(1)], one(1))
    out = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()
    assert out.c0 == pytest.approx(0.5) and out.c2 == pytest.approx(0.5) and out.c3 == pytest.approx(0)


def test_predictive_grid_without_variance_is_the_grid(spark, grid):
    p = spark.createDataFrame([(2, 0.6931471805599453, -0.2231435513142097, 1e-12, 0.0, 1e-12, 0.0)], "id long, m_h double, m_a double, v_hh double, v_ha double, v_aa double, rho double")
    got = {(r.h, r.a): r.p for r in pricing.predictive_grid(p, ["id"]).collect()}
    for r in grid.filter("id = 2").collect():
        assert got[r.h, r.a] == pytest.approx(r.p, abs=1e-6)


def test_years_do_not_leak(spark):
    """Shuffled later rows leave every earlier value as it is."""
    from oddsloom.operators import ratings

    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(days=k // 2), "L", 2024, k % 4, (k + 1) % 4, k % 3, (k + 1) % 2) for k in range(40)]
    late = [(*r[:6], 9, 9) if r[0] >= 30 else r for r in rows]
    schema = "match_id long, kickoff timestamp, competition string, season_start int, home_team long, away_team long, home_goals long, away_goals long"
    a, b = ({r.match_id: r for r in ratings.matchup_rates(spark.createDataFrame(x, schema)).collect()} for x in (rows, late))
    assert all(a[k] == b[k] for k in range(30)) and a[39] != b[39]
