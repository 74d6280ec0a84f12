"""The operators that SQL does not express, against plain numpy and Python on small inputs."""

from __future__ import annotations

import collections
import datetime
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import evaluation, exchange, forms, ratings
from oddsloom.plans import quality, registry

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000.0


@pytest.fixture(scope="module")
def games(spark):
    """400 matches of two competitions of six teams, several a day."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        h = int(r.integers(6))
        a = (h + 1 + int(r.integers(5))) % 6
        day = datetime.datetime(2001, 1, 1) + datetime.timedelta(days=int(k // 3 * 2))
        rows.append((k, day, f"c{k % 2}", day.year, h, a, int(r.poisson(1.2 + 0.15 * h)), int(r.poisson(1.0 + 0.1 * a))))
    df = spark.createDataFrame(rows, "match_id long, kickoff timestamp_ntz, competition string, season_start int, home_team int, away_team int, home_goals int, away_goals int")
    return rows, df


def micros(t):
    return (t - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6


def plain_fit(rows, weight, sd, mean=None, precision=None, steps=40):
    """Mode and covariance of the Poisson ratings, one row per team and match."""
    teams = sorted({t for x in rows for t in x[4:6]})
    at = {t: k for k, t in enumerate(teams)}
    n = len(teams)
    x = np.zeros((2 * len(rows), 2 + 2 * n))
    y = np.zeros(2 * len(rows))
    for k, m in enumerate(rows):
        x[2 * k, [0, 1, 2 + at[m[4]], 2 + n + at[m[5]]]] = 1
        x[2 * k + 1, [0, 2 + at[m[5]], 2 + n + at[m[4]]]] = 1
        y[2 * k], y[2 * k + 1] = m[6], m[7]
    w = np.repeat(weight, 2)
    prior = np.diag([1e-6, 1e-6] + [1 / sd**2] * (2 * n)) if precision is None else precision
    mean = np.zeros(2 + 2 * n) if mean is None else mean
    b = mean.copy()
    for _ in range(steps):
        rate = w * np.exp(x @ b)
        b = b + np.linalg.solve(x.T @ (x * rate[:, None]) + prior, x.T @ (w * y - rate) - prior @ (b - mean))
    rate = w * np.exp(x @ b)
    names = ["mu", "home", *(f"att:{t}" for t in teams), *(f"def:{t}" for t in teams)]
    return names, b, np.linalg.inv(x.T @ (x * rate[:, None]) + prior)


def test_fitted_ratings(games):  # M-11
    rows, df = games
    got = {(r.competition, r.param): r.value for r in ratings.fit_ratings(df, 200.0).collect()}
    for c in ("c0", "c1"):
        own = [x for x in rows if x[2] == c]
        last = max(micros(x[1]) for x in own)
        names, b, _ = plain_fit(own, np.array([0.5 ** ((last - micros(x[1])) / (DAY * 200)) for x in own]), 0.35)
        assert all(abs(got[c, p] - v) < 1e-4 for p, v in zip(names, b, strict=True))
    assert len(got) == 28


def test_fixture_priors(games):  # M-12
    rows, df = games
    until = datetime.datetime(2001, 6, 1)
    got = {r.match_id: r for r in forms.fixture_priors(df, forms.rating_posteriors(df, "2001-06-01", 300.0)).collect()}
    assert len(got) == 400
    for c in ("c0", "c1"):
        own = [x for x in rows if x[2] == c and x[1] < until]
        names, b, cov = plain_fit(own, np.array([0.5 ** ((micros(until) - micros(x[1])) / (DAY * 300)) for x in own]), 0.35)
        at = {p: k for k, p in enumerate(names)}
        for x in [x for x in rows if x[2] == c][::20]:
            h = [at["mu"], at["home"], at[f"att:{x[4]}"], at[f"def:{x[5]}"]]
            a = [at["mu"], at[f"att:{x[5]}"], at[f"def:{x[4]}"]]
            want = b[h].sum(), b[a].sum(), cov[np.ix_(h, h)].sum(), cov[np.ix_(h, a)].sum(), cov[np.ix_(a, a)].sum()
            assert np.allclose([got[x[0]][k] for k in ("m_h", "m_a", "v_hh", "v_ha", "v_aa")], want, atol=2e-4)


def test_dynamic_ratings_and_priors(games):  # M-14, M-15
    rows, df = games
    states = forms.dynamic_ratings(df)
    got = {(r.competition, str(r.month), r.param): (r.value, r.variance) for r in states.collect()}
    priors = {r.match_id: r for r in forms.dynamic_fixture_priors(df, states).collect()}
    for c in ("c0", "c1"):
        own = [x for x in rows if x[2] == c]
        teams = range(6)
        names = ["mu", "home", *(f"att:{t}" for t in teams), *(f"def:{t}" for t in teams)]
        at = {p: k for k, p in enumerate(names)}
        mean, cov = np.zeros(14), np.diag([1.0, 0.1] + [0.12] * 12)
        for month in sorted({x[1].strftime("%Y-%m-01") for x in own}):
            for x in [x for x in own if x[1].strftime("%Y-%m-01") == month]:
                if month == min(y[1].strftime("%Y-%m-01") for y in own):
                    assert x[0] not in priors
                else:
                    h, a = [at["mu"], at["home"], at[f"att:{x[4]}"], at[f"def:{x[5]}"]], [at["mu"], at[f"att:{x[5]}"], at[f"def:{x[4]}"]]
                    p = priors[x[0]]
                    assert np.allclose([p.m_h, p.m_a, p.v_h, p.v_a], [mean[h].sum(), mean[a].sum(), np.diag(cov)[h].sum() + 0.01, np.diag(cov)[a].sum() + 0.01], atol=2e-3)
            cov = cov + 0.002 * np.eye(14)
            part = [x for x in own if x[1].strftime("%Y-%m-01") == month]
            precision = np.linalg.inv(cov)
            design = np.zeros((2 * len(part), 14))
            y = np.zeros(2 * len(part))
            for k, x in enumerate(part):
                design[2 * k, [at["mu"], at["home"], at[f"att:{x[4]}"], at[f"def:{x[5]}"]]] = 1
                design[2 * k + 1, [at["mu"], at[f"att:{x[5]}"], at[f"def:{x[4]}"]]] = 1
                y[2 * k : 2 * k + 2] = x[6:8]
            b = mean.copy()
            for _ in range(60):
                rate = np.exp(design @ b)
                b = b + 0.7 * np.linalg.solve(design.T @ (design * rate[:, None]) + precision, design.T @ (y - rate) - precision @ (b - mean))
            mean, cov = b, np.linalg.inv(design.T @ (design * np.exp(design @ b)[:, None]) + precision)
            for p, k in at.items():
                assert np.allclose(got[c, month, p], [mean[k], cov[k, k]], atol=2e-3)


def test_recent_form(games):  # M-18
    rows, df = games
    low = lambda v: max(0.2, v)
    got = {(r.match_id, r.venue): r for r in forms.recent_form(df, window=5).collect()}
    assert len(got) == 800
    for x in rows[::13]:
        before = [y for y in rows if y[1] < x[1]]
        league = [y for y in before if y[2] == x[2]]
        lh = (sum(y[6] for y in league) + 5 * 1.35) / (len(league) + 5)
        la = (sum(y[7] for y in league) + 5 * 1.10) / (len(league) + 5)
        for venue, team in (("home", x[4]), ("away", x[5])):
            own = sorted(((y[1], y[0], y[3], y[5], "home", y[6], y[7]) if y[4] == team else (y[1], y[0], y[3], y[4], "away", y[7], y[6])) for y in before if team in y[4:6])
            here = [e for e in own if e[4] == venue]
            source = (here or own)[::-1][:5]
            attack = defence = games_ = 0.0
            for e in source:
                met = [o for o in own if o[3] == e[3]]
                gave = (sum(o[5] for o in met) + 4 * la) / (len(met) + 4)
                took = (sum(o[6] for o in met) + 4 * lh) / (len(met) + 4)
                w = 0.5 ** ((x[1] - e[0]).total_seconds() / 86400 / 90) * (1.0 if e[2] == x[3] else 0.45)
                attack += w * e[5] / low(gave / low(la))
                defence += w * e[6] / low(took / low(lh))
                games_ += w
            ba, bd = (lh, la) if venue == "home" else (la, lh)
            want = [math.log(low((s + 4 * b) / (games_ + 4) / b)) if source else 0.0 for s, b in ((attack, ba), (defence, bd))]
            r = got[x[0], venue]
            assert np.allclose([r.attack, r.defence, r.effective_games], [*want, games_], atol=1e-6) and r.fallback == (not here)


def test_paired_bootstrap(spark):  # M-24
    r = np.random.default_rng(2)
    delta = r.normal(0.3, 1.0, 900)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(delta)], "id long, delta double")
    out = evaluation.paired_bootstrap(df, "id", "delta", 400, 3).first()
    se = delta.std() / 30
    assert out.n == 900 and abs(out["mean"] - delta.mean()) < 1e-9
    assert abs(out.low - (delta.mean() - 1.96 * se)) < 0.35 * se and abs(out.high - (delta.mean() + 1.96 * se)) < 0.35 * se
    assert tuple(evaluation.paired_bootstrap(df.repartition(3), "id", "delta", 400, 3).first()) == pytest.approx(tuple(out))


def test_placebo_keeps_the_values_of_a_group(spark):  # M-25
    rows = [(k, "ab"[k % 2], float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    out = {r.id: r for r in evaluation.permuted(df, "id", "x", 5, ["g"]).collect()}
    for g in "ab":
        own = [r for r in out.values() if r.g == g]
        assert sorted(r.x for r in own) == [x for _, h, x in rows if h == g]
        assert abs(np.corrcoef([r.id for r in own], [r.x for r in own])[0, 1]) < 0.3
    assert {r.id: r.x for r in evaluation.permuted(df.repartition(5), "id", "x", 5, ["g"]).collect()} == {i: r.x for i, r in out.items()}


def test_wild_cluster_bootstrap(spark):  # M-27
    r = np.random.default_rng(4)
    rows = [(int(c), k % 10, int(r.integers(2)), float(r.normal())) for k, c in enumerate(np.repeat(np.arange(30), 20))]

    def p_value(effect):
        df = spark.createDataFrame([(c, u, x, y + effect * x) for c, u, x, y in rows], "c int, u int, x int, y double")
        return evaluation.wild_cluster_bootstrap(df, "y", "x", "u", "c", 999, 8).first().p_value

    a = np.array(rows)
    x, y = (a[:, k] - np.array([a[a[:, 1] == u, k].mean() for u in a[:, 1]]) for k in (2, 3))
    score = np.array([(x * y)[a[:, 0] == c].sum() for c in range(30)])
    signs = r.choice([-1, 1], (20_000, 30))
    want = (np.abs(signs @ score) >= abs(score.sum())).mean()
    assert abs(p_value(0.0) - want) < 0.06 and p_value(1.0) < 0.01


def test_content_hash(spark):  # K-06
    rows = [(k, f"n{k % 7}", None if k % 5 == 0 else k / 4) for k in range(300)]
    df = spark.createDataFrame(rows, "b long, a string, c double")
    total = [0] * 8
    for b, a, c in rows:
        record = {"a": a, "b": b} | ({} if c is None else {"c": c})
        h = hashlib.sha256(json.dumps(record, separators=(",", ":")).encode()).hexdigest()
        total = [t + int(h[8 * k : 8 * k + 8], 16) for k, t in enumerate(total)]
    want = hashlib.sha256("|".join(map(str, [len(rows), *total])).encode()).hexdigest()
    assert quality.content_hash(df).first().content_hash == want == quality.content_hash(df.orderBy(F.rand(1)).select("c", "a", "b")).first().content_hash
    assert quality.content_hash(df.limit(299)).first().content_hash != want
    assert registry.queries()["k06_content_hash"](spark, SF).count() == 1


def test_quant_table(spark):  # M-06
    rows = registry.queries()["m06_quant_table"](spark, SF).collect()
    from oddsloom.sources.bind import quotes

    prices = {(q.match_id, q.book_id, q.source_row): (q.p_home, q.p_draw, q.p_away) for q in quotes(spark, SF).filter("market = '1x2' AND seq = 1").collect()}
    assert len(rows) == len(prices)
    for r in rows[::7]:
        raw = [1 / p for p in prices[r.match_id, r.book_id, r.source_row]]
        over = sum(raw) - 1
        power = solve(lambda k: sum(x**k for x in raw) - 1, 0.05, 20)
        assert abs(r.overround - over) < 2e-6 and abs(r.home_multiplicative - raw[0] / sum(raw)) < 2e-6
        assert abs(r.home_power - raw[0] ** power) < 1e-4
        gap = max(abs(x / sum(raw) - x**power) for x in raw)
        assert abs(gap - 0.015) < 1e-4 or r.warning == (gap > 0.015)


def solve(f, lo, hi):
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return lo


NUMBERS = {"selection_probability": 0.64, "kelly_index": 0.91, "all_selection_kelly_indices": [0.91, 0.97, 1.02], "best_back": 2.34, "best_lay": 2.38, "wom_pct": 52.0, "ou_profitability": 14.0, "ou_profitability_baseline_mean": 10.0, "ou_profitability_baseline_sd": 2.0, "spread_ticks": 2, "traded_volume_timeseries": [1000.0, 1800.0], "price_timeseries": [2.2, 2.04]}


@pytest.mark.parametrize(
    ("changed", "want"),
    [
        ({}, {"R62": "TRIGGERED", "R63": "TRIGGERED", "R66": "TRIGGERED", "R76": "TRIGGERED", "R39": "TRIGGERED", "R96": "UNRESOLVED", "R99": "UNRESOLVED", "R61": "MISSING", "R74": "MISSING", "R36": "MISSING"}),
        ({"best_lay": 2.30}, {"R63": "CONFLICT"}),
        ({"spread_ticks": 1, "wom_pct": 61.0, "selection_probability": 0.6}, {"R76": "NOT_TRIGGERED", "R63": "NOT_TRIGGERED", "R62": "NOT_TRIGGERED"}),
        ({"spread_ticks": -1, "wom_pct": float("nan"), "ou_profitability_baseline_sd": 0.0, "price_timeseries": [2.0]}, {"R76": "MISSING", "R63": "MISSING", "R66": "MISSING", "R39": "MISSING"}),
        ({"all_selection_kelly_indices": [0.9, None, 1.0]}, {"R62": "MISSING"}),
    ],
)
def test_shadow_rules(spark, changed, want):  # Q-13
    kinds = {int: "int", float: "double", list: "array<double>"}
    values = NUMBERS | changed
    df = spark.createDataFrame([(1, *values.values())], "id int, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    got = {r.rule: r.state for r in exchange.rule_flags(df, ["id"], exchange.SHADOW_RULES).collect()}
    assert len(got) == 20 and want.items() <= got.items()


def test_rules_over_the_quotes(spark):
    seen = collections.defaultdict(set)
    for r in registry.queries()["q13_shadow_rules"](spark, SF).collect():
        seen[r.rule].add(r.state)
    assert len(seen) == 20 and "CONFLICT" in seen["R63"] and set().union(*seen.values()) == {"TRIGGERED", "NOT_TRIGGERED", "MISSING", "UNRESOLVED", "CONFLICT"}
