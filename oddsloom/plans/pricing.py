"""Pricing (M-01..10, T-01, T-02, A-13, A-18, J-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.operators import pricing as ops
from oddsloom.sources.bind import matches, quotes

from .registry import Plans

PLANS = Plans()
_RATES = "SELECT match_id, home_goals, away_goals, 0.6e0 + home_team / 12e0 AS lh, 0.5e0 + away_team / 14e0 AS la, -0.05e0 AS rho FROM matches"
_GRID = f"""r AS ({_RATES}), k AS (SELECT CAST(unnest(range(13)) AS INT) AS g), c AS (SELECT r.match_id, h.g AS h, a.g AS a, exp(-lh) * pow(lh, h.g) / factorial(h.g) * exp(-la) * pow(la, a.g) / factorial(a.g) *
    CASE WHEN h.g = 0 AND a.g = 0 THEN 1 - lh * la * rho WHEN h.g = 0 AND a.g = 1 THEN 1 + lh * rho WHEN h.g = 1 AND a.g = 0 THEN 1 + la * rho WHEN h.g = 1 AND a.g = 1 THEN 1 - rho ELSE 1e0 END AS raw FROM r, k h, k a),
    g AS (SELECT match_id, h, a, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM c)"""


def _rates(spark, d):
    return matches(spark, d).selectExpr("match_id", "home_goals", "away_goals", "0.6e0 + home_team / 12e0 AS lh", "0.5e0 + away_team / 14e0 AS la", "-0.05e0 AS rho")


def _law(spark, d):
    return _rates(spark, d).select("match_id", "lh", "la", "rho")


@PLANS.add(f"WITH {_GRID} SELECT match_id, h, a, round(p, 6) AS p FROM g")
def m01_j17_score_grid(spark, d):
    return ops.score_grid(_law(spark, d), ["match_id"]).withColumn("p", F.round("p", 6))


@PLANS.add(f"WITH {_GRID} SELECT match_id, round(sum(p) FILTER (WHERE h > a), 6) AS home, round(sum(p) FILTER (WHERE h = a), 6) AS draw, round(sum(p) FILTER (WHERE h < a), 6) AS away, round(sum(p) FILTER (WHERE h + a >= 3), 6) AS over_2_5, round(sum(p) FILTER (WHERE h + a >= 5), 6) AS tail_5 FROM g GROUP BY match_id")
def m02_outcomes(spark, d):
    out = ops.outcomes_of(_law(spark, d), ["match_id"])
    return out.select("match_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


_STATE = "sign({m} + {l} - abs({l} % 2)) + sign({m} + {l} + abs({l} % 2))"


def _settle_sql(margin: str, sign: str) -> str:
    state = _STATE.format(m=margin, l=f"({sign} line_q)")
    return f"""WITH {_GRID}, s AS (SELECT match_id, line_q, p, {state} AS s FROM g CROSS JOIN (SELECT unnest([-3, -2, 0, 1, 9, 10, 11]) AS line_q))
    SELECT match_id, line_q, round(coalesce(sum(p) FILTER (WHERE s = 2), 0), 6) AS full_win, round(coalesce(sum(p) FILTER (WHERE s = 1), 0), 6) AS half_win, round(coalesce(sum(p) FILTER (WHERE s = 0), 0), 6) AS push, round(coalesce(sum(p) FILTER (WHERE s = -1), 0), 6) AS half_loss, round(coalesce(sum(p) FILTER (WHERE s = -2), 0), 6) AS full_loss,
    round(coalesce(sum(p) FILTER (WHERE s = 2), 0) + 0.5e0 * coalesce(sum(p) FILTER (WHERE s IN (0, 1)), 0) + 0.25e0 * coalesce(sum(p) FILTER (WHERE s = -1), 0), 6) AS win_equivalent FROM s GROUP BY ALL"""


def _settled(spark, d, total):
    out = ops.settlements_of(_law(spark, d), [-3, -2, 0, 1, 9, 10, 11], ["match_id"], total)
    out = out.withColumn("win_equivalent", ops.win_equivalent())
    return out.select("match_id", "line_q", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@PLANS.add(_settle_sql("4 * (h - a)", "+"))
def m03_m04_handicap_settlement(spark, d):
    return _settled(spark, d, False)


@PLANS.add(_settle_sql("4 * (h + a)", "-"))
def m03_total_settlement(spark, d):
    return _settled(spark, d, True)


@PLANS.add(f"WITH {_GRID} SELECT match_id, h, a, place FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 9) DESC, h DESC, a DESC) AS place FROM g) WHERE place <= 10")
def t01_top_scores(spark, d):
    return ops.top_of(_law(spark, d), ["match_id"], 10, 9)


@PLANS.add(f"""WITH {_GRID}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 9) DESC, h DESC, a DESC) AS place FROM g) WHERE place <= 10), o AS (SELECT match_id, sum(p) FILTER (WHERE h > a) AS hw, sum(p) FILTER (WHERE h < a) AS aw, sum(p) FILTER (WHERE h + a >= 3) AS ov FROM g GROUP BY 1),
    f AS (SELECT t.*, (hw >= aw AND h > a) OR (hw < aw AND h < a) AS winner_ok, (ov >= 0.5) = (h + a >= 3) AS totals_ok FROM t JOIN o USING (match_id)), x AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY totals_ok DESC, round(p, 9) DESC, h DESC, a DESC) AS pick FROM f WHERE winner_ok)
    SELECT match_id, h, a, pick, totals_ok FROM x WHERE pick <= 3""")
def t02_consistent_top3(spark, d):
    return ops.consistent_of(_law(spark, d), ["match_id"], 10, 3, 9)


_CLUSTER = "SELECT match_id, count(*) AS n, avg(ln(p_home)) AS m_h, avg(ln(p_away)) AS m_a, coalesce(var_samp(ln(p_home)), 0) + 0.0144e0 AS v_hh, coalesce(covar_samp(ln(p_home), ln(p_away)), 0) AS v_ha, coalesce(var_samp(ln(p_away)), 0) + 0.0144e0 AS v_aa, median(p_draw) AS rho FROM quotes GROUP BY match_id"


def _cluster(spark, d):
    h, a = F.log("p_home"), F.log("p_away")
    zero = lambda c: F.coalesce(F.when(F.count(F.lit(1)) > 1, c), F.lit(0.0))
    return quotes(spark, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.avg(h).alias("m_h"), F.avg(a).alias("m_a"), (zero(F.var_samp(h)) + 0.0144).alias("v_hh"), zero(F.covar_samp(h, a)).alias("v_ha"), (zero(F.var_samp(a)) + 0.0144).alias("v_aa"), F.median("p_draw").alias("rho"))


@PLANS.add(f"SELECT match_id, n, round(m_h, 6) AS m_h, round(m_a, 6) AS m_a, round(v_hh, 6) AS v_hh, round(v_ha, 6) AS v_ha, round(v_aa, 6) AS v_aa, round(rho, 6) AS rho FROM ({_CLUSTER})")
def a18_market_cluster(spark, d):
    c = _cluster(spark, d)
    return c.select("match_id", "n", *(F.round(x, 6).alias(x) for x in c.columns[2:]))


@PLANS.add(f"""WITH c AS ({_CLUSTER}), i AS (SELECT match_id, m_h, m_a, v_aa / (v_hh * v_aa - v_ha * v_ha) AS q0, -v_ha / (v_hh * v_aa - v_ha * v_ha) AS q1, v_hh / (v_hh * v_aa - v_ha * v_ha) AS q2 FROM c),
    s AS (SELECT *, 4e0 + 0.5e0 * q0 AS a, 0.5e0 * q1 AS b, 4e0 + 0.5e0 * q2 AS e, 4e0 * 1.2e0 + 0.5e0 * (q0 * m_h + q1 * m_a) AS y0, 4e0 * 0.9e0 + 0.5e0 * (q1 * m_h + q2 * m_a) AS y1 FROM i)
    SELECT match_id, round((e * y0 - b * y1) / (a * e - b * b), 6) AS post_h, round((a * y1 - b * y0) / (a * e - b * b), 6) AS post_a, round(e / (a * e - b * b), 6) AS var_h FROM s""")
def m07_log_rate_update(spark, d):
    c = _cluster(spark, d)
    out = ops.log_rate_update([F.lit(1.2), F.lit(0.9)], [F.lit(0.25), F.lit(0.0), F.lit(0.25)], [F.col("m_h"), F.col("m_a")], [F.col("v_hh"), F.col("v_ha"), F.col("v_aa")], F.lit(0.5))
    return c.select("match_id", *(F.round(x, 6).alias(n) for x, n in zip(out[:3], ("post_h", "post_a", "var_h"), strict=True)))


@PLANS.add()
def m09_predictive_grid(spark, d):
    r = _rates(spark, d).selectExpr("match_id", "ln(lh) AS m_h", "ln(la) AS m_a", "0.02e0 AS v_hh", "0.004e0 AS v_ha", "0.03e0 AS v_aa", "rho")
    return ops.predictive_grid(r, ["match_id"]).withColumn("p", F.round("p", 6))


def _quant_rows(spark, d):
    """One row per match with de-vigged 1X2 and over probabilities made from its score grid."""
    # a bet over 2.5 (line 10 in quarter units) is won in full or lost in full
    return ops.outcomes_of(_law(spark, d), ["match_id"]).selectExpr("match_id", "home AS q_home", "draw AS q_draw", "away AS q_away", "10 AS line_q", "over_2_5 AS q_over")


@PLANS.add(f"SELECT match_id, round(lh, 3) AS lambda_home, round(la, 3) AS lambda_away FROM ({_RATES})")
def m05_implied_rates(spark, d):
    """The rates behind a grid's own probabilities come back."""
    return ops.implied_rates(_quant_rows(spark, d)).select("match_id", F.round("lambda_home", 3).alias("lambda_home"), F.round("lambda_away", 3).alias("lambda_away"))


@PLANS.add()
def m06_quant_table(spark, d):
    """Per match and book: three margin removals, the gap between them, and a warning above 0.015."""
    p = F.array("p_home", "p_draw", "p_away")
    q = quotes(spark, d).filter("market = '1x2' AND seq = 1").withColumns({m: f(p) for m, f in odds.DEVIG.items()})
    gap = F.array_max(F.zip_with("multiplicative", "power", lambda x, y: F.abs(x - y)))
    return q.select("match_id", "book_id", "source_row", F.round(odds.overround(p), 6).alias("overround"), *(F.round(F.col(m)[0], 6).alias(f"home_{m}") for m in odds.DEVIG), (F.coalesce(gap, F.lit(0.0)) > 0.015).alias("warning"))


@PLANS.add("""SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'HISTORICAL' WHEN match_id % 3 = 1 AND season_start >= 1996 THEN 'AUTO_BAYESIAN' WHEN EXISTS (SELECT 1 FROM quotes q WHERE q.match_id = m.match_id AND q.market = '1x2') THEN 'MARKET_ONLY' ELSE 'MISSING_MARKET' END AS engine FROM matches m""")
def m10_engine_routing(spark, d):
    has = quotes(spark, d).filter("market = '1x2'").select("match_id").distinct().withColumn("has", F.lit(True))
    m = matches(spark, d).join(has, "match_id", "left")
    engine = F.when(F.col("match_id") % 3 == 0, "HISTORICAL").when((F.col("match_id") % 3 == 1) & (F.col("season_start") >= 1996), "AUTO_BAYESIAN").when(F.col("has"), "MARKET_ONLY").otherwise("MISSING_MARKET")
    return m.select("match_id", engine.alias("engine"))


@PLANS.add("SELECT match_id, round(avg(1/p_home), 6) AS mean, round(stddev_pop(1/p_home), 6) AS sd, round(100 * (max(1/p_home) - min(1/p_home)), 6) AS range_pp FROM quotes GROUP BY match_id")
def a13_ensemble_disagreement(spark, d):
    q = 1 / F.col("p_home")
    return quotes(spark, d).groupBy("match_id").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("sd"), F.round(100 * (F.max(q) - F.min(q)), 6).alias("range_pp"))
