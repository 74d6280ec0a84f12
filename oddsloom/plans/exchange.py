"""Exchange snapshots (S-05, S-06, Q-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import exchange as ops
from oddsloom.sources.bind import odds_events, quotes, table

from .registry import Plans

PLANS = Plans()


def _menu(spark, d):
    """A market menu with one market per part."""
    return table(spark, d, "part").selectExpr("p_partkey AS market_id", "CAST(p_size % 3 AS INT) AS sport_id", "IF(p_size % 2 = 0, '1x2', 'totals') AS market_type", "CAST(p_size % 5 AS DOUBLE) AS handicap", "p_size % 7 = 0 AS player_prop", "array(struct(p_partkey * 10 AS id, '1' AS name), struct(p_partkey * 10 + 1 AS id, 'X' AS name), struct(p_partkey * 10 + 2 AS id, 'other' AS name)) AS outcomes")


@PLANS.add("SELECT p_partkey * 10 + k AS outcome_id, CASE k WHEN 0 THEN 'home' ELSE 'draw' END AS outcome FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_size % 3 = 1 AND p_size % 2 = 0 AND p_size % 5 = 0 AND p_size % 7 <> 0")
def s06_outcome_map(spark, d):
    return ops.outcome_map(_menu(spark, d), 1, "1x2")


@PLANS.add("SELECT record_id, CAST(match_id AS VARCHAR) AS market_id, o AS outcome, round(price + k, 6) AS price FROM odds_events, (SELECT unnest([0, 1]) AS k, unnest(['home', 'draw']) AS o) WHERE record_id % 5 > 0 AND NOT (k = 1 AND record_id % 3 = 0)")
def s05_order_book_flatten(spark, d):
    e = odds_events(spark, d)
    doc = F.expr("""to_json(struct(map(CAST(match_id AS STRING), struct(record_id % 5 > 0 AS marketActive, map('10', struct(map('0', struct(price AS price, true AS active, true AS mainLine)) AS players),
        '11', struct(map('0', struct(price + 1 AS price, record_id % 3 > 0 AS active, true AS mainLine), '1', struct(price AS price, true AS active, false AS mainLine)) AS players), '99', struct(map('0', struct(price AS price, true AS active, true AS mainLine)) AS players)) AS outcomes)) AS markets))""")
    outcomes = spark.range(1).selectExpr("inline(array(struct('10' AS outcome_id, 'home' AS outcome), struct('11' AS outcome_id, 'draw' AS outcome)))")
    out = ops.flatten_order_book(e.select("record_id", doc.alias("doc")), "doc", outcomes)
    return out.select("record_id", "market_id", "outcome", F.round("price", 6).alias("price"))


def _flag(condition: str, missing: str = "false", conflict: str = "false", known: bool = True) -> str:
    verdict = f"CASE WHEN {conflict} THEN 'CONFLICT' WHEN {condition} THEN 'TRIGGERED' ELSE 'NOT_TRIGGERED' END" if known else "'UNRESOLVED'"
    return f"CASE WHEN {missing} THEN 'MISSING' ELSE {verdict} END"


_FLAGS = {
    "R36": _flag("r % 4 - 1 >= 2", "r % 4 = 0"),
    "R37": _flag("r % 2 = 0 AND r % 3 = 0", "r % 5 = 0"),
    "R38": _flag("r % 2 = 0 AND r % 3 <> 0", "r % 7 = 0"),
    "R39": _flag("a > h AND d < a", "r % 5 = 0"),
    "R58": _flag("h * 20 > 80 AND r % 2 = 0", "r % 6 = 0"),
    "R59": _flag("", "r % 10 = 0", known=False),
    "R60": _flag("", "r % 3 = 0", known=False),
    "R61": _flag("", "r % 3 = 0", known=False),
    "R62": _flag("1 / h > 0.6e0 AND h <= least(h, d, a) + 1e-12", "r % 7 = 0"),
    "R63": _flag("a - h < 0.1e0 AND 100 * h / (h + a) BETWEEN 40 AND 60", "r % 5 = 0", "a < h"),
    "R64": _flag("", "r % 4 = 0", known=False),
    "R65": _flag("", "r % 6 = 0", known=False),
    "R66": _flag("abs((a - 3) / (r % 3 * 0.5e0)) >= 2", "r % 3 = 0"),
    "R67": _flag("", "r % 2 = 1", known=False),
    "R74": _flag("abs((d - 3) / 0.2e0) >= 1.5e0"),
    "R75": _flag("", "r % 8 = 0", known=False),
    "R76": _flag("r % 4 - 1 > 1", "r % 4 = 0"),
    "R77": _flag("(r % 2 = 0) <> (r % 3 = 0)", "r % 9 = 0"),
    "R96": _flag("", known=False),
    "R99": _flag("", known=False),
}
_FEATURES = [
    "h AS best_back",
    "IF(r % 5 > 0, a, NULL) AS best_lay",
    "100 * h / (h + a) AS wom_pct",
    "h AS home_profit_loss_ratio",
    "d AS draw_profit_loss_ratio",
    "IF(r % 3 > 0, a, double('nan')) AS away_profit_loss_ratio",
    "IF(r % 7 > 0, 1 / h, NULL) AS selection_probability",
    "h AS kelly_index",
    "array(h, d, a) AS all_selection_kelly_indices",
    "IF(r % 4 > 0, 40e0, NULL) AS deep_order_share_pct",
    "h * 100 AS back_depth",
    "IF(r % 6 > 0, a * 100, NULL) AS lay_depth",
    "a AS ou_profitability",
    "3e0 AS ou_profitability_baseline_mean",
    "r % 3 * 0.5e0 AS ou_profitability_baseline_sd",
    "IF(r % 2 = 0, array(h), NULL) AS back_ladder",
    "array(a) AS back_volume_timeseries",
    "d AS kelly_dispersion",
    "3e0 AS kelly_dispersion_baseline_mean",
    "0.2e0 AS kelly_dispersion_baseline_sd",
    "IF(r % 8 > 0, h, NULL) AS kelly_heat_index",
    "CAST(r % 4 - 1 AS INT) AS spread_ticks",
    "CAST(r % 4 - 1 AS INT) AS contradictory_dimensions",
    "IF(r % 9 > 0, IF(r % 2 = 0, 'back', 'lay'), NULL) AS matched_trade_side_direction",
    "IF(r % 3 = 0, 'back', 'lay') AS price_direction",
    "r % 2 = 0 AS favorite_signal_stack_complete",
    "IF(r % 5 > 0, r % 3 = 0, NULL) AS performance_like_flag",
    "r % 2 = 0 AS main_direction_support",
    "IF(r % 7 > 0, r % 3 = 0, NULL) AS opposite_direction_support",
    "array(h, a) AS traded_volume_timeseries",
    "IF(r % 5 > 0, array(a, d), array(d)) AS price_timeseries",
    "h * 20 AS betfair_concentration_pct",
    "IF(r % 6 > 0, r % 2 = 0, NULL) AS asian_handicap_not_adjusted",
    "IF(r % 10 > 0, 'top', NULL) AS competition_level",
    "'league' AS match_type",
    "IF(r % 3 > 0, true, NULL) AS cross_bookmaker_conflict",
]


@PLANS.add("WITH f AS (SELECT match_id, source_row AS r, p_home AS h, p_draw AS d, p_away AS a FROM quotes WHERE market = '1x2'), s AS (" + " UNION ALL ".join(f"SELECT match_id % 10 AS part, '{k}' AS rule, {v} AS state FROM f" for k, v in _FLAGS.items()) + ") SELECT part, rule, state, count(*) AS n FROM s GROUP BY ALL")
def q13_shadow_rules(spark, d):
    f = quotes(spark, d).filter("market = '1x2'").selectExpr("match_id", "source_row AS r", "p_home AS h", "p_draw AS d", "p_away AS a").selectExpr("match_id", "r", *_FEATURES)
    flags = ops.rule_flags(f, ["match_id", "r"], ops.SHADOW_RULES)
    return flags.groupBy((F.col("match_id") % 10).alias("part"), "rule", "state").agg(F.count(F.lit(1)).alias("n"))
