"""Order-book JSON, outcome maps and rule flags over wide feature rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOK = "struct<markets:map<string,struct<marketActive:boolean,outcomes:map<string,struct<players:map<string,struct<price:double,active:boolean,mainLine:boolean>>>>>>>"


def outcome_map(markets: DataFrame, sport: int, market_type: str) -> DataFrame:
    """(outcome_id, outcome) from a menu (sport_id, market_type, handicap, player_prop, outcomes): whole-match, no handicap, no player props."""
    ok = (F.col("sport_id") == sport) & (F.col("market_type") == market_type) & (F.abs("handicap") < 1e-9) & ~F.col("player_prop")
    rows = markets.filter(ok).select(F.explode("outcomes").alias("o"))
    name = F.when(F.col("o.name").isin("1", "home"), "home").when(F.col("o.name").isin("X", "draw"), "draw").when(F.col("o.name").isin("2", "away"), "away")
    return rows.select(F.col("o.id").alias("outcome_id"), name.alias("outcome")).filter("outcome IS NOT NULL").distinct()


def flatten_order_book(rows: DataFrame, column: str, outcomes: DataFrame) -> DataFrame:
    """One row per active main-line price of a mapped outcome; inactive markets and unmapped outcomes are left out."""
    keys = [c for c in rows.columns if c != column]
    parsed = rows.select(*keys, F.from_json(column, BOOK).alias("b"))
    m = parsed.select(*keys, F.explode("b.markets").alias("market_id", "m")).filter("m.marketActive")
    o = m.select(*keys, "market_id", F.explode("m.outcomes").alias("outcome_id", "o"))
    p = o.select(*keys, "market_id", "outcome_id", F.explode("o.players").alias("player", "p")).filter("p.active AND p.mainLine")
    return p.join(F.broadcast(outcomes), "outcome_id").select(*keys, "market_id", "outcome", F.col("p.price").alias("price"))


@dataclass(frozen=True)
class Rule:
    """A flag over one feature row, in SQL. Without a condition its threshold is not known: it stays UNRESOLVED."""

    inputs: tuple[str, ...] = ()
    condition: str | None = None
    usable: str = "true"  # beyond that no input is missing
    conflict: str = "false"  # inputs that contradict each other


def deviates(name: str, by: float) -> Rule:
    """``name`` lies ``by`` standard deviations or more from its baseline."""
    mean, sd = f"{name}_baseline_mean", f"{name}_baseline_sd"
    return Rule((name, mean, sd), f"abs(({name} - {mean}) / {sd}) >= {by}", f"{sd} > 0")


# fixed values: rule names, inputs and thresholds
SHADOW_RULES = {
    "R36": Rule(("contradictory_dimensions",), "contradictory_dimensions >= 2", "contradictory_dimensions >= 0"),
    "R37": Rule(("favorite_signal_stack_complete", "performance_like_flag"), "favorite_signal_stack_complete AND performance_like_flag"),
    "R38": Rule(("main_direction_support", "opposite_direction_support"), "main_direction_support AND NOT opposite_direction_support"),
    "R39": Rule(("traded_volume_timeseries", "price_timeseries"), "element_at(traded_volume_timeseries, -1) > traded_volume_timeseries[0] AND element_at(price_timeseries, -1) < price_timeseries[0]", "size(traded_volume_timeseries) >= 2 AND size(price_timeseries) >= 2"),
    "R58": Rule(("betfair_concentration_pct", "asian_handicap_not_adjusted"), "betfair_concentration_pct > 80.0 AND asian_handicap_not_adjusted"),
    "R59": Rule(("competition_level", "match_type")),
    "R60": Rule(("cross_bookmaker_conflict",)),
    "R61": Rule(("home_profit_loss_ratio", "draw_profit_loss_ratio", "away_profit_loss_ratio")),
    "R62": Rule(("selection_probability", "kelly_index", "all_selection_kelly_indices"), "selection_probability > 0.60 AND kelly_index <= array_min(all_selection_kelly_indices) + 1e-12", "size(all_selection_kelly_indices) >= 2"),
    "R63": Rule(("best_back", "best_lay", "wom_pct"), "best_lay - best_back < 0.10 AND wom_pct BETWEEN 40.0 AND 60.0", conflict="best_lay < best_back"),
    "R64": Rule(("deep_order_share_pct",)),
    "R65": Rule(("wom_pct", "back_depth", "lay_depth")),
    "R66": deviates("ou_profitability", 2.0),
    "R67": Rule(("back_ladder", "back_volume_timeseries")),
    "R74": deviates("kelly_dispersion", 1.5),
    "R75": Rule(("kelly_heat_index",)),
    "R76": Rule(("spread_ticks",), "spread_ticks > 1", "spread_ticks >= 0"),
    "R77": Rule(("matched_trade_side_direction", "price_direction"), "matched_trade_side_direction <> price_direction"),
    "R96": Rule(),
    "R99": Rule(),
}


def _present(column: str, kind: str) -> Column:
    """Not null, and finite if a number or numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.coalesce(finite(F.col(column)), F.lit(False))
    if kind in ("array<double>", "array<float>", "array<int>", "array<bigint>"):
        return F.coalesce(F.forall(column, finite), F.lit(False))
    return F.col(column).isNotNull()


def rule_flags(rows: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """(keys, rule, state) of every rule: MISSING if an input is, or is no column; UNRESOLVED without a condition; else CONFLICT, TRIGGERED or NOT_TRIGGERED."""
    kinds = dict(rows.dtypes)
    states = []
    for name, rule in rules.items():
        if all(c in kinds for c in rule.inputs):
            ready = F.lit(True)
            for c in rule.inputs:
                ready = ready & _present(c, kinds[c])
            ready = ready & F.coalesce(F.expr(rule.usable), F.lit(False))
            verdict = F.lit("UNRESOLVED") if rule.condition is None else F.when(F.expr(rule.conflict), "CONFLICT").when(F.expr(rule.condition), "TRIGGERED").otherwise("NOT_TRIGGERED")
            state = F.when(ready, verdict).otherwise("MISSING")
        else:
            state = F.lit("MISSING")
        states.append(F.struct(F.lit(name).alias("rule"), state.alias("state")))
    return rows.select(*keys, F.explode(F.array(*states)).alias("x")).select(*keys, "x.*")
