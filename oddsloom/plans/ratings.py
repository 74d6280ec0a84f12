"""Histories, baselines and ratings (W-15..19, A-08..12, M-11 to M-14, M-16, R-04, M-18, M-20..23, S-07, S-09..11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.operators import ratings as ops
from oddsloom.operators import rolling
from oddsloom.operators import season_ratings as season_ops
from oddsloom.operators.quantiles import exact_quantiles
from oddsloom.sources.bind import matches, quotes, table

from .registry import Plans

PLANS = Plans()
_PAST = "PARTITION BY competition ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
_TEAM = "SELECT match_id, kickoff, competition, season_start, 'home' AS venue, home_team AS team, home_goals AS gf, away_goals AS ga FROM matches UNION ALL SELECT match_id, kickoff, competition, season_start, 'away', away_team, away_goals, home_goals FROM matches"
_TPAST = "PARTITION BY competition, team, venue ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


@PLANS.add(f"SELECT match_id, CAST(count(*) OVER w AS BIGINT) AS games, CAST(coalesce(sum(home_goals) OVER w, 0) AS BIGINT) AS home_goals_before FROM matches WINDOW w AS ({_PAST})")
def w15_strictly_past(spark, d):
    m = ops.with_past(ops.with_time(matches(spark, d)), ["competition"], {"games": F.lit(1).cast("long"), "home_goals_before": F.col("home_goals")})
    return m.select("match_id", "games", "home_goals_before")


@PLANS.add("SELECT a.match_id, round(sum(b.home_goals * pow(0.5e0, (epoch_us(a.kickoff) - epoch_us(b.kickoff)) / 86400000000e0 / 90)), 6) AS decayed FROM matches a LEFT JOIN matches b ON a.competition = b.competition AND a.home_team = b.home_team AND b.kickoff < a.kickoff GROUP BY a.match_id")
def w16_decayed_sums(spark, d):
    m = ops.with_time(matches(spark, d))
    m = ops.with_past(m, ["competition", "home_team"], {"games": F.lit(1), "decayed": F.col("home_goals").cast("double")}, 90.0)
    return m.select("match_id", F.round(F.when(F.col("games") > 0, F.col("decayed")), 6).alias("decayed"))


@PLANS.add(f"""WITH n AS (SELECT *, row_number() OVER w AS rn, sum(gf) OVER w AS s, count(*) OVER (PARTITION BY competition, team, venue ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS k FROM ({_TEAM}) WINDOW w AS (PARTITION BY competition, team, venue ORDER BY kickoff, match_id ROWS UNBOUNDED PRECEDING))
    SELECT a.match_id, a.venue, round((b.s - coalesce(c.s, 0)) / CAST(least(a.k, 5) AS DOUBLE), 6) AS form FROM n a LEFT JOIN n b ON (a.competition, a.team, a.venue, a.k) = (b.competition, b.team, b.venue, b.rn) LEFT JOIN n c ON (a.competition, a.team, a.venue, a.k - 5) = (c.competition, c.team, c.venue, c.rn)""")
def w17_last_n_form(spark, d):
    t = ops.team_view(ops.with_time(matches(spark, d)))
    return t.select("match_id", "venue", F.round(ops.last_n_mean("gf", ["competition", "team", "venue"], 5), 6).alias("form"))


@PLANS.add("""WITH p AS (SELECT match_id, competition, event_ts, fav, avg(fav) OVER (PARTITION BY competition, CAST(event_ts AS DATE) ORDER BY event_ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 HOUR PRECEDING) AS r FROM (SELECT event_id AS match_id, event_type AS competition, ts AS event_ts, CAST(value > 20 AS INT) AS fav FROM events))
    SELECT match_id, round(r, 6) AS favourite_rate FROM p""")
def w18_same_day_state(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("match_id"), "event_type", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") > 20).cast("int").alias("fav"))
    w = Window.partitionBy("event_type", "day").orderBy("us").rangeBetween(Window.unboundedPreceding, -7_200_000_000)
    return e.select("match_id", F.round(F.avg("fav").over(w), 6).alias("favourite_rate"))


@PLANS.add("SELECT competition, season_start, CASE rank() OVER (PARTITION BY competition ORDER BY season_start DESC) WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT competition, season_start FROM matches)")
def w19_season_folds(spark, d):
    s = matches(spark, d).select("competition", "season_start").distinct()
    k = F.dense_rank().over(Window.partitionBy("competition").orderBy(F.desc("season_start")))
    return s.withColumn("k", k).select("competition", "season_start", F.when(F.col("k") == 1, "test").when(F.col("k") == 2, "validation").otherwise("train").alias("split"))


@PLANS.add("SELECT competition, season_start, count(*) AS n, count(DISTINCT home_team) AS teams, CASE WHEN count(*) >= 80 THEN 'OK' ELSE 'INSUFFICIENT_HISTORY' END AS status FROM matches GROUP BY GROUPING SETS ((competition), (competition, season_start))")
def a08_competition_coverage(spark, d):
    m = matches(spark, d)
    g = m.groupingSets([[F.col("competition")], [F.col("competition"), F.col("season_start")]], "competition", "season_start").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("home_team").alias("teams"))
    return g.withColumn("status", F.when(F.col("n") >= 80, "OK").otherwise("INSUFFICIENT_HISTORY"))


@PLANS.add(f"SELECT competition, season_start, team, count(*) AS games, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(coalesce(sum(gf) FILTER (WHERE venue = 'home'), 0) AS BIGINT) AS home_gf FROM ({_TEAM}) GROUP BY ALL")
def a09_team_seasons(spark, d):
    t = ops.team_view(ops.with_time(matches(spark, d)))
    return t.groupBy("competition", "season_start", "team").agg(F.count(F.lit(1)).alias("games"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(F.when(F.col("venue") == "home", F.col("gf")).otherwise(0)).alias("home_gf"))


@PLANS.add("SELECT c_nationkey AS entity, arg_max(alias, {'n': n, 'alias': alias}) AS canonical_name FROM (SELECT c_nationkey, c_mktsegment AS alias, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def a10_canonical_alias(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(F.col("c_nationkey").alias("entity")).agg(F.max_by("alias", F.struct("n", "alias")).alias("canonical_name"))


_BASE = f"SELECT match_id, CASE WHEN count(*) OVER w > 0 THEN sum(home_goals) OVER w / CAST(count(*) OVER w AS DOUBLE) END AS home_rate, CASE WHEN count(*) OVER w > 0 THEN sum(away_goals) OVER w / CAST(count(*) OVER w AS DOUBLE) END AS away_rate FROM matches WINDOW w AS ({_PAST})"


@PLANS.add(f"SELECT match_id, round(home_rate, 9) AS home_rate, round(away_rate, 9) AS away_rate FROM ({_BASE})")
def m20_baseline_all_history(spark, d):
    b = ops.baseline_snapshots(matches(spark, d))
    return b.select("match_id", F.round("home_rate", 9).alias("home_rate"), F.round("away_rate", 9).alias("away_rate"))


@PLANS.add("""SELECT a.match_id, round(sum(b.home_goals * w) / sum(w), 9) AS home_rate, round(sum(b.away_goals * w) / sum(w), 9) AS away_rate FROM matches a LEFT JOIN (SELECT competition, kickoff, sum(home_goals) AS home_goals, sum(away_goals) AS away_goals, count(*) AS n FROM matches GROUP BY ALL) b0 ON a.competition = b0.competition AND b0.kickoff < a.kickoff,
    LATERAL (SELECT b0.home_goals / CAST(b0.n AS DOUBLE) AS home_goals, b0.away_goals / CAST(b0.n AS DOUBLE) AS away_goals, b0.n * pow(0.5e0, (epoch_us(a.kickoff) - epoch_us(b0.kickoff)) / 86400000000e0 / 365) AS w) b GROUP BY a.match_id""")
def m20_baseline_decayed(spark, d):
    b = ops.baseline_snapshots(matches(spark, d), half_life_days=365.0)
    return b.select("match_id", F.round("home_rate", 9).alias("home_rate"), F.round("away_rate", 9).alias("away_rate"))


@PLANS.add("SELECT a.match_id, round(sum(b.hg) / CAST(sum(b.n) AS DOUBLE), 9) AS home_rate, round(sum(b.ag) / CAST(sum(b.n) AS DOUBLE), 9) AS away_rate FROM matches a LEFT JOIN (SELECT competition, season_start, kickoff, sum(home_goals) AS hg, sum(away_goals) AS ag, count(*) AS n FROM matches GROUP BY ALL) b ON a.competition = b.competition AND b.kickoff < a.kickoff AND b.season_start >= a.season_start - 1 GROUP BY a.match_id")
def m20_baseline_two_seasons(spark, d):
    b = ops.baseline_snapshots(matches(spark, d), seasons=2)
    return b.select("match_id", F.round("home_rate", 9).alias("home_rate"), F.round("away_rate", 9).alias("away_rate"))


_STRENGTH = f"""t AS ({_TEAM}), c AS (SELECT match_id, venue, team, count(*) OVER w AS n, coalesce(sum(gf) OVER w, 0) AS sf, coalesce(sum(ga) OVER w, 0) AS sa FROM t WINDOW w AS ({_TPAST})), b AS ({_BASE}),
    s AS (SELECT c.*, home_rate, away_rate, CASE venue WHEN 'home' THEN home_rate ELSE away_rate END AS own, CASE venue WHEN 'home' THEN away_rate ELSE home_rate END AS oth FROM c JOIN b USING (match_id)), z AS (SELECT *, (sf + 5 * own) / (n + 5) / nullif(own, 0) AS attack, (sa + 5 * oth) / (n + 5) / nullif(oth, 0) AS concede FROM s)"""


@PLANS.add(f"WITH {_STRENGTH} SELECT match_id, venue, round(attack, 6) AS attack, round(concede, 6) AS concede FROM z")
def a11_a12_shrunk_strengths(spark, d):
    s = ops.team_strengths(matches(spark, d))
    return s.select("match_id", "venue", F.round("attack", 6).alias("attack"), F.round("concede", 6).alias("concede"))


_MATCHUP = f"""{_STRENGTH}, mu AS (SELECT h.match_id, least(greatest(h.home_rate * coalesce(h.attack, 1) * coalesce(a.concede, 1), 0.05e0), 6e0) AS lambda_home, least(greatest(h.away_rate * coalesce(a.attack, 1) * coalesce(h.concede, 1), 0.05e0), 6e0) AS lambda_away FROM z h JOIN z a ON h.match_id = a.match_id AND h.venue = 'home' AND a.venue = 'away' WHERE h.home_rate IS NOT NULL)"""


@PLANS.add(f"WITH {_MATCHUP} SELECT match_id, round(lambda_home, 6) AS lambda_home, round(lambda_away, 6) AS lambda_away FROM mu")
def m21_matchup_rates(spark, d):
    r = ops.matchup_rates(matches(spark, d).select("*")).filter("match_id IS NOT NULL")
    known = ops.baseline_snapshots(matches(spark, d)).filter("home_rate IS NOT NULL").select("match_id")
    return r.join(known, "match_id", "left_semi").select("match_id", F.round("lambda_home", 6).alias("lambda_home"), F.round("lambda_away", 6).alias("lambda_away"))


_RES = f"""{_MATCHUP}, k AS (SELECT match_id, 3e0 / avg(p_home) AS mh, 3e0 / avg(p_away) AS ma FROM quotes GROUP BY 1), w AS (SELECT match_id, mh - lambda_home AS rh, ma - lambda_away AS ra FROM mu JOIN k USING (match_id)),
    e AS (SELECT match_id, 'home' AS kind, rh AS r FROM w UNION ALL SELECT match_id, 'away', ra FROM w UNION ALL SELECT match_id, 'margin', rh - ra FROM w UNION ALL SELECT match_id, 'total', rh + ra FROM w),
    md AS (SELECT kind, median(r) AS med FROM e GROUP BY kind), sc AS (SELECT e.kind, any_value(med) AS med, greatest(1.4826e0 * median(abs(r - med)), 1e-6) AS mad FROM e JOIN md ON e.kind = md.kind GROUP BY e.kind)"""


def _rounded(c, places):
    """As SQL's round on doubles: what rounds to zero keeps its sign."""
    return F.round(F.abs(c), places) * F.signum(c)


@PLANS.add(f"WITH {_RES} SELECT match_id, e.kind, round(r, 6) AS residual, round((r - med) / mad, 5) AS robust_z, CASE WHEN abs((r - med) / mad) >= 3 THEN 'EXTREME' WHEN abs((r - med) / mad) >= 2 THEN 'STRONG' WHEN abs((r - med) / mad) >= 1 THEN 'MODERATE' ELSE 'NORMAL' END AS label FROM e JOIN sc ON e.kind = sc.kind")
def m22_a17_market_residuals(spark, d):
    """Home, away, margin and total rates of the market less those of the matchup, on a scale of median and MAD from exact quantiles.

    The last bits of a mean hang on the order of its sum, so residuals are written once: each round of the quantiles and the scores see the same.
    """
    from oddsloom.plans.ingest import _once

    mk = quotes(spark, d).groupBy("match_id").agg((3 / F.avg("p_home")).alias("mh"), (3 / F.avg("p_away")).alias("ma"))
    known = ops.baseline_snapshots(matches(spark, d)).filter("home_rate IS NOT NULL").select("match_id")
    w = ops.matchup_rates(matches(spark, d)).join(known, "match_id", "left_semi").join(mk, "match_id").select("match_id", (F.col("mh") - F.col("lambda_home")).alias("home"), (F.col("ma") - F.col("lambda_away")).alias("away"))
    e = w.withColumns({"margin": F.col("home") - F.col("away"), "total": F.col("home") + F.col("away")}).unpivot("match_id", ["home", "away", "margin", "total"], "kind", "r")
    e = _once(e, "residuals")
    med = exact_quantiles(e, "r", [0.5], ("kind",)).select(F.col("kind").alias("k"), F.col("quantile").alias("med"))
    off = e.join(F.broadcast(med), F.col("kind") == F.col("k")).withColumn("off", F.abs(F.col("r") - F.col("med")))
    mad = exact_quantiles(off, "off", [0.5], ("kind",)).select(F.col("kind").alias("k2"), F.greatest(1.4826 * F.col("quantile"), F.lit(1e-6)).alias("mad"))
    z = (F.col("r") - F.col("med")) / F.col("mad")
    out = off.join(F.broadcast(mad), F.col("kind") == F.col("k2")).withColumn("z", z)
    return out.select("match_id", "kind", _rounded("r", 6).alias("residual"), _rounded("z", 5).alias("robust_z"), F.when(F.abs("z") >= 3, "EXTREME").when(F.abs("z") >= 2, "STRONG").when(F.abs("z") >= 1, "MODERATE").otherwise("NORMAL").alias("label"))


@PLANS.add(f"WITH b AS ({_BASE}) SELECT m.match_id, CASE WHEN m.match_id % 4 = 0 THEN 'NO_EXACT_PREKICKOFF_ROW' WHEN b.home_rate IS NULL THEN 'NO_HISTORY' ELSE 'EXACT' END AS status, CASE WHEN m.match_id % 4 > 0 THEN round(b.home_rate, 9) END AS home_rate FROM matches m JOIN b USING (match_id)")
def m23_strict_cutoff_lookup(spark, d):
    m = matches(spark, d).select("match_id", "kickoff")
    stored = ops.baseline_snapshots(matches(spark, d)).filter("match_id % 4 > 0").withColumn("stored", F.lit(True))
    j = m.join(stored, "match_id", "left")
    return j.select("match_id", F.when(F.col("stored").isNull(), "NO_EXACT_PREKICKOFF_ROW").when(F.col("home_rate").isNull(), "NO_HISTORY").otherwise("EXACT").alias("status"), F.round("home_rate", 9).alias("home_rate"))


@PLANS.add("SELECT match_id, kickoff, competition, home_goals FROM (SELECT *, row_number() OVER (PARTITION BY competition, kickoff, home_team, away_team ORDER BY match_id) AS rn FROM matches) WHERE rn = 1")
def s07_s09_results_scan(spark, d):
    m = matches(spark, d).filter("home_goals >= 0 AND away_goals >= 0 AND kickoff IS NOT NULL").dropDuplicates(["match_id"])
    w = Window.partitionBy("competition", "kickoff", "home_team", "away_team").orderBy("match_id")
    return m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("match_id", "kickoff", "competition", "home_goals")


@PLANS.add("SELECT match_id, book_id, phase, round(price, 6) AS price FROM (SELECT match_id, book_id, min(p_home) AS opening, max(p_home) AS closing FROM quotes WHERE book_id IN (0, 1, 2) GROUP BY ALL) UNPIVOT (price FOR phase IN (opening, closing))")
def s10_s11_phase_unpivot(spark, d):
    g = quotes(spark, d).filter(F.col("book_id").isin(0, 1, 2)).groupBy("match_id", "book_id").agg(F.min("p_home").alias("opening"), F.max("p_home").alias("closing"))
    return g.unpivot(["match_id", "book_id"], ["opening", "closing"], "phase", "price").withColumn("price", F.round("price", 6))


@PLANS.add()
def m11_fitted_ratings(spark, d):
    """Season-linked ratings of every competition as of its last match."""
    r = season_ops.linked_ratings(matches(spark, d), half_life_days=365.0)
    return r.select("competition", "kind", "team", "season_start", *(F.round(c, 6).alias(c) for c in ("value", "variance", "effective_matches")))


@PLANS.add()
def m12_linked_priors(spark, d):
    """Every fixture of each competition's last season, by ratings fitted on the seasons before."""
    m = matches(spark, d)
    late = Window.partitionBy("competition").orderBy(F.desc("season_start"))
    last = m.select("competition", "season_start").distinct().withColumn("k", F.row_number().over(late)).filter("k = 1").select("competition", F.col("season_start").alias("last_season"))
    tagged = m.join(F.broadcast(last), "competition")
    r = season_ops.linked_priors(tagged.filter("season_start < last_season").select(*m.columns), tagged.filter("season_start = last_season").select(*m.columns), 365.0)
    return r.select("match_id", *(F.round(c, 6).alias(c) for c in ("m_h", "m_a", "v_hh", "v_ha", "v_aa")), "home_state", "away_state")


@PLANS.add()
def m13_hyper_search(spark, d):
    """Half life, spread of teams and of season links over nested season-forward folds; the best row and whether it lies at the grid's edge."""
    r = season_ops.search(matches(spark, d), [180.0, 365.0, 720.0], [0.2, 0.35], [0.1, 0.2])
    return r.withColumn("goal_nll", F.round("goal_nll", 6))


@PLANS.add()
def m13_m16_walk_forward(spark, d):
    """Season-forward fits over a grid of half lives; mean goal NLL of each season after the first, fitted on those before."""
    m = matches(spark, d)
    grid = m.select("competition").distinct().select("competition", F.explode(F.array(F.lit(180.0), F.lit(720.0))).alias("half_life"), F.lit(0.35).alias("team_sd"), F.lit(None).cast("double").alias("link_sd"))
    return season_ops.fold_scores(m, grid).groupBy("half_life", "fold").agg(F.sum("n").alias("n"), F.round(F.sum("nll") / F.sum("n"), 6).alias("goal_nll"))


@PLANS.add()
def m14_rolling_ratings(spark, d):
    """Ratings rebuilt from the last 90 days at every month start, over changes of the league's teams."""
    r = rolling.rolling_ratings(matches(spark, d), days=90)
    return r.select("competition", "season_start", "cut", "season_end", "kind", "team", F.round("value", 6).alias("value"), F.round("variance", 6).alias("variance"), "origin")


@PLANS.add("""WITH b AS (SELECT competition, season_start, max(kickoff) AS last FROM matches GROUP BY ALL), w AS (SELECT unnest([30, 60, 90]) AS days), c AS (SELECT competition, season_start, w.days, unnest(generate_series(make_timestamp(season_start, 1, 1, 0, 0, 0.0), make_timestamp(season_start, 12, 1, 0, 0, 0.0), INTERVAL 1 MONTH)) AS cut, false AS season_end, last FROM b, w UNION ALL SELECT competition, season_start, days, last + INTERVAL 1 SECOND, true, last FROM b, w)
    SELECT m.competition, m.season_start, c.days, epoch_us(c.cut) AS cut_us, c.season_end, m.home_team, m.away_team, count(*) AS n, CAST(sum(home_goals) AS DOUBLE) AS goals_home, CAST(sum(away_goals) AS DOUBLE) AS goals_away, round(sum(pow(0.5e0, (epoch_us(c.cut) - epoch_us(m.kickoff)) / 86400000000e0 / 180)), 6) AS weight
    FROM matches m JOIN c ON m.competition = c.competition AND m.season_start = c.season_start AND m.kickoff < c.cut AND m.kickoff >= c.cut - to_days(CAST(c.days AS INTEGER)) WHERE c.season_end OR c.cut <= c.last GROUP BY ALL""")
def r04_rolling_evidence(spark, d):
    """What the ratings of the last 30, 60 and 90 days rest on, at every month start and season end."""
    m = matches(spark, d)
    parts = [rolling.rolling_evidence(m, days, 180.0).withColumn("days", F.lit(days)) for days in (30, 60, 90)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("competition", "season_start", "days", "cut_us", "season_end", "home_team", "away_team", "n", "goals_home", "goals_away", F.round("w", 6).alias("weight"))


@PLANS.add()
def m16_monthly_walk_forward(spark, d):
    """Refits at each month start on strictly earlier results: scores of A market, B prior and C both on their common matches, and of B on all it can rate."""
    from oddsloom.operators import evaluation, forms
    from oddsloom.operators.pricing import log_rate_update

    from .ingest import _once
    from .pricing import _cluster

    law = ("m_h", "m_a", "v_hh", "v_ha", "v_aa")
    m = matches(spark, d)
    dated = forms.with_month(ops.with_time(m))
    prior = forms.fixture_priors(dated, forms.monthly_posteriors(m, 365.0), on=("competition", "month_us"))
    rows = m.select("match_id", "season_start", "home_goals", "away_goals").join(prior, "match_id")
    both = rows.join(_cluster(spark, d).select("match_id", *(F.col(c).alias(f"k_{c}") for c in law)), "match_id", "left")
    both = _once(both, "walk-forward")
    market, own = ([F.col(f"{k}{c}") for c in law] for k in ("k_", ""))
    post = log_rate_update(own[:2], own[2:], market[:2], market[2:], F.lit(1.0))
    none = [F.lit(0.0)] * 3
    models = F.array(*(F.struct(F.lit(n).alias("model"), *(x.alias(c) for x, c in zip(xs, law, strict=True))) for n, xs in (("A_market", [*market[:2], *none]), ("C_both", post))))
    facts = ["season_start", "home_goals", "away_goals"]
    each = both.filter(F.col("k_m_h").isNotNull()).withColumn("x", F.explode(models)).select(*facts, "x.*", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n_all"))
    # matches of two teams in one month have one prior: those with one score are scored once, for the common matches and for all
    alike = both.groupBy(*facts, *law).agg(F.count("k_m_h").alias("n"), F.count(F.lit(1)).alias("n_all")).withColumn("model", F.lit("B_prior"))
    scored = evaluation.score_forecasts(each.unionByName(alike))
    values = [c for c in scored.columns if c not in ("model", "season_start", "n", "n_all")]
    sums = scored.groupBy("model", "season_start").agg(*(F.sum(k).alias(k) for k in ("n", "n_all")), *(F.sum(F.col(c) * F.col(k)).alias(f"{c}_{k}") for c in values for k in ("n", "n_all")))
    rated = lambda model, k: sums.filter(f"{k} > 0").select(model.alias("model"), "season_start", F.col(k).alias("n"), *(F.round(F.col(f"{c}_{k}") / F.col(k), 6).alias(c) for c in values))
    return rated(F.col("model"), "n").unionByName(rated(F.lit("B_prior_all"), "n_all"))
