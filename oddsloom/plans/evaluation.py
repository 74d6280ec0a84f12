"""Evaluation and studies (A-14..17, A-22, A-24..27, M-17, M-19, M-24..27, Q-12, T-04, T-05, W-20, W-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.operators import evaluation as ops
from oddsloom.operators import pricing
from oddsloom.operators.quantiles import exact_quantiles
from oddsloom.sources.bind import matches, quotes

from .registry import Plans

PLANS = Plans()
_FC = "SELECT m.match_id, competition, season_start, 1/avg(p_home) AS p, CAST(home_goals > away_goals AS INT) AS y, home_team, away_team, home_goals, away_goals FROM matches m JOIN quotes q USING (match_id) GROUP BY ALL"


def _forecasts(spark, d):
    q = quotes(spark, d).groupBy("match_id").agg((1 / F.avg("p_home")).alias("p"))
    m = matches(spark, d)
    return m.join(q, "match_id").withColumn("y", (F.col("home_goals") > F.col("away_goals")).cast("int"))


@PLANS.add(f"SELECT CAST(least(floor(round(p, 9) * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(round(p, 9)), 6) AS mean_p, round(avg(y), 6) AS rate FROM ({_FC}) GROUP BY 1")
def a14_calibration_bins(spark, d):
    """Forecasts of 9 places, so that the order of a sum does not decide on which side of a border one falls."""
    b = ops.calibration_bins(_forecasts(spark, d).withColumn("p", F.round("p", 9)), "p", "y")
    return b.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@PLANS.add(f"WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM ({_FC}) GROUP BY 1) SELECT round(sum(n * abs(mp - r)) / sum(n), 6) AS ece FROM b")
def a14_ece(spark, d):
    return ops.expected_calibration_error(ops.calibration_bins(_forecasts(spark, d), "p", "y")).select(F.round("ece", 6).alias("ece"))


_GRID = """r AS (SELECT match_id, season_start, home_goals, away_goals, 0.6e0 + home_team / 12e0 AS lh, 0.5e0 + away_team / 14e0 AS la FROM matches), k AS (SELECT CAST(unnest(range(13)) AS INT) AS g),
    c AS (SELECT r.match_id, h.g AS h, a.g AS a, exp(-lh) * pow(lh, h.g) / factorial(h.g) * exp(-la) * pow(la, a.g) / factorial(a.g) AS raw FROM r, k h, k a), g AS (SELECT match_id, h, a, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM c)"""


@PLANS.add(f"""WITH {_GRID}, t AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 9) DESC, h DESC, a DESC) AS rk FROM g), o AS (SELECT match_id, sum(p) FILTER (WHERE h > a) AS ph, sum(p) FILTER (WHERE h = a) AS pd, sum(p) FILTER (WHERE h < a) AS pa, sum(p) FILTER (WHERE h + a >= 3) AS ov FROM g GROUP BY 1),
    s AS (SELECT r.*, o.*, t.p AS cell, t.rk FROM r JOIN o USING (match_id) JOIN t ON t.match_id = r.match_id AND t.h = r.home_goals AND t.a = r.away_goals)
    SELECT season_start, count(*) AS n, round(avg(-ln(greatest(cell, 1e-15))), 6) AS score_nll, round(avg((rk = 1)::INT), 6) AS top1, round(avg((rk <= 3)::INT), 6) AS top3, round(avg(pow(ph - (home_goals > away_goals)::INT, 2) + pow(pd - (home_goals = away_goals)::INT, 2) + pow(pa - (home_goals < away_goals)::INT, 2)), 6) AS brier_sum,
    round(avg((pow(ph - (home_goals > away_goals)::INT, 2) + pow(ph + pd - (home_goals >= away_goals)::INT, 2)) / 2), 6) AS rps, round(avg(pow(ov - (home_goals + away_goals >= 3)::INT, 2)), 6) AS ou_brier FROM s GROUP BY season_start""")
def a15_forecast_metrics(spark, d):
    none = [F.lit(0.0).alias(c) for c in ("v_hh", "v_ha", "v_aa")]
    r = matches(spark, d).selectExpr("season_start", "home_goals", "away_goals", "ln(0.6e0 + home_team / 12e0) AS m_h", "ln(0.5e0 + away_team / 14e0) AS m_a")
    s = ops.score_forecasts(r.select("*", *none), order=1)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return s.groupBy("season_start").agg(F.count(F.lit(1)).alias("n"), *(mean(c, n) for c, n in (("score_nll", "score_nll"), ("top1", "top1"), ("top3", "top3"), ("brier", "brier_sum"), ("rps", "rps"), ("over_brier", "ou_brier"))))


_MET = "SELECT competition, CASE WHEN season_start <= 1995 THEN 'train' WHEN season_start = 1996 THEN 'validation' ELSE 'test' END AS split, 1.4e0 + home_team / 40e0 AS rate, home_goals AS g FROM matches"


@PLANS.add(f"SELECT competition, coalesce(split, 'all_oos') AS split, count(*) AS n, round(avg(rate - g * ln(rate) + ln(CAST(factorial(CAST(g AS INT)) AS DOUBLE))), 6) AS nll, round(avg(abs(g - rate)), 6) AS mae, round(sqrt(avg(pow(g - rate, 2))), 6) AS rmse, round(avg(rate - g), 6) AS bias FROM ({_MET}) WHERE split <> 'train' GROUP BY GROUPING SETS ((competition, split), (competition))")
def a16_baseline_metrics(spark, d):
    m = matches(spark, d).selectExpr("competition", "CASE WHEN season_start <= 1995 THEN 'train' WHEN season_start = 1996 THEN 'validation' ELSE 'test' END AS split", "1.4e0 + home_team / 40e0 AS rate", "home_goals AS g").filter("split <> 'train'")
    g = m.groupingSets([[F.col("competition"), F.col("split")], [F.col("competition")]], "competition", "split")
    r = lambda c, n: F.round(c, 6).alias(n)
    out = g.agg(F.count(F.lit(1)).alias("n"), r(F.avg(odds.poisson_nll(F.col("g"), F.col("rate"))), "nll"), r(F.avg(F.abs(F.col("g") - F.col("rate"))), "mae"), r(F.sqrt(F.avg(F.pow(F.col("g") - F.col("rate"), 2))), "rmse"), r(F.avg(F.col("rate") - F.col("g")), "bias"))
    return out.fillna({"split": "all_oos"})


@PLANS.add(f"SELECT competition, round(median(p), 6) AS med, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.25), 6) AS p25, round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.9), 6) AS p90 FROM ({_FC}) GROUP BY competition")
def a17_residual_percentiles(spark, d):
    names = {0.5: "med", 0.1: "p10", 0.25: "p25", 0.75: "p75", 0.9: "p90"}
    q = exact_quantiles(_forecasts(spark, d), "p", list(names), ("competition",))
    return q.groupBy("competition").agg(*(F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 6).alias(n) for p, n in names.items()))


@PLANS.add("""WITH c AS (SELECT match_id, avg(1/p_home) FILTER (WHERE book_id < 3) AS main, avg(1/p_home) FILTER (WHERE book_id >= 3) AS sec, count(DISTINCT book_id) FILTER (WHERE book_id >= 3) AS clusters FROM quotes GROUP BY 1)
    SELECT match_id, round(100 * (sec - main), 6) AS pp, CASE WHEN round(abs(sec - main), 9) < 0.03 THEN 'NOISE' WHEN round(abs(sec - main), 9) < 0.08 OR clusters < 2 THEN 'C' WHEN round(abs(sec - main), 9) < 0.15 THEN 'B' ELSE 'A' END AS grade FROM c WHERE sec IS NOT NULL AND main IS NOT NULL""")
def a22_cluster_divergence(spark, d):
    """Grades of gaps of 9 places: 0.4 - 0.25 is 0.15, in whatever order the means were summed."""
    p = 1 / F.col("p_home")
    c = quotes(spark, d).groupBy("match_id").agg(F.avg(F.when(F.col("book_id") < 3, p)).alias("main"), F.avg(F.when(F.col("book_id") >= 3, p)).alias("sec"), F.countDistinct(F.when(F.col("book_id") >= 3, F.col("book_id"))).alias("clusters")).filter("sec IS NOT NULL AND main IS NOT NULL")
    gap = F.round(F.abs(F.col("sec") - F.col("main")), 9)
    return c.select("match_id", F.round(100 * (F.col("sec") - F.col("main")), 6).alias("pp"), F.when(gap < 0.03, "NOISE").when((gap < 0.08) | (F.col("clusters") < 2), "C").when(gap < 0.15, "B").otherwise("A").alias("grade"))


_XY = "SELECT home_goals - (1.4e0 + home_team / 40e0) AS x, away_goals - (1.2e0 + away_team / 50e0) AS y, 1.4e0 + home_team / 40e0 AS rx, 1.2e0 + away_team / 50e0 AS ry, competition FROM matches WHERE season_start <= 1996"


@PLANS.add(f"WITH m AS (SELECT competition, avg(x*x) - avg(rx) AS a, avg(x*y) AS b, avg(y*y) - avg(ry) AS c FROM ({_XY}) GROUP BY 1), e AS (SELECT *, (a + c) / 2 AS t, sqrt(pow((a - c) / 2, 2) + b*b) AS r FROM m) SELECT competition, round(greatest(t + r, 0), 6) AS top_eigen, round(greatest(t - r, 0), 6) AS low_eigen FROM e")
def a24_process_covariance(spark, d):
    m = matches(spark, d).filter("season_start <= 1996").selectExpr("competition", "home_goals - (1.4e0 + home_team / 40e0) AS x", "away_goals - (1.2e0 + away_team / 50e0) AS y", "1.4e0 + home_team / 40e0 AS rx", "1.2e0 + away_team / 50e0 AS ry")
    x, y = F.col("x"), F.col("y")
    g = m.groupBy("competition").agg((F.avg(x * x) - F.avg("rx")).alias("a"), F.avg(x * y).alias("b"), (F.avg(y * y) - F.avg("ry")).alias("c"))
    t, r = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    return g.select("competition", F.round(F.greatest(t + r, F.lit(0.0)), 6).alias("top_eigen"), F.round(F.greatest(t - r, F.lit(0.0)), 6).alias("low_eigen"))


@PLANS.add("WITH t AS (SELECT DISTINCT competition, season_start, home_team AS team FROM matches WHERE home_team % 4 <> season_start % 4), g AS (SELECT competition, season_start, home_team AS team, avg(home_goals) AS gf FROM matches GROUP BY ALL) SELECT g.competition, count(*) AS entrants, round(avg(gf), 6) AS mean_gf, round(var_samp(gf), 6) AS var_gf FROM g JOIN t USING (competition, season_start, team) WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.competition = g.competition AND p.team = g.team AND p.season_start = g.season_start - 1) GROUP BY 1 HAVING count(*) >= 6")
def a25_promoted_prior(spark, d):
    m = matches(spark, d)
    t = m.filter("home_team % 4 <> season_start % 4").select("competition", "season_start", F.col("home_team").alias("team")).distinct()
    g = m.groupBy("competition", "season_start", F.col("home_team").alias("team")).agg(F.avg("home_goals").alias("gf"))
    new = g.join(t, ["competition", "season_start", "team"]).join(t.withColumn("season_start", F.col("season_start") + 1), ["competition", "season_start", "team"], "left_anti")
    return new.groupBy("competition").agg(F.count(F.lit(1)).alias("entrants"), F.round(F.avg("gf"), 6).alias("mean_gf"), F.round(F.var_samp("gf"), 6).alias("var_gf")).filter("entrants >= 6")


@PLANS.add("SELECT home_team % 5 AS bucket, count(*) AS n, count(*) FILTER (WHERE home_goals - away_goals >= 2) AS cover, count(*) FILTER (WHERE home_goals - away_goals = 1) AS win_no_cover, count(*) FILTER (WHERE home_goals = away_goals) AS draw, count(*) FILTER (WHERE home_goals < away_goals) AS upset FROM matches GROUP BY 1")
def a26_outcome_paths(spark, d):
    gap = F.col("home_goals") - F.col("away_goals")
    path = F.when(gap >= 2, "cover").when(gap == 1, "win_no_cover").when(gap == 0, "draw").otherwise("upset")
    g = matches(spark, d).withColumn("bucket", F.col("home_team") % 5).withColumn("path", path).groupBy("bucket").pivot("path", ["cover", "win_no_cover", "draw", "upset"]).count().fillna(0)
    return g.withColumn("n", F.col("cover") + F.col("win_no_cover") + F.col("draw") + F.col("upset"))


@PLANS.add(f"SELECT competition, season_start, match_id % 3 = 0 AS exposed, count(*) AS n, round(avg(CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END - (3 * p + 0.25e0)), 6) AS points_residual FROM ({_FC}) GROUP BY GROUPING SETS ((match_id % 3 = 0), (competition, match_id % 3 = 0), (season_start, match_id % 3 = 0))")
def a27_points_residual(spark, d):
    f = _forecasts(spark, d).withColumn("exposed", F.col("match_id") % 3 == 0).withColumn("r", F.expr("CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END - (3 * p + 0.25e0)"))
    e, c, s = F.col("exposed"), F.col("competition"), F.col("season_start")
    return f.groupingSets([[e], [c, e], [s, e]], "competition", "season_start", "exposed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("points_residual"))


@PLANS.add("SELECT rho, round(avg(-ln(CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - 1.96e0 * rho WHEN home_goals = 0 AND away_goals = 1 THEN 1 + 1.4e0 * rho WHEN home_goals = 1 AND away_goals = 0 THEN 1 + 1.4e0 * rho WHEN home_goals = 1 AND away_goals = 1 THEN 1 - rho ELSE 1 END)), 6) AS nll FROM matches, (SELECT unnest(range(-4, 5)) / 20e0 AS rho) GROUP BY rho")
def m17_rho_profile(spark, d):
    grid = F.broadcast(spark.range(-4, 5).select((F.col("id") / 20).alias("rho")))
    tau = odds.dixon_coles_tau(F.col("home_goals"), F.col("away_goals"), F.lit(1.4), F.lit(1.4), F.col("rho"))
    return matches(spark, d).crossJoin(grid).groupBy("rho").agg(F.round(F.avg(-F.log(tau)), 6).alias("nll"))


@PLANS.add("WITH g AS (SELECT b.id / 20e0 AS rho, round(avg(-ln(CASE WHEN home_goals + away_goals <= 2 AND home_goals = 1 AND away_goals = 1 THEN 1 - b.id / 20e0 ELSE 1 END)), 9) AS nll FROM matches, (SELECT unnest(range(-4, 5)) AS id) b GROUP BY 1) SELECT rho AS best_rho, rho IN (-0.2e0, 0.2e0) AS boundary FROM g ORDER BY nll, rho LIMIT 1")
def t04_t05_best_and_boundary(spark, d):
    grid = F.broadcast(spark.range(-4, 5).select((F.col("id") / 20).alias("rho")))
    nll = F.when((F.col("home_goals") == 1) & (F.col("away_goals") == 1), -F.log(1 - F.col("rho"))).otherwise(0.0)
    g = matches(spark, d).crossJoin(grid).groupBy("rho").agg(F.round(F.avg(nll), 9).alias("nll"))
    return g.agg(F.min_by("rho", F.struct("nll", "rho")).alias("best_rho"), F.min("rho").alias("lo"), F.max("rho").alias("hi")).select("best_rho", ((F.col("best_rho") == F.col("lo")) | (F.col("best_rho") == F.col("hi"))).alias("boundary"))


@PLANS.add(f"""WITH s AS (SELECT competition, p AS x, y - p AS r FROM ({_FC})), g AS (SELECT competition, count(*) AS n, sum(x) AS sx, sum(x*x) AS sxx, sum(r) AS sr, sum(x*r) AS sxr FROM s GROUP BY 1)
    SELECT competition, round((n * sxr - sx * sr) / (n * (sxx + 0.001e0) - sx * sx), 6) AS slope FROM g""")
def m19_residual_ridge(spark, d):
    s = _forecasts(spark, d).select("competition", F.col("p").alias("x"), (F.col("y") - F.col("p")).alias("r"))
    x, r = F.col("x"), F.col("r")
    g = s.groupBy("competition").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(r).alias("sr"), F.sum(x * r).alias("sxr"))
    return g.select("competition", F.round(F.expr("(n * sxr - sx * sr) / (n * (sxx + 0.001e0) - sx * sx)"), 6).alias("slope"))


@PLANS.add()
def m24_paired_bootstrap(spark, d):
    f = _forecasts(spark, d).select("match_id", (F.pow(F.col("p") - F.col("y"), 2) - 0.25).alias("delta"))
    return ops.paired_bootstrap(f, "match_id", "delta", 5000, 7)


@PLANS.add()
def m25_placebo(spark, d):
    f = _forecasts(spark, d).select("match_id", "competition", "p", "y")
    fake = ops.permuted(f, "match_id", "p", 11, ["competition"])
    brier = lambda x, n: x.groupBy("competition").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias(n))
    return brier(f, "real").join(brier(fake, "placebo"), "competition")


@PLANS.add("""WITH x AS (SELECT home_goals AS y, CAST(away_team % 3 = 0 AS INT) AS x, home_team AS u, season_start AS c FROM matches), d AS (SELECT c, y - avg(y) OVER (PARTITION BY u) AS yd, x - avg(x) OVER (PARTITION BY u) AS xd FROM x), b AS (SELECT sum(xd*yd) / sum(xd*xd) AS beta, sum(xd*xd) AS sxx FROM d),
    s AS (SELECT c, sum(xd * (yd - beta * xd)) AS u FROM d, b GROUP BY c) SELECT round(any_value(beta), 6) AS effect, round(sqrt(sum(u*u)) / any_value(sxx), 6) AS se, count(*) AS clusters FROM s, b""")
def m26_adjusted_effect(spark, d):
    m = matches(spark, d).selectExpr("home_goals AS y", "CAST(away_team % 3 = 0 AS INT) AS x", "home_team AS u", "season_start AS c")
    return ops.within_effect(m, "y", "x", "u", "c").select(F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), "clusters")


def _two_way_sql(by: str) -> str:
    """Effects and errors of the groups of ``by``, each error from sums per cluster."""
    cols, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    part = f"PARTITION BY {cols}u"
    errors = [f"{k} AS (SELECT {cols}sum(s * s) AS v, count(*) AS clusters FROM (SELECT {cols}{keys}, sum(xd * (yd - beta * xd)) AS s FROM d JOIN b {on} GROUP BY ALL) GROUP BY ALL)" for k, keys in (("va", "u"), ("vb", "c"), ("vab", "u, c"))]
    joins = f"JOIN va {on} JOIN vb {on} JOIN vab {on}"
    return f"""WITH x AS (SELECT competition, season_start, home_goals AS y, CAST(away_team % 3 = 0 AS INT) AS x, home_team AS u, competition || ':' || season_start AS c FROM matches), d AS (SELECT {cols}u, c, y - avg(y) OVER ({part}) AS yd, x - avg(x) OVER ({part}) AS xd FROM x),
        b AS (SELECT {cols}count(*) AS n, sum(xd * yd) / sum(xd * xd) AS beta, sum(xd * xd) AS sxx FROM d {"GROUP BY ALL" if by else ""}), {", ".join(errors)}
        SELECT {cols}n, round(beta, 6) AS effect, round(sqrt(va.v) / sxx, 6) AS se_first, round(sqrt(vb.v) / sxx, 6) AS se_second, round(sqrt(greatest(va.v + vb.v - vab.v, 0)) / sxx, 6) AS se_two_way, va.clusters AS first_clusters, vb.clusters AS second_clusters FROM b {joins}"""


def _two_way(spark, d, *by):
    m = matches(spark, d).selectExpr("competition", "season_start", "home_goals AS y", "CAST(away_team % 3 = 0 AS INT) AS x", "home_team AS u", "concat(competition, ':', season_start) AS c")
    e = ops.two_way_effect(m, "y", "x", "u", "u", "c", by)
    return e.select(*by, "n", *(F.round(c, 6).alias(c) for c in ("effect", "se_first", "se_second", "se_two_way")), "first_clusters", "second_clusters")


@PLANS.add(_two_way_sql(""))
def m26_two_way_effect(spark, d):
    """The adjusted effect with errors clustered by team, by league-season and by both."""
    return _two_way(spark, d)


@PLANS.add(_two_way_sql("season_start"))
def m26_effect_by_season(spark, d):
    return _two_way(spark, d, "season_start")


@PLANS.add(_two_way_sql("competition"))
def m26_effect_by_league(spark, d):
    return _two_way(spark, d, "competition")


@PLANS.add()
def m27_wild_cluster_bootstrap(spark, d):
    m = matches(spark, d).selectExpr("home_goals AS y", "CAST(away_team % 3 = 0 AS INT) AS x", "home_team AS u", "season_start AS c")
    return ops.wild_cluster_bootstrap(m, "y", "x", "u", "c", 9999, 3)


@PLANS.add(f"""WITH m AS (SELECT competition, count(*) AS n, round(avg(pow(p - y, 2)), 9) AS a, round(avg(pow(0.9e0 * p + 0.05e0 - y, 2)), 9) AS c FROM ({_FC}) GROUP BY 1) SELECT competition, n, CASE WHEN n < 80 THEN 'INSUFFICIENT_HISTORY' WHEN c > a + 0.005e0 THEN 'SHADOW' ELSE 'ACTIVE' END AS status, CASE WHEN c > a + 0.005e0 THEN 'BRIER_HARM' ELSE '' END AS reasons FROM m""")
def q12_release_gate(spark, d):
    p, y = F.col("p"), F.col("y")
    m = _forecasts(spark, d).groupBy("competition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(p - y, 2)), 9).alias("a_brier"), F.round(F.avg(F.pow(0.9 * p + 0.05 - y, 2)), 9).alias("c_brier"))
    return ops.gate(m, {"brier": 0.005}, {}, 80).select("competition", "n", "status", "reasons")


@PLANS.add("""WITH c AS (SELECT match_id, min(line_q) AS lo, median(line_q) AS mid, max(line_q) AS hi FROM quotes WHERE book_id < 3 GROUP BY 1)
    SELECT q.match_id, q.book_id, q.source_row, q.seq, CASE WHEN line_q > hi THEN line_q - hi WHEN line_q < lo THEN line_q - lo ELSE 0 END AS gap_q, 'D' || least(abs(CASE WHEN line_q > hi THEN line_q - hi WHEN line_q < lo THEN line_q - lo ELSE 0 END), 3) AS grade FROM quotes q JOIN c USING (match_id) WHERE book_id >= 3""")
def w20_handicap_divergence(spark, d):
    q = quotes(spark, d)
    c = q.filter("book_id < 3").groupBy("match_id").agg(F.min("line_q").alias("lo"), F.median("line_q").alias("mid"), F.max("line_q").alias("hi"))
    gap = F.expr("CASE WHEN line_q > hi THEN line_q - hi WHEN line_q < lo THEN line_q - lo ELSE 0 END")
    return q.filter("book_id >= 3").join(c, "match_id").select("match_id", "book_id", "source_row", "seq", gap.alias("gap_q"), F.concat(F.lit("D"), F.least(F.abs(gap), F.lit(3))).alias("grade"))


@PLANS.add("""WITH m AS (SELECT match_id, median(p_home) AS med FROM quotes GROUP BY 1), r AS (SELECT q.match_id, book_id, market, line_q, source_row, seq, p_home - med AS r FROM quotes q JOIN m USING (match_id)), a AS (SELECT book_id, market, line_q, avg(r) AS x, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT book_id, market, avg(r) AS x, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT avg(r) AS x FROM r)
    SELECT r.match_id, r.book_id, r.source_row, r.seq, round(r.r - CASE WHEN a.n >= 400 THEN a.x WHEN b.n >= 3000 THEN b.x ELSE c.x END, 8) AS abnormal FROM r JOIN a USING (book_id, market, line_q) JOIN b USING (book_id, market), c""")
def w21_company_residual(spark, d):
    q = quotes(spark, d)
    r = q.join(q.groupBy("match_id").agg(F.median("p_home").alias("med")), "match_id").withColumn("r", F.col("p_home") - F.col("med"))
    a = r.groupBy("book_id", "market", "line_q").agg(F.avg("r").alias("xa"), F.count(F.lit(1)).alias("na"))
    b = r.groupBy("book_id", "market").agg(F.avg("r").alias("xb"), F.count(F.lit(1)).alias("nb"))
    c = r.agg(F.avg("r").alias("xc"))
    normal = F.when(F.col("na") >= 400, F.col("xa")).when(F.col("nb") >= 3000, F.col("xb")).otherwise(F.col("xc"))
    return r.join(a, ["book_id", "market", "line_q"]).join(b, ["book_id", "market"]).crossJoin(F.broadcast(c)).select("match_id", "book_id", "source_row", "seq", F.round(F.col("r") - normal, 8).alias("abnormal"))
