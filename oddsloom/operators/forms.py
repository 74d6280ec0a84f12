"""Recent form, fixture priors from fitted ratings, monthly dynamic ratings and context updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratings import DAY_US, past, team_view, with_past, with_time


def league_rates(matches: DataFrame, pseudo: float = 5.0, home: float = 1.35, away: float = 1.10) -> DataFrame:
    """Shrunk league goal rates known before each match."""
    at = league_rates_at(with_time(matches), pseudo, home, away)
    return with_time(matches).select("match_id", "competition", "us").join(at, ["competition", "us"]).select("match_id", "lh", "la")


def league_rates_at(timed: DataFrame, pseudo: float = 5.0, home: float = 1.35, away: float = 1.10) -> DataFrame:
    """(competition, us, lh, la): the same rates once a kickoff of a competition, as its matches share them."""
    at = timed.groupBy("competition", "us").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("h"), F.sum("away_goals").alias("a"))
    m = with_past(at, ["competition"], {f"{c}_": F.col(c).cast("double") for c in "nha"})
    rate = lambda c, b: (F.col(c) + pseudo * b) / (F.col("n_") + pseudo)
    return m.select("competition", "us", rate("h_", home).alias("lh"), rate("a_", away).alias("la"))


def recent_form(matches: DataFrame, window: int = 10, half_life_days: float = 90.0, shrinkage: float = 4.0, cross_season: float = 0.45) -> DataFrame:
    """Per match and venue: log attack and log concession of the team's recent venue games, effective games and the fallback flag.

    History is all of the team's strictly earlier games; the last ``window`` at the venue count (all venues if
    there are none there), decayed and weighted down across seasons. Each game is adjusted by what the
    opponent gave and took in the games that are in this same history.
    """
    timed = with_time(matches).filter("us IS NOT NULL")
    games = team_view(timed)
    # all matches of a team at a venue, competition and season with one kickoff have one form: it is worked out once for them
    t = games.select("team", "venue", "us", "competition", "season_start").distinct().join(league_rates_at(timed), ["competition", "us"])
    game = F.struct("us", "match_id", "season_start", "opponent", "gf", "ga")

    def latest(keys: list[str], name: str) -> DataFrame:
        """(keys, us, name): the last ``window`` games of the keys before each of their kickoffs, out of the last ones of each of ``window`` kickoffs."""
        late = F.row_number().over(Window.partitionBy(*keys, "us").orderBy(F.desc("match_id")))
        own = games.withColumn("late", late).filter(F.col("late") <= window).groupBy(*keys, "us").agg(F.array_sort(F.collect_list(game)).alias("own"))
        tail = F.flatten(F.collect_list("own").over(Window.partitionBy(*keys).orderBy("us").rowsBetween(-window, -1)))
        own = own.withColumn("tail", tail)
        return own.select(*keys, "us", F.when(F.size("tail") > 0, F.slice("tail", F.greatest(F.size("tail") - window + 1, F.lit(1)), F.lit(window))).alias(name))

    t = t.join(latest(["team", "venue"], "here"), ["team", "venue", "us"]).join(latest(["team"], "anywhere"), ["team", "us"])
    t = t.withColumn("fallback", F.col("here").isNull()).withColumn("source", F.coalesce("here", "anywhere"))
    # what the team and each of those opponents gave and took before the kickoff: running sums per pair, read off there
    pair = Window.partitionBy("team", "opponent").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    facts = games.groupBy("team", "opponent", "us").agg(F.count(F.lit(1)).alias("one"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.lit(False).alias("ask"))
    asks = t.select("team", F.explode("source.opponent").alias("opponent"), "us").distinct()
    asks = asks.select("*", *(F.lit(None).cast("long").alias(c) for c in ("one", "gf", "ga")), F.lit(True).alias("ask"))
    sums = facts.unionByName(asks).select("team", "opponent", "us", "ask", *(F.coalesce(F.sum(c).over(pair), F.lit(0)).cast("double").alias(n) for c, n in (("one", "n"), ("gf", "f"), ("ga", "a"))))
    met = sums.filter("ask").groupBy("team", "us").agg(F.map_from_entries(F.collect_list(F.struct("opponent", F.struct("n", "f", "a")))).alias("met"))
    t = t.join(met, ["team", "us"], "left")
    home = F.col("venue") == "home"
    t = t.withColumns({"ba": F.when(home, F.col("lh")).otherwise(F.col("la")), "bd": F.when(home, F.col("la")).otherwise(F.col("lh"))})
    low = lambda x: F.greatest(F.lit(0.2), x)

    def score(e: Column) -> Column:
        m = F.try_element_at("met", e["opponent"])
        gave = (m["f"] + shrinkage * F.col("la")) / (m["n"] + shrinkage)
        took = (m["a"] + shrinkage * F.col("lh")) / (m["n"] + shrinkage)
        age = F.greatest(F.lit(0.0), (F.col("us") - e["us"]) / DAY_US)
        w = F.pow(F.lit(0.5), age / half_life_days) * F.when(e["season_start"] == F.col("season_start"), 1.0).otherwise(cross_season)
        return F.struct((w * e["gf"] / low(gave / low(F.col("la")))).alias("a"), (w * e["ga"] / low(took / low(F.col("lh")))).alias("d"), w.alias("w"))

    t = t.withColumn("scores", F.transform("source", score))
    part = lambda f: F.coalesce(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x[f]), F.lit(0.0))
    n = part("w")
    log = lambda f, b: F.when(F.col("source").isNull(), 0.0).otherwise(F.log(low((part(f) + shrinkage * F.col(b)) / (n + shrinkage) / F.col(b))))
    keys = ("team", "venue", "us", "competition", "season_start")
    form = t.select(*(F.col(c).alias(f"{c}_of") for c in keys), log("a", "ba").alias("attack"), log("d", "bd").alias("defence"), n.alias("effective_games"), "fallback")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return games.join(form, same).select("match_id", "venue", "team", "attack", "defence", "effective_games", "fallback")


def history_shrinkage(matches: DataFrame, equivalent: float = 10.0) -> DataFrame:
    """League rates of the current season shrunk to earlier seasons, worth ``equivalent`` games, before each match."""
    sums = {"g": F.lit(1.0), "h": F.col("home_goals").cast("double"), "a": F.col("away_goals").cast("double")}
    m = with_past(with_time(matches), ["competition"], {f"{n}_all": c for n, c in sums.items()})
    m = with_past(m, ["competition", "season_start"], {f"{n}_now": c for n, c in sums.items()}).filter("g_all > 0")
    before = F.col("g_all") - F.col("g_now")

    def rate(n: str) -> Column:
        whole = F.col(f"{n}_all") / F.col("g_all")
        history = F.when(before > 0, (F.col(f"{n}_all") - F.col(f"{n}_now")) / F.nullif(before, F.lit(0.0))).otherwise(whole)
        return F.when(F.col("g_now") > 0, (F.col(f"{n}_now") + equivalent * history) / (F.col("g_now") + equivalent)).otherwise(whole)

    return m.select("match_id", rate("h").alias("home_rate"), rate("a").alias("away_rate"))


def rating_posteriors(matches: DataFrame, until: str, half_life_days: float, team_sd: float = 0.35) -> DataFrame:
    """Per competition a map param -> (value, position, covariance row) fitted on matches before ``until``."""
    m = with_time(matches.filter(F.col("kickoff") < F.lit(until).cast("timestamp_ntz")))
    cut = F.unix_micros(F.lit(until).cast("timestamp"))
    w = F.pow(F.lit(0.5), (cut - F.col("us")) / (DAY_US * half_life_days))
    pairs = m.withColumn("w", w).groupBy("competition", "home_team", "away_team").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("wh"), F.sum(F.col("w") * F.col("away_goals")).alias("wa"))

    return _posterior_maps(pairs, ["competition"], team_sd)


def monthly_posteriors(matches: DataFrame, half_life_days: float, team_sd: float = 0.35, least: int = 80) -> DataFrame:
    """``rating_posteriors`` of every competition and month with matches, fitted on what was played before the month.

    month_us is the start of the month, from which ages count. Months behind fewer than ``least`` earlier matches
    have no fit. Matches are summed per pair of teams and month first, so what meets the cut-offs does not grow
    with the number of matches.
    """
    m = with_month(with_time(matches))
    w = F.pow(F.lit(0.5), (F.col("month_us") - F.col("us")) / (DAY_US * half_life_days))
    sums = m.withColumn("w", w).groupBy("competition", F.col("month_us").alias("own_us"), "home_team", "away_team").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("wh"), F.sum(F.col("w") * F.col("away_goals")).alias("wa"))
    months = m.groupBy("competition", "month_us").agg(F.count(F.lit(1)).alias("games"))
    before = Window.partitionBy("competition").orderBy("month_us").rowsBetween(Window.unboundedPreceding, -1)
    cuts = months.withColumn("before", F.sum("games").over(before)).filter(F.col("before") >= least).select("competition", "month_us")
    scale = F.pow(F.lit(0.5), (F.col("month_us") - F.col("own_us")) / (DAY_US * half_life_days))
    past_ = sums.join(cuts, "competition").filter("own_us < month_us").withColumn("scale", scale)
    pairs = past_.groupBy("competition", "month_us", "home_team", "away_team").agg(*(F.sum(F.col(c) * F.col("scale")).alias(c) for c in ("w", "wh", "wa")))
    return _posterior_maps(pairs, ["competition", "month_us"], team_sd)


def with_month(matches: DataFrame) -> DataFrame:
    return matches.withColumn("month_us", F.unix_micros(F.date_trunc("month", F.timestamp_micros("us"))))


def _posterior_maps(pairs: DataFrame, keys: list[str], team_sd: float) -> DataFrame:
    """Per group a map param -> (value, position, covariance row), from weighted sums (w, wh, wa) per pair of teams."""
    import numpy as np
    import pandas as pd

    def solve(key, pdf):
        teams = np.unique(np.concatenate((pdf["home_team"], pdf["away_team"])))
        x, weight, goals = design(pdf, teams)
        beta, precision = newton(x, weight, goals, np.diag([1e-6, 1e-6] + [1 / team_sd**2] * (2 * len(teams))))
        cov = np.linalg.inv(precision)
        names = ["mu", "home", *(f"att:{t}" for t in teams), *(f"def:{t}" for t in teams)]
        return pd.DataFrame({**{c: [v] * len(names) for c, v in zip(keys, key, strict=True)}, "param": names, "value": beta, "at": range(len(names)), "cov": list(cov)})

    types = dict(pairs.dtypes)
    rows = pairs.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {types[c]}" for c in keys) + ", param string, value double, at int, cov array<double>")
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("value", "at", "cov")))).alias("r"))


def design(pdf, teams):
    """Rows of the log-rate model for home and away goals of each pair, with weights and weighted goals."""
    import numpy as np

    n, k = len(teams), np.arange(len(pdf))
    h, a = np.searchsorted(teams, pdf["home_team"]), np.searchsorted(teams, pdf["away_team"])
    x = np.zeros((2 * len(pdf), 2 + 2 * n))
    x[:, 0] = 1
    x[k, 1] = x[k, 2 + h] = x[k, 2 + n + a] = 1
    x[len(pdf) + k, 2 + a] = x[len(pdf) + k, 2 + n + h] = 1
    return x, np.tile(pdf["w"].to_numpy(float), 2), np.concatenate((pdf["wh"], pdf["wa"])).astype(float)


def newton(x, weight, goals, prior, mean=None, steps: int = 10):
    """Posterior mode and precision of a Poisson log-linear model with a normal prior (mean, precision)."""
    import numpy as np

    mean = np.zeros(x.shape[1]) if mean is None else mean
    beta = mean.copy()
    if not beta.any() and weight.sum():
        beta[0] = np.log(max(goals.sum() / weight.sum(), 1e-3))
    for _ in range(steps):
        rate = weight * np.exp(np.clip(x @ beta, -6, 4))
        precision = x.T @ (x * rate[:, None]) + prior
        beta = beta + np.linalg.solve(precision, x.T @ (goals - rate) - prior @ (beta - mean))
    return beta, precision


def fixture_priors(fixtures: DataFrame, posteriors: DataFrame, new_team_var: float = 0.25, on: tuple[str, ...] = ("competition",)) -> DataFrame:
    """mean and covariance of the log rates of each fixture: sums over at most four parameters each; unknown teams add variance.

    They are worked out once for all fixtures of two teams under one posterior, whose covariances thus meet no single match.
    """
    keys = [*on, "home_team", "away_team"]
    j = fixtures.select(*keys).distinct().join(posteriors, list(on))
    name = lambda k, t: F.concat(F.lit(k), F.col(t).cast("string"))
    home = [F.lit("mu"), F.lit("home"), name("att:", "home_team"), name("def:", "away_team")]
    away = [F.lit("mu"), name("att:", "away_team"), name("def:", "home_team")]
    get = lambda p: F.try_element_at("r", p)
    value = lambda ps: sum((F.coalesce(get(p)["value"], F.lit(0.0)) for p in ps), F.lit(0.0))
    cov = lambda ps, qs: sum((F.coalesce(F.get(get(p)["cov"], get(q)["at"]), F.lit(0.0)) for p in ps for q in qs), F.lit(0.0))
    lost = lambda ps: sum((F.when(get(p).isNull(), new_team_var).otherwise(0.0) for p in ps), F.lit(0.0))
    law = j.select(*(F.col(c).alias(f"{c}_of") for c in keys), value(home).alias("m_h"), value(away).alias("m_a"), (cov(home, home) + lost(home)).alias("v_hh"), cov(home, away).alias("v_ha"), (cov(away, away) + lost(away)).alias("v_aa"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"{c}_of") if c in on else F.col(c).eqNullSafe(F.col(f"{c}_of")))
    return fixtures.join(law, same).select("match_id", "m_h", "m_a", "v_hh", "v_ha", "v_aa")


def dynamic_ratings(matches: DataFrame, step_var: float = 0.002, start_var: float = 0.12) -> DataFrame:
    """(competition, month, param, value, variance) after each month of a random-walk filter over team strengths.

    A competition's months reach its task as sums per pair of teams: bounded by teams squared a month.
    New teams enter with the start variance.
    """
    import numpy as np
    import pandas as pd

    pairs = matches.withColumn("month", F.date_trunc("month", "kickoff").cast("date")).groupBy("competition", "month", "home_team", "away_team").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("home_goals").cast("double").alias("wh"), F.sum("away_goals").cast("double").alias("wa"))

    def run(key, pdf):
        teams = np.unique(np.concatenate((pdf["home_team"], pdf["away_team"])))
        p = 2 + 2 * len(teams)
        mean, cov = np.zeros(p), np.diag([1.0, 0.1] + [start_var] * (2 * len(teams)))
        names = ["mu", "home", *(f"att:{t}" for t in teams), *(f"def:{t}" for t in teams)]
        out = []
        for month, part in pdf.sort_values(["month", "home_team", "away_team"]).groupby("month", sort=True):
            cov = cov + step_var * np.eye(p)
            mean, precision = newton(*design(part, teams), np.linalg.inv(cov), mean)
            cov = np.linalg.inv(precision)
            out.append(pd.DataFrame({"competition": key[0], "month": month, "param": names, "value": mean, "variance": np.diag(cov)}))
        return pd.concat(out)

    return pairs.groupBy("competition").applyInPandas(run, "competition string, month date, param string, value double, variance double")


def dynamic_fixture_priors(matches: DataFrame, states: DataFrame, trust: float = 1.0, process_var: float = 0.01) -> DataFrame:
    """Log-rate means and variances of each match from the state of the last month before its own; the variance grows by kappa."""
    byc = states.groupBy("competition", "month").agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("value", "variance")))).alias("r"))
    w = Window.partitionBy("competition").orderBy("month")
    byc = byc.withColumn("until", F.coalesce(F.lead("month").over(w), F.lit("9999-12-01").cast("date")))
    m = matches.withColumn("own", F.date_trunc("month", "kickoff").cast("date"))
    j = m.join(byc, (m.competition == byc.competition) & (F.col("own") > F.col("month")) & (F.col("own") <= F.col("until")))
    get = lambda k, t: F.try_element_at("r", F.concat(F.lit(k), F.col(t).cast("string")))
    h = [F.col("r")["mu"], F.col("r")["home"], get("att:", "home_team"), get("def:", "away_team")]
    a = [F.col("r")["mu"], get("att:", "away_team"), get("def:", "home_team")]
    total = lambda ps, f: sum((F.coalesce(p[f], F.lit(0.0)) for p in ps), F.lit(0.0))
    return j.select("match_id", total(h, "value").alias("m_h"), total(a, "value").alias("m_a"), (trust * (total(h, "variance") + process_var)).alias("v_h"), (trust * (total(a, "variance") + process_var)).alias("v_a"))


def context_updates(priors: DataFrame, updates: DataFrame) -> DataFrame:
    """Posterior (m, v) of a log rate per match from updates (match_id, seq, kind, shift, var, fraction, inflate, status).

    Accepted mean updates add precision, which is a sum in any order; accepted inflations multiply the
    variance in sequence first. Rejected ones change nothing and are counted.
    """
    ok = F.col("status") == "VALIDATED"
    g = updates.groupBy("match_id").agg(
        F.sum(F.when(ok & (F.col("kind") == "mean"), F.col("fraction") / F.col("var")).otherwise(0.0)).alias("add"),
        F.sum(F.when(ok & (F.col("kind") == "mean"), F.col("fraction") / F.col("var") * F.col("shift")).otherwise(0.0)).alias("pull"),
        F.array_sort(F.collect_list(F.when(ok & (F.col("kind") == "inflate"), F.struct("seq", "inflate")))).alias("grow"),
        F.count_if(~ok).alias("rejected"),
    )
    j = priors.join(g, "match_id", "left").fillna({"add": 0.0, "pull": 0.0, "rejected": 0})
    v = F.aggregate(F.coalesce("grow", F.array().cast("array<struct<seq:int,inflate:double>>")), F.col("v"), lambda a, x: a * (1 + x["inflate"]))
    j = j.withColumn("v0", v)
    post = 1 / (1 / F.col("v0") + F.col("add"))
    return j.select("match_id", (post * (F.col("m") / F.col("v0") + F.col("add") * F.col("m") + F.col("pull"))).alias("m"), post.alias("v"), "rejected")
