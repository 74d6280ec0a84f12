"""Strictly-past histories: cumulative windows that end one microsecond before the target's kickoff.

Matches with the same kickoff never see each other. One window per league or team takes the place of
a scan of all history for every target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000.0


def with_time(matches: DataFrame) -> DataFrame:
    return matches.withColumn("us", F.unix_micros(F.col("kickoff").cast("timestamp")))


def past(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)


def team_view(matches: DataFrame) -> DataFrame:
    """Two rows per match: team, opponent, venue, gf, ga."""
    side = lambda v, t, o, f, a: F.struct(F.lit(v).alias("venue"), F.col(t).alias("team"), F.col(o).alias("opponent"), F.col(f).alias("gf"), F.col(a).alias("ga"))
    both = F.array(side("home", "home_team", "away_team", "home_goals", "away_goals"), side("away", "away_team", "home_team", "away_goals", "home_goals"))
    return matches.withColumn("x", F.explode(both)).select("match_id", "us", "competition", "season_start", "x.*")


def decayed_past_sum(value: Column, keys: list[str], half_life_days: float) -> Column:
    """Sum of value * 0.5^(age / half life) over strictly earlier rows, as a scaled cumulative sum.

    Times count from the partition's first row, so the factors stay within double range for histories of
    up to about a thousand half lives.
    """
    origin = F.min("us").over(Window.partitionBy(*keys))
    t = (F.col("us") - origin) / (DAY_US * half_life_days)
    return F.sum(value * F.pow(F.lit(2.0), t)).over(past(*keys)) * F.pow(F.lit(2.0), -t)


def with_past(m: DataFrame, keys: list[str], sums: dict[str, Column], half_life_days: float | None = None) -> DataFrame:
    """``m`` (with us) with the sum of each of ``sums`` over the rows of its keys that are strictly earlier, 0 if there are none; decayed to the row's time if asked.

    In two levels: sums per day, a cumulative window over the days of a key, and one over the rows of a day. So no task holds
    more than a key's calendar or one of its days. Decay within double range holds for some thousand half lives.
    """
    day, u = F.floor(F.col("us") / DAY_US), F.pmod(F.col("us"), F.lit(int(DAY_US))) / DAY_US
    up = F.pow(F.lit(2.0), F.col("u_") / half_life_days) if half_life_days else F.lit(1.0)
    rows = m.withColumns({"day_": day, "u_": u})
    full = F.pow(F.lit(2.0), F.lit(1.0 / half_life_days)) if half_life_days else F.lit(1.0)  # what a day's start counts less than its end
    daily = rows.groupBy(*keys, "day_").agg(*(F.sum(c * up / full if half_life_days else c).alias(f"{n}_d") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    if half_life_days:
        since = F.min("day_").over(Window.partitionBy(*keys))
        at = lambda k: F.pow(F.lit(2.0), (F.col("day_") - since + k) / half_life_days)
        cum = {f"{n}_c": F.sum(F.col(f"{n}_d") * F.col("at_")).over(before) / F.col("now_") for n in sums}
        daily = daily.withColumns({"at_": at(1), "now_": at(0)}).withColumns(cum)
    else:
        daily = daily.withColumns({f"{n}_c": F.sum(f"{n}_d").over(before) for n in sums})
    inside = Window.partitionBy(*keys, "day_").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    j = rows.join(daily.select(*keys, "day_", *(f"{n}_c" for n in sums)), [*keys, "day_"])
    both = lambda n, c: (F.coalesce(f"{n}_c", F.lit(0)) + F.coalesce(F.sum(c * up if half_life_days else c).over(inside), F.lit(0))) / up
    out = j.withColumns({n: both(n, c) if half_life_days else F.coalesce(f"{n}_c", F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return out.drop("day_", "u_", *(f"{n}_c" for n in sums))


def shrunk(total: Column, games: Column, baseline: Column, pseudo: float) -> Column:
    return (total + pseudo * baseline) / F.greatest(games + pseudo, F.lit(1e-12))


def last_n_mean(value: str, keys: list[str], n: int) -> Column:
    """Mean of the last n rows with an earlier kickoff: the mean of n rows up to each row, taken from the last earlier row."""
    tail = F.avg(value).over(Window.partitionBy(*keys).orderBy("us", "match_id").rowsBetween(1 - n, 0))
    return F.max(F.struct("us", "match_id", tail.alias("mean"))).over(past(*keys))["mean"]


def baseline_snapshots(matches: DataFrame, half_life_days: float | None = None, seasons: int | None = None) -> DataFrame:
    """League home and away goal rates known before every match: over all history, the last ``seasons``, or decayed."""
    m = with_time(matches)
    sums = {"games": F.lit(1.0), "hg": F.col("home_goals").cast("double"), "ag": F.col("away_goals").cast("double")}
    if half_life_days or not seasons:
        m = with_past(m, ["competition"], sums, half_life_days)
    else:
        # a target's season so far and the whole ones before it, joined at the target
        m = with_past(m, ["competition", "season_start"], sums)
        totals = matches.groupBy("competition", "season_start").agg(F.count(F.lit(1)).alias("g0"), F.sum("home_goals").alias("h0"), F.sum("away_goals").alias("a0"))
        for back in range(1, seasons):
            t = totals.select("competition", (F.col("season_start") + back).alias("season_start"), *(F.col(c).alias(f"{c}_{back}") for c in ("g0", "h0", "a0")))
            m = m.join(t, ["competition", "season_start"], "left")
            for c, s in (("games", "g0"), ("hg", "h0"), ("ag", "a0")):
                m = m.withColumn(c, F.col(c) + F.coalesce(f"{s}_{back}", F.lit(0)))
    ok = F.col("games") > 0
    return m.select("match_id", F.when(ok, F.col("hg") / F.col("games")).alias("home_rate"), F.when(ok, F.col("ag") / F.col("games")).alias("away_rate"))


def team_strengths(matches: DataFrame, pseudo: float = 5.0) -> DataFrame:
    """Per match and venue: the team's shrunk scoring and conceding rates at that venue over the league's, before kickoff."""
    base = baseline_snapshots(matches)
    t = team_view(with_time(matches))
    w = past("competition", "team", "venue")
    t = t.withColumns({"n": F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)), "sf": F.coalesce(F.sum("gf").over(w), F.lit(0)), "sa": F.coalesce(F.sum("ga").over(w), F.lit(0))}).join(base, "match_id")
    own, other = (F.when(F.col("venue") == "home", F.col(a)).otherwise(F.col(b)) for a, b in (("home_rate", "away_rate"), ("away_rate", "home_rate")))
    attack = shrunk(F.col("sf"), F.col("n"), own, pseudo) / F.nullif(own, F.lit(0.0))
    concede = shrunk(F.col("sa"), F.col("n"), other, pseudo) / F.nullif(other, F.lit(0.0))
    return t.select("match_id", "venue", "team", attack.alias("attack"), concede.alias("concede"), "home_rate", "away_rate")


def matchup_rates(matches: DataFrame, pseudo: float = 5.0) -> DataFrame:
    """lambda_home and lambda_away: league rate x attack x the opponent's concession, clipped to [0.05, 6]; unknown factors are 1."""
    s = team_strengths(matches, pseudo)
    h = s.filter("venue = 'home'").select("match_id", "home_rate", "away_rate", F.col("attack").alias("ha"), F.col("concede").alias("hc"))
    a = s.filter("venue = 'away'").select("match_id", F.col("attack").alias("aa"), F.col("concede").alias("ac"))
    one = lambda c: F.coalesce(c, F.lit(1.0))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.05)), F.lit(6.0))
    j = h.join(a, "match_id")
    return j.select("match_id", clip(F.col("home_rate") * one("ha") * one("ac")).alias("lambda_home"), clip(F.col("away_rate") * one("aa") * one("hc")).alias("lambda_away"))


def fit_ratings(matches: DataFrame, half_life_days: float, team_sd: float = 0.35, steps: int = 8, keys: tuple[str, ...] = ("competition",)) -> DataFrame:
    """Time-decayed penalised Poisson ratings per group: (keys, param, value), params mu, home, att:<team>, def:<team>.

    The rows of a group reach one task only as sums over (home team, away team): at most teams squared
    rows, whatever the number of matches, since all matches of a pair share their design vector.
    """
    import numpy as np
    import pandas as pd

    m = with_time(matches)
    last = F.max("us").over(Window.partitionBy(*keys))
    weight = F.pow(F.lit(0.5), (last - F.col("us")) / (DAY_US * half_life_days))
    pairs = m.withColumn("w", weight).groupBy(*keys, "home_team", "away_team").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("wh"), F.sum(F.col("w") * F.col("away_goals")).alias("wa"))

    def solve(key, pdf):
        teams = np.unique(np.concatenate((pdf["home_team"], pdf["away_team"])))
        n = len(teams)
        h, a = np.searchsorted(teams, pdf["home_team"]), np.searchsorted(teams, pdf["away_team"])
        x = np.zeros((2 * len(pdf), 2 + 2 * n))
        k = np.arange(len(pdf))
        x[:, 0] = 1
        x[k, 1] = 1
        x[k, 2 + h] = x[k, 2 + n + a] = 1
        x[len(pdf) + k, 2 + a] = x[len(pdf) + k, 2 + n + h] = 1
        w = np.tile(pdf["w"].to_numpy(), 2)
        y = np.concatenate((pdf["wh"], pdf["wa"]))
        penalty = np.diag([1e-6, 1e-6] + [1 / team_sd**2] * (2 * n))
        beta = np.zeros(x.shape[1])
        beta[0] = np.log(max(y.sum() / max(w.sum(), 1e-12), 1e-3))
        for _ in range(steps):
            rate = np.exp(np.clip(x @ beta, -6, 4))
            grad = x.T @ (y - w * rate) - penalty @ beta
            beta = beta + np.linalg.solve(x.T @ (x * (w * rate)[:, None]) + penalty, grad)
        names = ["mu", "home", *(f"att:{t}" for t in teams), *(f"def:{t}" for t in teams)]
        return pd.DataFrame({**{c: [v] * len(names) for c, v in zip(keys, key, strict=True)}, "param": names, "value": beta})

    types = dict(matches.dtypes)
    return pairs.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {types[c]}" for c in keys) + ", param string, value double")
