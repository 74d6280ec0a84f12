"""Ratings that follow recent evidence: a rolling window rebuilt at every month start, or a monthly filter.

Each season begins from the state that the last one ended in, drifted towards the league's mean; teams that
left are dropped from it and teams that came in get a prior of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ratings import DAY_US, with_time
from .season_ratings import _columns, posterior

SECOND_US = 1_000_000
MONTH_DAYS = 30
FLAT = 1e8  # variance of the first season's mu and home


def _timed(matches: DataFrame) -> DataFrame:
    m = with_time(matches)
    bounds = m.groupBy("competition", "season_start").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return m.join(bounds, ["competition", "season_start"])


def _summed(rows: DataFrame, half_life_days: float) -> DataFrame:
    """Sums per competition, season, cut-off and pair, decayed to the cut-off."""
    w = F.pow(F.lit(0.5), (F.col("cut_us") - F.col("us")) / (DAY_US * half_life_days))
    keys = ("competition", "season_start", "cut_us", "season_end", "home_team", "away_team")
    return rows.groupBy(*keys).agg(F.min("first_us").alias("first_us"), F.count(F.lit(1)).alias("n"), F.sum("home_goals").cast("double").alias("goals_home"), F.sum("away_goals").cast("double").alias("goals_away"), F.sum(w).alias("w"), F.sum(w * F.col("home_goals")).alias("wh"), F.sum(w * F.col("away_goals")).alias("wa"))


def _month(at_us: Column, months: int = 0) -> Column:
    start = F.date_trunc("month", F.timestamp_micros(at_us))
    return start + F.make_interval(months=F.lit(months)) if months else start


def rolling_evidence(matches: DataFrame, days: int, half_life_days: float) -> DataFrame:
    """Sums of the last ``days`` before each month start within a season, and before its end, per pair of teams.

    A match belongs to the few month starts that follow it within the window, so the windows cost a constant
    factor and one aggregation. Columns: competition, season_start, cut_us, season_end, home_team, away_team, first_us, n, goals_home, goals_away, w, wh, wa.
    """
    m = _timed(matches)
    starts = F.sequence(_month(F.col("us"), 1), F.greatest(_month(F.col("us"), 1), _month(F.col("us") + int(days * DAY_US))), F.make_interval(months=F.lit(1)))
    cuts = F.transform(starts, lambda x: F.struct(F.unix_micros(x).alias("cut_us"), F.lit(False).alias("season_end")))
    end = F.struct((F.col("last_us") + SECOND_US).alias("cut_us"), F.lit(True).alias("season_end"))
    rows = m.withColumn("x", F.explode(F.concat(cuts, F.array(end)))).select("*", "x.*")
    return _summed(rows.filter((F.col("us") >= F.col("cut_us") - int(days * DAY_US)) & (F.col("season_end") | (F.col("cut_us") <= F.col("last_us")))), half_life_days)


def monthly_evidence(matches: DataFrame, half_life_days: float) -> DataFrame:
    """The same columns for each calendar month, as of its end."""
    rows = _timed(matches).withColumn("cut_us", F.unix_micros(_month(F.col("us"), 1))).withColumn("season_end", F.col("cut_us") == F.unix_micros(_month(F.col("last_us"), 1)))
    return _summed(rows, half_life_days)


def season_evidence(matches: DataFrame, half_life_days: float) -> DataFrame:
    """The same columns for each whole season."""
    return _summed(_timed(matches).withColumn("cut_us", F.col("last_us") + SECOND_US).withColumn("season_end", F.lit(True)), half_life_days)


class State:
    """Normal beliefs about mu, home, and each team's attack and concession."""

    def __init__(self, teams: list, mean: np.ndarray, cov: np.ndarray):
        self.teams, self.mean, self.cov = teams, mean, cov

    def drifted(self, elapsed: float, half_life_days: float, step_sd: float) -> State:
        """After ``elapsed`` months: team effects fall back towards zero and grow less certain; mu and home stay."""
        keep = np.full(len(self.mean), 2.0 ** (-elapsed * MONTH_DAYS / half_life_days))
        keep[:2] = 1
        grown = np.full(len(self.mean), elapsed * step_sd**2)
        grown[:2] = 0
        return State(self.teams, self.mean * keep, self.cov * np.outer(keep, keep) + np.diag(grown))

    def of(self, teams: list, new_mean: tuple[float, float], new_cov: np.ndarray) -> State:
        """The beliefs about these teams: those that are gone are left out, new ones enter independently."""
        n, m = len(teams), len(self.teams)
        mean, cov = np.zeros(2 + 2 * n), np.zeros((2 + 2 * n,) * 2)
        old = {t: k for k, t in enumerate(self.teams)}
        stay = [k for k, t in enumerate(teams) if t in old]
        to = np.array([0, 1, *(2 + k for k in stay), *(2 + n + k for k in stay)])
        at = np.array([0, 1, *(2 + old[teams[k]] for k in stay), *(2 + m + old[teams[k]] for k in stay)])
        mean[to], cov[np.ix_(to, to)] = self.mean[at], self.cov[np.ix_(at, at)]
        for k in set(range(n)) - set(stay):
            both = [2 + k, 2 + n + k]
            mean[both], cov[np.ix_(both, both)] = new_mean, new_cov
        return State(teams, mean, cov)

    def seen(self, part: pd.DataFrame) -> State:
        at = {t: k for k, t in enumerate(self.teams)}
        home, away = (np.array([at[t] for t in part[c]], np.int64) for c in ("home_team", "away_team"))
        cols = _columns(home, away, len(self.teams))
        return State(self.teams, *posterior(cols, np.tile(part["w"].to_numpy(float), 2), np.concatenate((part["wh"], part["wa"])).astype(float), np.linalg.inv(self.cov), self.mean))


def rolling_ratings(matches: DataFrame, days: int | None, half_life_days: float = 180.0, team_sd: float = 0.35, step_sd: float = 0.1, promoted: tuple[float, float, float] | None = None) -> DataFrame:
    """(competition, season_start, cut, season_end, kind, team, value, variance, origin): each state that a season of a competition goes through.

    ``days``: at every month start with results in the window before it the season's first state is drifted to that day and sees
    the window's results, so no result counts twice and old ones leave; None: a filter that sees each month once. origin of a team:
    START (first season), CARRIED, or NEW (not in the season before), with ``promoted`` (attack, concession, variance), by default the league's mean.
    """
    new_mean = (promoted[0], promoted[1]) if promoted else (0.0, 0.0)
    new_cov = np.eye(2) * (promoted[2] if promoted else team_sd**2)
    types = dict(matches.dtypes)
    parts = rolling_evidence(matches, days, half_life_days) if days else monthly_evidence(matches, half_life_days)
    rows = parts.withColumn("whole", F.lit(False)).unionByName(season_evidence(matches, half_life_days).withColumn("whole", F.lit(True)))
    names = ["competition", "season_start", "cut", "season_end", "kind", "team", "value", "variance", "origin"]

    def run(key, pdf):
        out = []

        def put(season, cut, end, state, origin):
            var, n = np.diag(state.cov), len(state.teams)
            when = pd.Timestamp(int(cut), unit="us")
            for k, kind in enumerate(("mu", "home")):
                out.append((key[0], season, when, end, kind, None, state.mean[k], var[k], None))
            for off, kind in ((2, "attack"), (2 + n, "concession")):
                out.extend((key[0], season, when, end, kind, t, state.mean[off + k], var[off + k], origin[t]) for k, t in enumerate(state.teams))

        state, before = None, set()
        for season, all_ in pdf.sort_values(["season_start", "cut_us", "home_team", "away_team"]).groupby("season_start", sort=True):
            whole = all_[all_["whole"]]
            teams = sorted(set(whole["home_team"]) | set(whole["away_team"]))
            if state is None:
                rate = lambda c, w=whole: max(w[c].sum() / w["w"].sum(), 0.01)
                mean = np.zeros(2 + 2 * len(teams))
                mean[:2] = np.log(rate("wa")), np.log(rate("wh") / rate("wa"))
                state = State(teams, mean, np.diag([FLAT, FLAT] + [team_sd**2] * (2 * len(teams)))).seen(whole)
                put(season, whole["cut_us"].iloc[0], True, state, dict.fromkeys(teams, "START"))
            else:
                first = state = state.drifted(1.0, half_life_days, step_sd).of(teams, new_mean, new_cov)
                origin = {t: "CARRIED" if t in before else "NEW" for t in teams}
                last = None
                for (cut, end), part in all_[~all_["whole"]].groupby(["cut_us", "season_end"], sort=True):
                    if days:
                        elapsed = max(1.0, (cut - part["first_us"].min()) // DAY_US / MONTH_DAYS)
                        state = first.drifted(elapsed, half_life_days, step_sd).seen(part)
                    else:
                        month = pd.Timestamp(int(cut), unit="us")
                        index = month.year * 12 + month.month
                        if last is not None:
                            state = state.drifted(index - last, half_life_days, step_sd)
                        state, last = state.seen(part), index
                    put(season, cut, bool(end), state, origin)
            before = set(teams)
        return pd.DataFrame(out, columns=names, dtype=object).astype({"cut": "datetime64[us]"})

    schema = f"competition {types['competition']}, season_start int, cut timestamp_ntz, season_end boolean, kind string, team {types['home_team']}, value double, variance double, origin string"
    return rows.groupBy("competition").applyInPandas(run, schema)
