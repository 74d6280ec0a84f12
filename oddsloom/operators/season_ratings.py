"""Season-linked ratings, their search over hyper-parameters, and ratings that follow a rolling window.

A fit never sees single matches: within a season all matches of a pair of teams have one design, so Spark sums
them per pair and season, decayed to the season's first day, and any later cut-off only scales these sums.
A group's sums (at most teams squared a season) meet in one task, which solves for the posterior mode
by Newton steps. Effects add up: log rate = mu (+ home) + attack of a team + concession of its opponent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratings import DAY_US, with_time

LOG_RATE = (-10.0, 6.0)  # limits of a log rate while solving


def season_origin() -> Column:
    return F.unix_micros(F.make_timestamp(F.col("season_start"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)))


def pair_seasons(matches: DataFrame, half_lives: DataFrame) -> DataFrame:
    """Sums per competition, half_life, season and pair: n, goals, log factorials, and decayed w, wh, wa as of the season's origin_us.

    ``half_lives`` (competition, half_life) is small: the candidates of a search.
    """
    m = with_time(matches).withColumn("origin_us", season_origin()).join(F.broadcast(half_lives), "competition")
    w = F.pow(F.lit(2.0), (F.col("us") - F.col("origin_us")) / (DAY_US * F.col("half_life")))
    fact = lambda c: F.log(F.factorial(F.col(c).cast("int")).cast("double"))
    sums = {"w": w, "wh": w * F.col("home_goals"), "wa": w * F.col("away_goals"), "gh": F.col("home_goals").cast("double"), "ga": F.col("away_goals").cast("double"), "lf": fact("home_goals") + fact("away_goals")}
    keys = ("competition", "half_life", "season_start", "origin_us", "home_team", "away_team")
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *(F.sum(x).alias(c) for c, x in sums.items()))


def posterior(cols: np.ndarray, weight: np.ndarray, goals: np.ndarray, prior: np.ndarray, mean: np.ndarray, start: np.ndarray | None = None, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Mode and covariance of Poisson counts whose log rates are sums of the parameters ``cols`` (rows, at most 4; -1: none), under a normal prior (mean, precision)."""
    p = len(mean)
    at = np.where(cols < 0, p, cols)
    cells = (at[:, :, None] * (p + 1) + at[:, None, :]).reshape(len(at), -1)

    def look(beta):
        eta = np.clip(np.append(beta, 0.0)[at].sum(axis=1), *LOG_RATE)
        rate = weight * np.exp(eta)
        off = beta - mean
        return rate, float((rate - goals * eta).sum() + 0.5 * off @ prior @ off)

    def curved(rate):
        h = np.bincount(cells.ravel(), weights=np.repeat(rate, cells.shape[1]), minlength=(p + 1) ** 2).reshape(p + 1, p + 1)
        return h[:p, :p] + prior

    beta = (mean if start is None else start).copy()
    rate, value = look(beta)
    for _ in range(steps):
        slope = np.bincount(at.ravel(), weights=np.repeat(rate - goals, at.shape[1]), minlength=p + 1)[:p] + prior @ (beta - mean)
        step = np.linalg.solve(curved(rate), slope)
        scale = 1.0
        while (new := look(beta - scale * step))[1] > value + 1e-12 * abs(value) and scale > 2**-20:
            scale /= 2
        beta = beta - scale * step
        rate, value = new
        if np.abs(scale * step).max() < 1e-9:
            break
    cov = np.linalg.inv(curved(rate))
    return beta, (cov + cov.T) / 2


def _columns(home: np.ndarray, away: np.ndarray, n: int) -> np.ndarray:
    """Parameters of the home and then the away goals of each pair: mu, home, n attacks, n concessions."""
    zero, none = np.zeros(len(home), np.int64), np.full(len(home), -1)
    return np.concatenate((np.stack([zero, zero + 1, 2 + home, 2 + n + away], axis=1), np.stack([zero, none, 2 + away, 2 + n + home], axis=1)))


class Linked:
    """A fit over the states (team, season), those of consecutive seasons of a team linked by a random walk; without ``link_sd`` one state a team."""

    def __init__(self, pairs: pd.DataFrame, scale: np.ndarray, team_sd: float, link_sd: float | None):
        self.team_sd, self.link_sd = team_sd, link_sd
        season = pairs["season_start"].to_numpy() if link_sd is not None else np.zeros(len(pairs), np.int64)
        states = sorted(set(zip(pairs["home_team"], season, strict=True)) | set(zip(pairs["away_team"], season, strict=True)))
        self.at = {x: k for k, x in enumerate(states)}
        n = self.n = len(states)
        prior = np.zeros((2 + 2 * n, 2 + 2 * n))
        prior[[0, 1], [0, 1]] = 1e-6
        for (team, s), k in self.at.items():
            before = self.at.get((team, s - 1)) if link_sd is not None else None
            for off in (2, 2 + n):
                if before is None:
                    prior[off + k, off + k] += 1 / team_sd**2
                else:
                    both = [off + k, off + before]
                    prior[np.ix_(both, both)] += np.array([[1, -1], [-1, 1]]) / link_sd**2
        home, away = (np.array([self.at[x] for x in zip(pairs[c], season, strict=True)]) for c in ("home_team", "away_team"))
        w, wh, wa = (pairs[c].to_numpy(float) * scale for c in ("w", "wh", "wa"))
        start = np.zeros(2 + 2 * n)
        low = lambda x: max(x / max(w.sum(), 1e-300), 1e-3)
        start[:2] = np.log(low(wa.sum())), np.log(low(wh.sum()) / low(wa.sum()))
        self.effective = np.bincount(np.concatenate((home, away)), weights=np.tile(w, 2), minlength=n)
        self.beta, self.cov = posterior(_columns(home, away, n), np.tile(w, 2), np.concatenate((wh, wa)), prior, np.zeros(2 + 2 * n), start)

    def state(self, team, season: int) -> tuple[int | None, float, str]:
        """State of a team in a season, the variance of what it does not know, and where it comes from."""
        if self.link_sd is None:
            season = 1
        for s, var, what in ((season, 0.0, "CURRENT_SEASON"), (season - 1, (self.link_sd or 0.0) ** 2, "PREVIOUS_SEASON")):
            if (team, s) in self.at:
                return self.at[team, s], var, what
        return None, self.team_sd**2, "LEAGUE_BASELINE"

    def fixture(self, home, away, season: int) -> dict:
        """Mean and covariance of a fixture's log rates, by the states of both teams; what is unknown adds its variance to both."""
        (h, vh, how_h), (a, va, how_a) = self.state(home, season), self.state(away, season)
        x = np.zeros((2, len(self.beta)))
        x[:, 0], x[0, 1] = 1, 1
        for k, row in ((h, 0), (a, 1)):
            if k is not None:
                x[row, 2 + k] += 1
                x[1 - row, 2 + self.n + k] += 1
        mean, cov = x @ self.beta, x @ self.cov @ x.T + np.eye(2) * (vh + va)
        return {"m_h": mean[0], "m_a": mean[1], "v_hh": cov[0, 0], "v_ha": cov[0, 1], "v_aa": cov[1, 1], "home_state": how_h, "away_state": how_a}


def _scale(pairs: pd.DataFrame, cut_us: float) -> np.ndarray:
    """What brings sums as of a season's origin to the cut-off."""
    return np.exp2((pairs["origin_us"].to_numpy(float) - cut_us) / (DAY_US * pairs["half_life"].to_numpy(float)))


def linked_ratings(matches: DataFrame, half_life_days: float, team_sd: float = 0.35, link_sd: float = 0.2, least: int = 80) -> DataFrame:
    """(competition, kind, team, season_start, value, variance, effective_matches): the posterior as of each competition's last match.

    kind is mu, home (team and season null), attack or concession. Competitions with fewer than ``least`` matches have no fit.
    """
    half_lives = matches.select("competition").distinct().withColumn("half_life", F.lit(float(half_life_days)))
    types = dict(matches.dtypes)

    def solve(key, pdf):
        if pdf["n"].sum() < least:
            return pd.DataFrame()
        fit = Linked(pdf, _scale(pdf, pdf["last_us"].max()), team_sd, link_sd)
        var = np.diag(fit.cov)
        rows = [(key[0], k, None, None, fit.beta[i], var[i], None) for i, k in enumerate(("mu", "home"))]
        for kind, off in (("attack", 2), ("concession", 2 + fit.n)):
            rows += [(key[0], kind, team, s, fit.beta[off + k], var[off + k], fit.effective[k]) for (team, s), k in fit.at.items()]
        return pd.DataFrame(rows, columns=["competition", "kind", "team", "season_start", "value", "variance", "effective_matches"], dtype=object)

    return pair_seasons(matches, half_lives).groupBy("competition").applyInPandas(solve, f"competition {types['competition']}, kind string, team {types['home_team']}, season_start int, value double, variance double, effective_matches double")


def linked_priors(matches: DataFrame, fixtures: DataFrame, half_life_days: float, team_sd: float = 0.35, link_sd: float = 0.2, least: int = 80) -> DataFrame:
    """match_id, mean and covariance of the log rates of ``fixtures``, and the states they rest on, fitted on ``matches``.

    The distinct fixtures meet their competition's sums where these are solved, so no covariance matrix leaves a task.
    ``matches`` must be earlier than the fixtures.
    """
    half_lives = matches.select("competition").distinct().withColumn("half_life", F.lit(float(half_life_days)))
    types = dict(matches.dtypes)
    asked = fixtures.select(*(F.col(c).alias(f"{c}_") for c in ("competition", "season_start", "home_team", "away_team"))).distinct()
    law = ("m_h", "m_a", "v_hh", "v_ha", "v_aa")

    def solve(key, pairs, wanted):
        names = ["competition", "season_start", "home_team", "away_team", *law, "home_state", "away_state"]
        if not len(wanted) or not len(pairs) or pairs["n"].sum() < least:
            return pd.DataFrame()
        fit = Linked(pairs, _scale(pairs, pairs["last_us"].max()), team_sd, link_sd)
        rows = [{"competition": key[0], "season_start": s, "home_team": h, "away_team": a} | fit.fixture(h, a, s) for s, h, a in zip(wanted["season_start_"], wanted["home_team_"], wanted["away_team_"], strict=True)]
        return pd.DataFrame(rows, columns=names)

    schema = f"competition {types['competition']}, season_start int, home_team {types['home_team']}, away_team {types['away_team']}, " + ", ".join(f"{c} double" for c in law) + ", home_state string, away_state string"
    found = pair_seasons(matches, half_lives).groupBy("competition").cogroup(asked.groupBy("competition_")).applyInPandas(solve, schema)
    keys = ("competition", "season_start", "home_team", "away_team")
    found = found.withColumnsRenamed({c: f"{c}_" for c in keys})
    same = [F.col(c) == F.col(f"{c}_") for c in keys]
    return fixtures.join(found, same).select("match_id", *law, "home_state", "away_state")


def fold_scores(matches: DataFrame, candidates: DataFrame, least: int = 1, clip: bool = False) -> DataFrame:
    """(competition, half_life, team_sd, link_sd, fold, n, nll): goal NLL of each season after the first, fitted on those before.

    ``candidates`` (competition, half_life, team_sd, link_sd; null link: one state a team) share the sums of their half life. A fold is
    fitted as of its first kickoff. Seasons of a competition follow each other; folds behind fewer than ``least`` matches are left out.
    """
    sums = pair_seasons(matches, candidates.select("competition", "half_life").distinct())
    types = dict(matches.dtypes)
    keys = ["competition", "half_life", "team_sd", "link_sd"]

    def score(key, pdf):
        out = []
        link = None if key[3] is None or np.isnan(key[3]) else key[3]
        for fold in sorted(pdf["season_start"].unique())[1:]:
            train, test = pdf[pdf["season_start"] < fold], pdf[pdf["season_start"] == fold]
            if train["n"].sum() < least:
                continue
            fit = Linked(train, _scale(train, test["first_us"].min()), key[2], link)
            b, n = np.append(fit.beta, 0.0), fit.n
            states = [(fit.state(h, fold)[0], fit.state(a, fold)[0]) for h, a in zip(test["home_team"], test["away_team"], strict=True)]
            h, a = (np.array([-1 if s[k] is None else s[k] for s in states]) for k in (0, 1))
            part = lambda k, off: np.where(k < 0, 0.0, b[off + np.maximum(k, 0)])
            eta_h = b[0] + b[1] + part(h, 2) + part(a, 2 + n)
            eta_a = b[0] + part(a, 2) + part(h, 2 + n)
            nll = test["n"] * (np.exp(eta_h) + np.exp(eta_a)) - test["gh"] * eta_h - test["ga"] * eta_a + test["lf"]
            out.append((*key[:3], link, int(fold), int(test["n"].sum()), float(nll.sum()) / 2))
        return pd.DataFrame(out, columns=[*keys, "fold", "n", "nll"], dtype=object)

    fits = sums.join(F.broadcast(candidates), ["competition", "half_life"]).groupBy(*keys)
    return fits.applyInPandas(score, f"competition {types['competition']}, half_life double, team_sd double, link_sd double, fold int, n long, nll double")


def search(matches: DataFrame, half_lives: list[float], team_sds: list[float], link_sds: list[float], hold_out: int = 2, least: int = 80) -> DataFrame:
    """Each competition's grid with mean goal NLL over its training seasons' folds, best (ties: more matches) and at_edge of the grid.

    The last ``hold_out`` seasons of a competition are never seen.
    """
    one = matches.select("competition").distinct()
    grid = one.select("competition", F.explode(F.array(*map(F.lit, half_lives))).alias("half_life"))
    grid = grid.withColumn("team_sd", F.explode(F.array(*map(F.lit, team_sds)))).withColumn("link_sd", F.explode(F.array(*map(F.lit, link_sds))))
    return best_of(fold_scores(training(matches, hold_out), grid, least), {"half_life": half_lives, "team_sd": team_sds, "link_sd": link_sds})


def training(matches: DataFrame, hold_out: int) -> DataFrame:
    """``matches`` without the last seasons of each competition."""
    seasons = matches.select("competition", "season_start").distinct()
    late = F.row_number().over(Window.partitionBy("competition").orderBy(F.desc("season_start")))
    return matches.join(F.broadcast(seasons.withColumn("late", late).filter(F.col("late") > hold_out).select("competition", "season_start")), ["competition", "season_start"])


def best_of(folds: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    names = list(values)
    rows = folds.groupBy("competition", *names).agg((F.sum("nll") / F.sum("n")).alias("goal_nll"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("folds"))
    rank = F.row_number().over(Window.partitionBy("competition").orderBy("goal_nll", F.desc("n"), *names))
    edge = F.lit(False)
    for c, v in values.items():
        if len(v) > 1:
            edge = edge | F.col(c).isin(min(v), max(v))
    return rows.withColumn("best", rank == 1).withColumn("at_edge", F.col("best") & edge)


def coordinate_search(matches: DataFrame, half_lives: list[float], team_sds: list[float], link_sds: list[float], hold_out: int = 2, least: int = 80) -> DataFrame:
    """(competition, half_life, team_sd, link_sd, goal_nll, n, folds, at_edge): the best of a search along one parameter after the other.

    It starts in the middle of each list; after a parameter's list come the geometric means of its best value and the neighbours.
    Two jobs a parameter for all competitions together, whose bests stay in the data.
    """
    values = {"half_life": sorted(half_lives), "team_sd": sorted(team_sds), "link_sd": sorted(link_sds)}
    train = training(matches, hold_out)
    best = train.select("competition").distinct().select("competition", *(F.lit(float(v[len(v) // 2])).alias(c) for c, v in values.items()))
    for c, v in values.items():
        for refine in (False, True):
            tried = F.array(*map(F.lit, v))
            if refine:
                own = F.col(c)
                below, above = F.array_max(F.filter(tried, lambda x: x < own)), F.array_min(F.filter(tried, lambda x: x > own))
                tried = F.array_compact(F.array(F.col(c), F.sqrt(F.col(c) * below), F.sqrt(F.col(c) * above)))
            grid = best.select("competition", *(F.explode(tried).alias(c) if x == c else F.col(x) for x in values))
            found = best_of(fold_scores(train, grid, least), values).filter("best")
            best = found.select("competition", *values)
    return found.select("competition", *values, "goal_nll", "n", "folds", "at_edge")
