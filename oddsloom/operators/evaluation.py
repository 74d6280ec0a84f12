"""Forecast evaluation: proper scores, calibration, bootstrap and placebo comparisons, effects and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibration_bins(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin [lo, hi) (the last closed), n, mean forecast and observed rate; empty bins are left out."""
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def poisson_weight(*key: Column) -> Column:
    """A Poisson(1) weight from the hash of the key columns: 0 .. 6 by inverted cumulative probabilities."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    out, total, term = None, 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        out = F.when(u < total, k) if out is None else out.when(u < total, k)
        term /= k + 1
    return out.otherwise(7)


def paired_bootstrap(rows: DataFrame, id_: str, delta: str, replicates: int, seed: int, blocks: int = 4096) -> DataFrame:
    """Mean delta and its 95 % interval over ``replicates`` resamples by Poisson weights of the hash blocks of the ids.

    Rows are summed per block first, so what meets the replicates is bounded whatever the number of rows; up to
    a few thousand rows most blocks hold one row.
    """
    reps = F.broadcast(rows.sparkSession.range(replicates).withColumnRenamed("id", "rep"))
    block = F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(blocks))
    parts = rows.groupBy(block.alias("block")).agg(F.sum(delta).alias("d"), F.count(delta).alias("k"))
    w = poisson_weight(F.col("block"), F.col("rep"), F.lit(seed))
    sums = parts.crossJoin(reps).groupBy("rep").agg((F.sum(w * F.col("d")) / F.sum(w * F.col("k"))).alias("m"))
    ci = sums.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean")).crossJoin(ci.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


def permuted(rows: DataFrame, id_: str, column: str, seed: int, by: list[str]) -> DataFrame:
    """``column`` dealt anew among the rows of each ``by`` group in the order of a seeded hash."""
    a = rows.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(id_)))
    b = rows.select(*by, F.col(column).alias("perm_"), F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_)).alias("k_"))
    return a.drop(column).join(b, [*by, "k_"]).withColumnRenamed("perm_", column).drop("k_")


def within_effect(rows: DataFrame, y: str, x: str, unit: str, cluster: str) -> DataFrame:
    """Effect of x on y with unit means removed, and its cluster-robust standard error."""
    w = Window.partitionBy(unit)
    d = rows.withColumn("yd", F.col(y) - F.avg(y).over(w)).withColumn("xd", F.col(x) - F.avg(x).over(w))
    beta = d.agg((F.sum(F.col("xd") * F.col("yd")) / F.sum(F.col("xd") * F.col("xd"))).alias("beta"), F.sum(F.col("xd") * F.col("xd")).alias("sxx"))
    s = d.crossJoin(F.broadcast(beta)).groupBy(cluster, "beta", "sxx").agg(F.sum(F.col("xd") * (F.col("yd") - F.col("beta") * F.col("xd"))).alias("u"))
    return s.groupBy("beta", "sxx").agg(F.sum(F.col("u") * F.col("u")).alias("meat"), F.count(F.lit(1)).alias("clusters")).select(F.col("beta").alias("effect"), (F.sqrt("meat") / F.col("sxx")).alias("se"), "clusters")


def two_way_effect(rows: DataFrame, y: str, x: str, unit: str, first: str, second: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Effect of x on y with unit means removed, and its errors clustered by ``first``, by ``second`` and by both, per group of ``by``.

    Both ways: the variance by ``first`` plus that by ``second`` less that by their intersection. Cells of the intersection carry two sums,
    from which effect and scores follow, so the rows are read once for the unit means and once for the cells.
    """
    by = list(by)
    means = rows.groupBy(*by, unit).agg(F.avg(y).alias("y_"), F.avg(x).alias("x_"))
    d = rows.join(means, [*by, unit]).withColumns({"yd": F.col(y) - F.col("y_"), "xd": F.col(x) - F.col("x_")})
    cells = d.groupBy(*by, first, second).agg(F.sum(F.col("xd") * F.col("yd")).alias("sxy"), F.sum(F.col("xd") * F.col("xd")).alias("sxx"), F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg((F.sum("sxy") / F.nullif(F.sum("sxx"), F.lit(0.0))).alias("effect"), F.sum("sxx").alias("all_xx"), F.sum("n").alias("n"))
    scored = (cells.drop("n").join(total, by) if by else cells.drop("n").crossJoin(F.broadcast(total))).withColumn("score_", F.col("sxy") - F.col("effect") * F.col("sxx"))
    keep = [*by, "effect", "all_xx", "n"]

    def meat(name: str, *clusters: str) -> DataFrame:
        sums = scored.groupBy(*keep, *clusters).agg(F.sum("score_").alias("score_"))
        return sums.groupBy(*keep).agg(F.lit(name).alias("which"), F.sum(F.col("score_") * F.col("score_")).alias("meat"), F.count(F.lit(1)).alias("clusters"))

    parts = meat("first", first).unionByName(meat("second", second)).unionByName(meat("both", first, second))
    pick = lambda c, k: F.max(F.when(F.col("which") == k, F.col(c)))
    wide = parts.groupBy(*keep).agg(pick("meat", "first").alias("a"), pick("meat", "second").alias("b"), pick("meat", "both").alias("ab"), pick("clusters", "first").alias("first_clusters"), pick("clusters", "second").alias("second_clusters"))
    se = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / F.col("all_xx")
    return wide.select(*by, "n", "effect", se(F.col("a")).alias("se_first"), se(F.col("b")).alias("se_second"), se(F.col("a") + F.col("b") - F.col("ab")).alias("se_two_way"), "first_clusters", "second_clusters")


def wild_cluster_bootstrap(rows: DataFrame, y: str, x: str, unit: str, cluster: str, replicates: int, seed: int) -> DataFrame:
    """Share of sign-flipped replicates whose |effect| reaches the observed one: cluster scores under the null times hash signs."""
    w = Window.partitionBy(unit)
    d = rows.withColumn("yd", F.col(y) - F.avg(y).over(w)).withColumn("xd", F.col(x) - F.avg(x).over(w))
    s = d.groupBy(cluster).agg(F.sum(F.col("xd") * F.col("yd")).alias("u"))
    reps = F.broadcast(rows.sparkSession.range(replicates).withColumnRenamed("id", "rep"))
    sign = F.when(F.pmod(F.xxhash64(F.col(cluster), F.col("rep"), F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1)
    flips = s.crossJoin(reps).groupBy("rep").agg(F.sum(sign * F.col("u")).alias("t"))
    seen = s.agg(F.abs(F.sum("u")).alias("seen"))
    return flips.crossJoin(F.broadcast(seen)).agg(F.avg((F.abs("t") >= F.col("seen")).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("replicates"))


def gate(metrics: DataFrame, lower_better: dict[str, float], higher_better: dict[str, float], least: int) -> DataFrame:
    """status and reasons per row of a_<metric>, c_<metric>, n: the candidate C may not be worse than A by more than its tolerance."""
    reasons = [F.when(F.col("n") < least, F.lit("INSUFFICIENT_HISTORY"))]
    reasons += [F.when(F.col(f"c_{m}") > F.col(f"a_{m}") + t, F.lit(f"{m.upper()}_HARM")) for m, t in lower_better.items()]
    reasons += [F.when(F.col(f"c_{m}") < F.col(f"a_{m}") - t, F.lit(f"{m.upper()}_HARM")) for m, t in higher_better.items()]
    out = metrics.withColumn("reasons", F.concat_ws(",", *reasons))
    return out.withColumn("status", F.when(F.col("n") < least, "INSUFFICIENT_HISTORY").when(F.col("reasons") != "", "SHADOW").otherwise("ACTIVE"))


def score_forecasts(rows: DataFrame, order: int = 9, goals: int = 12) -> DataFrame:
    """score_nll, top1, top3, brier (sum of classes), rps and over 2.5 scores of every row, beside its other columns.

    ``rows``: home_goals, away_goals and normal log rates (m_h, m_a, v_hh, v_ha, v_aa); with no variance the rates are
    fixed. The grids are those of ``pricing.predictive_grid`` at rho 0, made and scored inside an Arrow batch.
    """
    from math import factorial

    import numpy as np
    import pyarrow as pa

    from .pricing import hermite_nodes

    need = ("home_goals", "away_goals", "m_h", "m_a", "v_hh", "v_ha", "v_aa")
    keys = [c for c in rows.columns if c not in need]
    names = ("score_nll", "top1", "top3", "brier", "rps", "over_brier", "over_logloss")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + "".join(f", {n} double" for n in names)
    nodes = hermite_nodes(order)
    spread = [np.array(c) for c in zip(*((x, y, wx * wy) for x, wx in nodes for y, wy in nodes), strict=True)]
    point = [np.zeros(1), np.zeros(1), np.ones(1)]  # all that fixed rates need
    k = np.arange(goals + 1)
    facts = np.array([float(factorial(i)) for i in k])

    def scores(at, hg, ag, mh, ma, vhh, vha, vaa):
        x, y, w = at
        c11 = np.sqrt(vhh)
        c21 = np.divide(vha, c11, out=np.zeros_like(vha), where=c11 > 0)
        c22 = np.sqrt(np.maximum(vaa - c21 * c21, 0))
        pmf = lambda r: np.exp(-r)[..., None] * r[..., None] ** k / facts
        ph = pmf(np.clip(np.exp(mh[:, None] + c11[:, None] * x), 0.05, 6))
        pa_ = pmf(np.clip(np.exp(ma[:, None] + c21[:, None] * x + c22[:, None] * y), 0.05, 6))
        grid = np.matmul((ph * w[:, None]).transpose(0, 2, 1), pa_)
        grid /= grid.sum(axis=(1, 2), keepdims=True)
        inside = (hg <= goals) & (ag <= goals)
        own = np.where(inside, grid[np.arange(len(hg)), np.minimum(hg, goals), np.minimum(ag, goals)], 0.0)
        h, a = k[:, None], k[None, :]
        seen, mine = np.round(grid, 9), np.round(own, 9)[:, None, None]
        later = (h > hg[:, None, None]) | ((h == hg[:, None, None]) & (a > ag[:, None, None]))  # of equal cells, larger scores come first
        rank = np.where(inside, ((seen > mine) | ((seen == mine) & later)).sum(axis=(1, 2)), 3)
        p = np.stack([(grid * (h > a)).sum(axis=(1, 2)), (grid * (h == a)).sum(axis=(1, 2)), (grid * (h < a)).sum(axis=(1, 2))], axis=1)
        hit = np.stack([hg > ag, hg == ag, hg < ag], axis=1).astype(float)
        over, was = (grid * (h + a >= 3)).sum(axis=(1, 2)), (hg + ag >= 3).astype(float)
        rps = (np.cumsum(p - hit, axis=1)[:, :2] ** 2).sum(axis=1) / 2
        bet = np.clip(np.where(was > 0, over, 1 - over), 1e-15, 1)
        return -np.log(np.maximum(own, 1e-15)), rank < 1, rank < 3, ((p - hit) ** 2).sum(axis=1), rps, (over - was) ** 2, -np.log(bet)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                value = [batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(len(need))]
                value = [v.astype(np.int64) for v in value[:2]] + [v.astype(float) for v in value[2:]]
                fixed = (value[4] == 0) & (value[5] == 0) & (value[6] == 0)
                out = np.empty((len(names), batch.num_rows))
                for of, at_ in ((fixed, point), (~fixed, spread)):
                    if of.any():
                        out[:, of] = scores(at_, *(v[of] for v in value))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(v) for v in out)], [*keys, *names])

    return rows.select(*keys, *need).mapInArrow(run, schema)
