"""Score grids, settlements and posteriors as long tables and closed forms."""

from __future__ import annotations

from math import factorial, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsloom.functions import odds

GOALS = 12
TOLERANCE = 1e-10  # of a residual, below which a row's rates are taken as found


def goal_grid(spark: SparkSession, goals: int = GOALS) -> DataFrame:
    """All (h, a) with 0 .. goals each: a fixed small table."""
    h = spark.range(goals + 1).select(F.col("id").cast("int").alias("h"))
    return h.crossJoin(h.select(F.col("h").alias("a")))


def score_grid(rates: DataFrame, keys: list[str], goals: int = GOALS) -> DataFrame:
    """(keys, h, a, p): independent Poisson scores with the low-score correction rho, normalised per row of ``rates`` (lh, la, rho).

    Rows with rho outside (-0.5, 0.5) or a negative corrected cell give nothing.
    """
    import numpy as np
    import pyarrow as pa

    h, a = (c.ravel().astype(np.int32) for c in np.indices((goals + 1, goals + 1)))

    def cells(grids):
        n = len(grids)
        return {"h": pa.array(np.tile(h, n)), "a": pa.array(np.tile(a, n)), "p": _nullable(grids.ravel())}

    return _from_grids(rates, keys, "h int, a int, p double", cells, goals)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over all tasks: a short file is one split, whatever its rows cost."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _nullable(x):
    """An Arrow array with nulls for NaN."""
    import pyarrow as pa

    return pa.array(x, from_pandas=True)


def _from_grids(rates: DataFrame, keys: list[str], schema: str, made, goals: int) -> DataFrame:
    """(keys, ``schema``): ``made`` of the score grids of some rows of ``rates``, as columns of the same number of values for each grid, grid after grid.

    Grids exist only inside an Arrow batch; what needs no single cells never shuffles any.
    """
    import numpy as np
    import pyarrow as pa

    lh, la, rho = (F.col(c) for c in ("lh", "la", "rho"))
    low = F.least(1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, 1 - rho)
    rows = spread(rates.filter((F.abs(rho) < 0.5) & (low >= 0)).select(*keys, *(F.col(c).cast("double") for c in ("lh", "la", "rho"))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    k = np.arange(goals + 1)
    facts = np.array([float(factorial(int(i))) for i in k])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lh, la, rho = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in range(3))
                ph, pa_ = (np.exp(-r) * r**k / facts for r in (lh, la))
                g = ph[:, :, None] * pa_[:, None, :]
                for x, y, tau in ((0, 0, 1 - lh * la * rho), (0, 1, 1 + lh * rho), (1, 0, 1 + la * rho), (1, 1, 1 - rho)):
                    g[:, x, y] *= tau[:, 0]
                g /= g.sum(axis=(1, 2), keepdims=True)
                got = made(g.reshape(len(g), -1))
                own = batch.select(range(len(keys))).take(pa.array(np.repeat(np.arange(len(g)), len(next(iter(got.values()))) // max(1, len(g)))))
                yield pa.RecordBatch.from_arrays([*own.columns, *got.values()], [*keys, *got])

    return rows.mapInArrow(run, f"{kinds}, {schema}")


def _outcome_masks(goals: int) -> dict:
    import numpy as np

    h, a = (c.ravel() for c in np.indices((goals + 1, goals + 1)))
    return {"home": h > a, "draw": h == a, "away": h < a, "over_2_5": h + a >= 3, "tail_5": h + a >= 5}


def outcomes_of(rates: DataFrame, keys: list[str], goals: int = GOALS) -> DataFrame:
    """``outcome_probabilities`` of the score grids of ``rates``, without making their cells."""
    import numpy as np

    masks = _outcome_masks(goals)
    weights = np.stack(list(masks.values()), 1).astype(float)
    return _from_grids(rates, keys, ", ".join(f"{n} double" for n in masks), lambda g: dict(zip(masks, map(_nullable, (g @ weights).T), strict=True)), goals)


def settlements_of(rates: DataFrame, lines: list[int], keys: list[str], total: bool = False, goals: int = GOALS) -> DataFrame:
    """``settlement_distribution`` of the score grids of ``rates`` on ``lines`` in quarter units, without making their cells."""
    import numpy as np
    import pyarrow as pa

    h, a = (c.ravel()[:, None] for c in np.indices((goals + 1, goals + 1)))
    line = np.array(lines, np.int32)
    margin, own = ((h + a) * 4, -line) if total else ((h - a) * 4, line)
    state = np.sign(margin + own - own % 2) + np.sign(margin + own + own % 2)
    names = {2: "full_win", 1: "half_win", 0: "push", -1: "half_loss", -2: "full_loss"}
    weights = [(state == k).astype(float) for k in names]

    def made(g):
        return {"line_q": pa.array(np.tile(line, len(g)))} | {n: _nullable((g @ w).ravel()) for n, w in zip(names.values(), weights, strict=True)}

    return _from_grids(rates, keys, "line_q int, " + ", ".join(f"{n} double" for n in names.values()), made, goals)


def _best_cells(g, n: int, digits: int):
    """Probabilities rounded to ``digits`` and the places of the n greatest of each grid; ties prefer larger home, then away scores."""
    import numpy as np

    p = np.round(np.nan_to_num(g, nan=-1.0), digits)
    return p, g.shape[1] - 1 - np.argsort(-p[:, ::-1], axis=1, kind="stable")[:, :n]


def top_of(rates: DataFrame, keys: list[str], n: int, digits: int, goals: int = GOALS) -> DataFrame:
    """(keys, h, a, place): ``top_scores`` of the score grids of ``rates`` by their probabilities rounded to ``digits``, without shuffling cells."""
    import numpy as np
    import pyarrow as pa

    def made(g):
        best = _best_cells(g, n, digits)[1].astype(np.int32)
        place = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(g))
        return {"h": pa.array(best.ravel() // (goals + 1)), "a": pa.array(best.ravel() % (goals + 1)), "place": pa.array(place)}

    return _from_grids(rates, keys, "h int, a int, place int", made, goals)


def consistent_of(rates: DataFrame, keys: list[str], n: int, picks: int, digits: int, goals: int = GOALS) -> DataFrame:
    """(keys, h, a, pick, totals_ok): of the n likeliest scores those with the likelier winner, first the ones on the likelier side of 2.5 goals; ``picks`` of them."""
    import numpy as np

    masks = _outcome_masks(goals)
    weights = np.stack([masks[c] for c in ("home", "away", "over_2_5")], 1).astype(float)

    def made(g):
        p, best = _best_cells(g, n, digits)
        home, away, over = (g @ weights).T[:, :, None]
        h, a = best // (goals + 1), best % (goals + 1)
        winner = np.where(home >= away, h > a, (home < away) & (h < a))
        totals = (over >= 0.5) == (h + a >= 3)
        first = np.argsort(np.where(winner, np.where(totals, 0, 1), 2), axis=1, kind="stable")[:, :picks]  # cells are in order of their places
        at = lambda x: np.take_along_axis(x, first, 1).ravel()
        pick = np.tile(np.arange(1, first.shape[1] + 1), len(g))
        return {"h": _ints(at(h)), "a": _ints(at(a)), "pick": _ints(pick), "totals_ok": _bools(at(totals)), "ok_": _bools(at(winner))}

    return _from_grids(rates, keys, "h int, a int, pick int, totals_ok boolean, ok_ boolean", made, goals).filter("ok_").drop("ok_")


def _ints(x):
    import numpy as np
    import pyarrow as pa

    return pa.array(x.astype(np.int32))


def _bools(x):
    import pyarrow as pa

    return pa.array(x)


def outcome_probabilities(grid: DataFrame, keys: list[str]) -> DataFrame:
    h, a, p = F.col("h"), F.col("a"), F.col("p")
    part = lambda c: F.sum(F.when(c, p).otherwise(0.0))
    return grid.groupBy(*keys).agg(part(h > a).alias("home"), part(h == a).alias("draw"), part(h < a).alias("away"), part(h + a >= 3).alias("over_2_5"), part(h + a >= 5).alias("tail_5"))


def settlement(margin_q: Column, line_q: Column) -> Column:
    """-2, -1, 0, 1, 2 half stakes won: both legs of a line in quarter units against a margin in quarter units."""
    legs = odds.quarter_legs(line_q)
    return F.signum(margin_q + legs[0]) + F.signum(margin_q + legs[1])


def settlement_distribution(grid: DataFrame, lines: DataFrame, keys: list[str], total: bool = False) -> DataFrame:
    """Probabilities of the five settlements of each line (line_q); handicaps on the home side, or totals on the over side."""
    margin = (F.col("h") + F.col("a")) * 4 if total else (F.col("h") - F.col("a")) * 4
    state = settlement(margin, -F.col("line_q") if total else F.col("line_q"))
    names = {2: "full_win", 1: "half_win", 0: "push", -1: "half_loss", -2: "full_loss"}
    cells = grid.crossJoin(F.broadcast(lines)).withColumn("state", state)
    return cells.groupBy(*keys, "line_q").agg(*(F.sum(F.when(F.col("state") == k, F.col("p")).otherwise(0.0)).alias(n) for k, n in names.items()))


def win_equivalent(half_win: float = 0.5) -> Column:
    """The pricing weight of a half win is 0.5; forecast evaluation uses 0.75."""
    return F.col("full_win") + half_win * F.col("half_win") + 0.5 * F.col("push") + 0.25 * F.col("half_loss")


def log_rate_update(m: list[Column], v: list[Column], obs: list[Column], obs_v: list[Column], fraction: Column) -> list[Column]:
    """Precision-weighted update of a 2-vector: mean (2) and covariance (hh, ha, aa), the evidence taken by ``fraction``."""

    def inverse(c: list[Column]) -> list[Column]:
        det = c[0] * c[2] - c[1] * c[1]
        return [c[2] / det, -c[1] / det, c[0] / det]

    p, q = inverse(v), [x * fraction for x in inverse(obs_v)]
    cov = inverse([x + y for x, y in zip(p, q, strict=True)])
    b = [p[0] * m[0] + p[1] * m[1] + q[0] * obs[0] + q[1] * obs[1], p[1] * m[0] + p[2] * m[1] + q[1] * obs[0] + q[2] * obs[1]]
    return [cov[0] * b[0] + cov[1] * b[1], cov[1] * b[0] + cov[2] * b[1], *cov]


def hermite_nodes(order: int) -> list[tuple[float, float]]:
    """Gauss-Hermite nodes and weights for the mean under a standard normal."""
    import numpy as np

    nodes, weights = np.polynomial.hermite_e.hermegauss(order)
    return [(float(x), float(w) / sqrt(2 * pi)) for x, w in zip(nodes, weights, strict=True)]


def predictive_grid(posterior: DataFrame, keys: list[str], order: int = 9, goals: int = GOALS) -> DataFrame:
    """Score grid under normal log rates (m_h, m_a, v_hh, v_ha, v_aa, rho): a quadrature of score grids, rates clipped to [0.05, 6].

    The order^2 grids of a row are one matrix product inside an Arrow batch; only the four low scores, whose
    correction depends on both rates, are summed node by node.
    """
    import numpy as np
    import pyarrow as pa

    need = ("m_h", "m_a", "v_hh", "v_ha", "v_aa", "rho")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in posterior.select(*keys).schema) + ", h int, a int, p double"
    nodes = hermite_nodes(order)
    x, y, w = (np.array(c) for c in zip(*((x, y, wx * wy) for x, wx in nodes for y, wy in nodes), strict=True))
    k = np.arange(goals + 1)
    facts = np.array([float(factorial(int(i))) for i in k])

    def grids(mh, ma, vhh, vha, vaa, rho):
        c11 = np.sqrt(vhh)
        c21 = np.divide(vha, c11, out=np.zeros_like(vha), where=c11 > 0)
        c22 = np.sqrt(np.maximum(vaa - c21 * c21, 0))
        lh = np.clip(np.exp(mh[:, None] + c11[:, None] * x), 0.05, 6)
        la = np.clip(np.exp(ma[:, None] + c21[:, None] * x + c22[:, None] * y), 0.05, 6)
        ph, pa_ = (np.exp(-r)[..., None] * r[..., None] ** k / facts for r in (lh, la))
        out = np.matmul((ph * w[:, None]).transpose(0, 2, 1), pa_)
        r = rho[:, None]
        for h, a, tau in ((0, 0, 1 - lh * la * r), (0, 1, 1 + lh * r), (1, 0, 1 + la * r), (1, 1, 1 - r + 0 * lh)):
            out[:, h, a] = (w * ph[..., h] * pa_[..., a] * np.maximum(tau, 0)).sum(axis=1)
        return out / out.sum(axis=(1, 2), keepdims=True)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                g = grids(*(batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(need))))
                n, cells = len(g), g.shape[1] * g.shape[2]
                own = batch.take(pa.array(np.repeat(np.arange(n), cells)))
                h, a = (np.tile(c.ravel(), n).astype(np.int32) for c in np.meshgrid(k, k, indexing="ij"))
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], pa.array(h), pa.array(a), pa.array(g.ravel())], [*keys, "h", "a", "p"])

    return spread(posterior.select(*keys, *need)).mapInArrow(run, schema)


def top_scores(grid: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n likeliest cells; ties prefer larger home, then away scores."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), F.desc("h"), F.desc("a"))
    return grid.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def implied_rates(rows: DataFrame, steps: int = 25) -> DataFrame:
    """lambda_home, lambda_away, rho and the greatest residual of every row (key columns, q_home, q_draw, q_away, line_q, q_over).

    Damped Gauss-Newton on the three residuals home, away and over, over all rows of an Arrow batch that are not there yet.
    """
    import numpy as np
    import pyarrow as pa

    keys = [c for c in rows.columns if c not in ("q_home", "q_draw", "q_away", "line_q", "q_over")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", lambda_home double, lambda_away double, rho double, residual double"

    k = np.arange(GOALS + 1)
    facts = np.array([float(factorial(int(i))) for i in k])
    higher = (k[:, None] > k[None, :]).astype(float)

    def wins(line):
        """Share won of an over bet at ``line`` by (h, a)."""
        full = (k[:, None] + k[None, :]) * 4
        return sum((full > leg) * 1.0 + 0.5 * (full == leg) for leg in (line - line % 2, line + line % 2)) / 2

    def model(x, line, tables):
        # sums over a grid are products of both scores' vectors with a fixed table, but for the four corrected cells
        lh, la, rho = x.T
        ph, pa_ = (np.exp(-r)[:, None] * r[:, None] ** k / facts for r in (lh, la))
        more = {(0, 0): -lh * la * rho, (0, 1): lh * rho, (1, 0): la * rho, (1, 1): -rho}
        more = {(h, a): ph[:, h] * pa_[:, a] * t for (h, a), t in more.items()}
        over = np.empty(len(x))
        for one, table in tables.items():
            of = np.flatnonzero(line == one)
            over[of] = np.einsum("ij,ij->i", ph[of] @ table, pa_[of]) + sum(t[of] * table[c] for c, t in more.items())
        home = np.einsum("ij,ij->i", ph @ higher, pa_) + more[1, 0]
        away = np.einsum("ij,ij->i", ph @ higher.T, pa_) + more[0, 1]
        whole = ph.sum(1) * pa_.sum(1) + sum(more.values())
        return np.stack([home, away, over], 1) / whole[:, None]

    def run(batches):
        for batch in batches:
            t = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("q_home", "q_away", "line_q", "q_over")}
            want, line = np.stack([t["q_home"], t["q_away"], t["q_over"]], 1), t["line_q"].astype(int)
            x = np.tile([1.5, 1.1, -0.05], (len(want), 1))
            damp = np.full(len(want), 1e-3)
            low, high = np.array([0.05, 0.05, -0.35]), np.array([6.0, 6.0, 0.35])
            tables = {int(one): wins(int(one)) for one in np.unique(line)}
            res = model(x, line, tables) - want
            for _ in range(steps):
                on = np.flatnonzero(np.abs(res).max(axis=1, initial=0) > TOLERANCE)  # rows that are there already rest
                if not len(on):
                    break
                at, of, aim = x[on], line[on], want[on]
                jac = np.stack([(model(np.clip(at + d, low - 1e-4, high + 1e-4), of, tables) - (res[on] + aim)) / 1e-6 for d in np.eye(3) * 1e-6], 2)
                a = jac.transpose(0, 2, 1) @ jac + damp[on, None, None] * np.eye(3)
                step = np.linalg.solve(a, (jac.transpose(0, 2, 1) @ res[on][:, :, None]))[:, :, 0]
                new = np.clip(at - step, low, high)
                got = model(new, of, tables) - aim
                better = np.square(got).sum(1) < np.square(res[on]).sum(1)
                x[on[better]], res[on[better]] = new[better], got[better]
                damp[on] = np.where(better, damp[on] * 0.3, damp[on] * 4)
            out = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(x[:, j]) for j in range(3)), pa.array(np.abs(res).max(1) if len(res) else np.zeros(0))], [*keys, "lambda_home", "lambda_away", "rho", "residual"])

    return spread(rows).mapInArrow(run, schema)
