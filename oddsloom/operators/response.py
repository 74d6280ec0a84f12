"""Residual response: ridge regression of log residuals on robustly scaled features, from sums of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

MAD_TO_SD, LEAST_SCALE = 1.4826, 0.05
CLIP = 1.75
EXTRA_VARIANCE = 0.25


def log_residual(goals: Column, rate: Column) -> Column:
    """Stabilised log ratio of a score to its rate, clipped."""
    return F.least(F.greatest(F.log((goals + 0.5) / rate), F.lit(-CLIP)), F.lit(CLIP))


def robust_scales(rows: DataFrame, features: list[str], by: str) -> DataFrame:
    """(by, c_<feature>, s_<feature>): median, and MAD as a standard deviation (1 where it is next to none), by exact quantiles."""
    long = rows.unpivot([by], features, "feature", "x")
    center = exact_quantiles(long, "x", [0.5], (by, "feature")).select(F.col(by).alias("b_"), F.col("feature").alias("f_"), F.col("quantile").alias("center"))
    off = long.join(F.broadcast(center), (F.col(by) == F.col("b_")) & (F.col("feature") == F.col("f_"))).withColumn("off", F.abs(F.col("x") - F.col("center")))
    spread = exact_quantiles(off, "off", [0.5], (by, "feature")).withColumnRenamed("quantile", "mad")
    both = spread.join(center, (F.col(by) == F.col("b_")) & (F.col("feature") == F.col("f_")))
    sd = F.when(F.col("mad") * MAD_TO_SD > LEAST_SCALE, F.col("mad") * MAD_TO_SD).otherwise(1.0)
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, c))
    return both.groupBy(by).agg(*(pick(f, F.col("center")).alias(f"c_{f}") for f in features), *(pick(f, sd).alias(f"s_{f}") for f in features))


def residual_response(rows: DataFrame, features: list[str], targets: list[str], by: str, ridge: float = 1.0, least: int = 20) -> DataFrame:
    """(by, n, target, intercept, feature, center, scale, response, variance): one row for each target and feature.

    Rows with a null in a feature or target are left out, groups of fewer than ``least`` rows too. All that leaves the rows' tasks are sums of
    products; the solve is one small system a group. variance: of the target's residuals, plus a constant.
    """
    import numpy as np
    import pandas as pd

    whole = rows.select(by, *features, *targets).dropna()
    scales = robust_scales(whole, features, by).withColumnRenamed(by, "by_")
    z = [((F.col(f) - F.col(f"c_{f}")) / F.col(f"s_{f}")).alias(f"z_{f}") for f in features]
    scaled = whole.join(F.broadcast(scales), F.col(by) == F.col("by_")).select(by, F.lit(1.0).alias("z_"), *z, *targets, *(f"c_{f}" for f in features), *(f"s_{f}" for f in features))
    x = ["z_", *(f"z_{f}" for f in features)]
    cross = [(a, b) for i, a in enumerate(x) for b in x[i:]] + [(a, t) for t in targets for a in x] + [(t, t) for t in targets]
    sums = scaled.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.max(f"{k}_{f}").alias(f"{k}_{f}") for k in "cs" for f in features), *(F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(cross)))
    kind = dict(rows.dtypes)[by]
    names = [by, "n", "target", "intercept", "feature", "center", "scale", "response", "variance"]

    def solve(key, pdf):
        one = pdf.iloc[0]
        if one["n"] < least:
            return pd.DataFrame()
        value = {c: float(one[f"p{i}"]) for i, c in enumerate(cross)}
        gram = np.array([[value[a, b] if (a, b) in value else value[b, a] for b in x] for a in x])
        out = []
        for t in targets:
            xy = np.array([value[a, t] for a in x])
            coef = np.linalg.solve(gram + np.diag([0.0] + [ridge] * len(features)), xy)
            rss = value[t, t] - 2 * coef @ xy + coef @ gram @ coef  # the intercept is free, so residuals have mean 0
            out += [(key[0], int(one["n"]), t, coef[0], f, one[f"c_{f}"], one[f"s_{f}"], coef[k + 1], rss / (one["n"] - 1) + EXTRA_VARIANCE) for k, f in enumerate(features)]
        return pd.DataFrame(out, columns=names, dtype=object)

    return sums.groupBy(by).applyInPandas(solve, f"{by} {kind}, n long, target string, intercept double, feature string, center double, scale double, response double, variance double")
