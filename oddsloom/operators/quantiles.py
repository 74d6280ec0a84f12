"""Exact quantiles by refining counts: no buffer ever holds the values of a group.

Every wanted order statistic has an interval of values. A round counts the rows of each interval in CELLS cells, with the least and
greatest value of each, combined before the shuffle, and goes on with the cell that holds the rank; an interval of one value is
done, and one with few rows is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256
FEW = 50_000  # rows of an interval that are ranked in one window
TARGETS = 100_000  # groups times ranks, which pass through the driver


def exact_quantiles(rows: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """(by, prob, quantile): quantiles with linear interpolation between ranks, nulls and NaN left out; groups without a value have no row."""
    by = list(by)
    spark = rows.sparkSession
    v = rows.select(*by, F.col(value).cast("double").alias("v_")).filter(F.col("v_").isNotNull() & ~F.isnan("v_"))
    groups = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high")).filter("n > 0").limit(TARGETS + 1).collect()
    if len(groups) * len(probs) > TARGETS:
        raise ValueError(f"more than {TARGETS} quantiles at once: part the groups")
    types = dict(rows.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "rank_ long, low_ double, high_ double, below_ long"
    done: dict[tuple, float] = {}
    open_: dict[tuple, tuple[float, float, int]] = {}  # (group, rank) -> least and greatest value of its interval, rows below it
    for g in groups:
        for p in probs:
            for rank in {math.floor((g["n"] - 1) * p), math.ceil((g["n"] - 1) * p)}:
                open_[(*(g[c] for c in by), rank)] = (g["low"], g["high"], 0)
    size = {tuple(g[c] for c in by): g["n"] for g in groups}
    held = {k: size[k[:-1]] for k in open_}
    while open_:
        for k, (low, high, _) in list(open_.items()):
            if low == high:
                done[k] = low
                del open_[k]
        small = {k: x for k, x in open_.items() if held[k] <= few}
        wide = {k: x for k, x in open_.items() if held[k] > few}
        if small:
            own = _inside(v, spark.createDataFrame([(*k, *x) for k, x in small.items()], schema), by)
            place = F.row_number().over(Window.partitionBy(*by, "rank_").orderBy("v_")) - 1 + F.col("below_")
            for r in own.withColumn("place", place).filter("place = rank_").collect():
                done[(*(r[c] for c in by), r["rank_"])] = r["v_"]
        if wide:
            own = _inside(v, spark.createDataFrame([(*k, *x) for k, x in wide.items()], schema), by)
            cell = F.least(F.floor((F.col("v_") / 2 - F.col("low_") / 2) / (F.col("high_") / 2 - F.col("low_") / 2) * CELLS), F.lit(CELLS - 1))
            cells = own.groupBy(*by, "rank_", "below_", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high"))
            upto = F.sum("n").over(Window.partitionBy(*by, "rank_").orderBy("cell")) + F.col("below_")
            hit = cells.withColumn("upto", upto).filter((F.col("rank_") < F.col("upto")) & (F.col("rank_") >= F.col("upto") - F.col("n")))
            for r in hit.collect():
                k = (*(r[c] for c in by), r["rank_"])
                wide[k], held[k] = (r["low"], r["high"], r["upto"] - r["n"]), r["n"]
        open_ = wide
    out = []
    for g in groups:
        key = tuple(g[c] for c in by)
        for p in probs:
            h = (g["n"] - 1) * p
            a, b = done[(*key, math.floor(h))], done[(*key, math.ceil(h))]
            out.append((*key, float(p), a + (h - math.floor(h)) * (b - a)))
    return spark.createDataFrame(out, "".join(f"{c} {types[c]}, " for c in by) + "prob double, quantile double")


def _inside(v: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The values in each target's interval; the targets are few and known."""
    same = F.lit(True)
    t = targets
    for c in by:
        t = t.withColumnRenamed(c, f"{c}_of")
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    j = v.join(F.broadcast(t), same & (F.col("v_") >= F.col("low_")) & (F.col("v_") <= F.col("high_")))
    return j.select(*by, "v_", "rank_", "low_", "high_", "below_")
