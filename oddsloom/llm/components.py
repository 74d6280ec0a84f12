"""Connected components of an edge table by alternating large-star and small-star steps.

Every step groups by a vertex with a plain minimum, which Spark combines before the shuffle, so a
star of any size is no hot group. The table of the previous step is dropped once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: hang the greater neighbours of each vertex on its least one; small: the lesser ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex with a link; component: the least id that it reaches.

    ``edges``: two integer columns, in any direction, repeats and loops allowed; null ends are left out.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    table = scratch.save(edges.filter(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        table = scratch.save(_stars(_stars(table, large=True), large=False), drop=table)
        now = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return table.select(F.col("a").alias("id"), F.col("b").alias("component")).union(table.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
