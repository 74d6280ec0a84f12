"""Entity operators: alias dimensions, fixture resolution in precedence order, time-windowed matching."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from oddsloom.functions.scalars import fold_strict, stable_id


def alias_dimension(entities: DataFrame, id_: str, aliases: str) -> DataFrame:
    """(alias, id, collision): one row per folded alias; an alias of two ids is a collision and gets no id."""
    rows = entities.select(id_, F.explode(aliases).alias("alias")).withColumn("alias", fold_strict(F.col("alias"))).distinct()
    g = rows.groupBy("alias").agg(F.min(id_).alias(id_), F.countDistinct(id_).alias("k"))
    return g.select("alias", F.when(F.col("k") == 1, F.col(id_)).alias(id_), (F.col("k") > 1).alias("collision"))


def canonical(rows: DataFrame, name: str, dim: DataFrame, id_: str, prefix: str) -> DataFrame:
    """Add canonical_id (a hashed fallback for unregistered names) and registered."""
    key = fold_strict(F.col(name))
    joined = rows.withColumn("alias", key).join(dim, "alias", "left")
    return joined.select(*rows.columns, F.coalesce(F.col(id_).cast("string"), stable_id(prefix, F.col("alias"))).alias("canonical_id"), F.col(id_).isNotNull().alias("registered"))


def resolve(requests: DataFrame, candidates: list[tuple[int, DataFrame]], request: str, match: str) -> DataFrame:
    """Per request the candidates of the best (least) rank: resolved with one, ambiguous with more, not_found with none."""
    found = None
    for rank, rows in candidates:
        part = rows.select(request, match).withColumn("rank", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("best", F.min("rank").over(Window.partitionBy(request))).filter(F.col("rank") == F.col("best"))
    g = best.groupBy(request).agg(F.countDistinct(match).alias("k"), F.min(match).alias("first"), F.min("rank").alias("rank"))
    out = requests.select(request).join(g, request, "left")
    return out.select(request, F.when(F.col("k") == 1, "resolved").when(F.col("k") > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(F.col("k") == 1, F.col("first")).alias(match), F.coalesce("k", F.lit(0)).alias("candidates"), "rank")


def time_confidence(minutes: Column) -> Column:
    """0.95 within 30 minutes, 0.85 at a zone shift of one or eight hours within 5 minutes, 0.98 if a time is missing, else null."""
    gap = F.abs(minutes)
    return F.when(minutes.isNull(), 0.98).when(gap <= 30, 0.95).when((F.abs(gap - 60) <= 5) | (F.abs(gap - 480) <= 5), 0.85)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, id_: str, tolerance_us: int) -> DataFrame:
    """The nearest right row of each left row within the tolerance, by buckets of the tolerance's width."""
    a = left.withColumn("bucket", F.floor(F.col(left_us) / tolerance_us)).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    b = right.withColumn("bucket", F.floor(F.col(right_us) / tolerance_us))
    gap = F.abs(F.col(left_us) - F.col(right_us))
    pairs = a.join(b, [*keys, "bucket"]).withColumn("gap_us", gap).filter(F.col("gap_us") <= tolerance_us)
    w = Window.partitionBy(*left.columns).orderBy("gap_us", id_)
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "bucket")


def _forms(names, sizes, places, least: float):
    """Per name the forms of which any two names of a block that reach ``least`` share one, by side: 0 among equal lengths, 1 the longer, 2 the shorter.

    Two names within k edits are equal once s places of both are blanked and x and y places are left out. Names of one length differ
    only at ``places`` where their block's names of that length do, and need no edits before the first or after the last of these.
    """
    def without(name, out, put):
        parts, at = [], 0
        for i in out:
            parts.append(name[at:i])
            at = i + 1
        return put.join([*parts, name[at:]])

    def blanked(name, s, x, blanks, leaves):
        for out in combinations(leaves, x):
            left = without(name, out, "") if x else name
            for blank in combinations(blanks if blanks is not None else range(len(left)), s):
                yield without(left, blank, "\0") if s else left

    def of(name, lengths, where):
        n, own, where = len(name), set(), sorted(where)
        for m in lengths:
            k, gap = int((1 - least) * max(n, m)), abs(n - m)
            if k > 2 or gap > k:
                continue
            for y in range((k - gap) // 2 + 1):
                blanks = k - gap - 2 * y
                if n == m:
                    free = where if not y else None
                    span = range(where[0], where[-1] + 1) if where else ()
                    own |= {(0, f"{n}|{y}|{f}") for f in blanked(name, min(blanks, len(free)) if free is not None else blanks, y, free, span)}
                else:
                    own |= {(1 if n > m else 2, f"{max(n, m)}|{min(n, m)}|{y}|{f}") for f in blanked(name, blanks, y + gap if n > m else y, None, range(n))}
        return [{"side": side, "form": form} for side, form in own]

    return pd.Series([of(*x) for x in zip(names, sizes, places, strict=True)])


PARTS = 32  # of a block's names, where names too long for forms meet all of them


def close_names(rows: DataFrame, id_: str, block: str, name: str, n: int, least: float, digits: int = 6) -> DataFrame:
    """(a, b, ratio, place): for every row the n rows of its block with the nearest names, by Levenshtein ratio of ``least`` or more, then id.

    Only names that share a form are compared; names so long that three edits keep the ratio meet all names of their block. ``id_`` is
    unique, and rows without one have no place. Joins of tables that grow with the rows are hinted: Spark takes forms for no larger
    than the names that they come from, and would send them all through the driver to broadcast them.
    """
    rows = rows.select(F.col(id_).alias("id"), F.col(block).alias("block"), F.col(name).alias("name")).filter("id IS NOT NULL AND block IS NOT NULL AND length(name) > 0")
    slack = least - 0.5 * 10.0**-digits - 1e-12
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("block", "name").orderBy("id"))).filter(F.col("rn") <= n + 1).drop("rn")
    names = first.groupBy("block", "name").agg(F.collect_list("id").alias("ids")).withColumn("size", F.length("name"))
    chars = names.select("block", "size", F.posexplode(F.split("name", "")).alias("pos", "c")).groupBy("block", "size", "pos").agg(F.min(F.ascii("c")).alias("lo"), F.max(F.ascii("c")).alias("hi"))
    places = chars.groupBy("block", "size").agg(F.collect_list(F.when(F.col("lo") != F.col("hi"), F.col("pos"))).alias("places"))
    sizes = places.groupBy("block").agg(F.collect_list("size").alias("sizes"))

    @pandas_udf("array<struct<side int, form string>>")
    def forms(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return _forms(x, y, z, slack)

    spread = names.join(places, ["block", "size"]).join(sizes, "block").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    f = spread.select("block", "name", "ids", F.explode(forms("name", "sizes", "places")).alias("f")).select("block", "name", "ids", F.col("f.side").alias("side"), F.xxhash64("f.form").alias("form"))
    one = f.withColumnsRenamed({"name": "one", "side": "side_one", "ids": "ids_one"})  # both renamed: one plan, whose shuffle Spark makes once
    other = f.withColumnsRenamed({"name": "other", "side": "side_other", "ids": "ids_other"}).hint("merge")
    sides = (F.col("side_one") == 0) & (F.col("side_other") == 0) | (F.col("side_one") + F.col("side_other") == 3)
    same = one.join(other, ["form", "block"]).filter(sides & (F.col("one") < F.col("other")))
    long = int(3 / (1 - slack))
    some = names.filter(F.col("size") >= long).select("block", F.col("name").alias("one"), F.col("ids").alias("ids_one"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    every = names.select("block", F.col("name").alias("other"), F.col("ids").alias("ids_other"), F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int").alias("part")).hint("merge")
    far = some.join(every, ["block", "part"]).filter((F.col("one") < F.col("other")) | (F.length("other") < long))
    both = ["block", "one", "ids_one", "other", "ids_other"]
    once = lambda x: F.explode(F.array(x)).alias("edits")  # noqa: E731  # Spark would work out a plain column anew in each filter
    same = same.select(*both, once(F.levenshtein("one", "other", 2))).filter("edits >= 0")  # names with forms reach the ratio by two edits at most
    far = far.select(*both, once(F.levenshtein("one", "other")))
    ratio = F.round(1 - F.col("edits") / F.greatest(F.length("one"), F.length("other")), digits)
    pairs = same.unionByName(far).withColumn("ratio", ratio).filter(F.col("ratio") >= least)
    ways = F.array(F.struct(F.col("one").alias("name"), F.col("ids_other").alias("bs")), F.struct(F.col("other").alias("name"), F.col("ids_one").alias("bs")))
    near = pairs.select("block", "ratio", F.explode(ways).alias("x")).select("block", "x.name", F.explode("x.bs").alias("b"), "ratio")
    near = near.unionByName(names.select("block", "name", F.explode("ids").alias("b"), F.lit(1.0).alias("ratio"))).repartition("block", "name")
    near = near.withColumn("h", F.xxhash64("name"))  # names of a block begin alike: sorted by this first
    rank = F.dense_rank().over(Window.partitionBy("h", "block", "name").orderBy(F.desc("ratio"), "b"))  # a pair comes once for each form that it shares
    best = near.withColumn("rn", rank).filter(F.col("rn") <= n + 1).select("block", "name", "b", "ratio").distinct()
    own = rows.select("block", "name", F.col("id").alias("a")).join(best.hint("merge"), ["block", "name"]).filter("a <> b")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ratio"), "b"))).filter(F.col("place") <= n).select("a", "b", "ratio", "place")
