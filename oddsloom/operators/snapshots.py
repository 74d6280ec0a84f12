"""Snapshot and label operators: versions, diffs, freezes, precedence and signals. Labels stay 1, 0 or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_versions(snapshots: DataFrame, day: str, at: list[str], digest: str) -> DataFrame:
    """content_version: the order in which a day's distinct digests were first seen; same_as_previous is null for the first."""
    first = F.min(F.struct(*at)).over(Window.partitionBy(day, digest))
    w = Window.partitionBy(day).orderBy(*at)
    seen = snapshots.withColumn("first_seen", first).withColumn("same_as_previous", F.lag(digest).over(w) == F.col(digest))
    return seen.withColumn("content_version", F.dense_rank().over(Window.partitionBy(day).orderBy("first_seen"))).drop("first_seen")


def diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """change (added, deleted, changed) and the changed fields of each key; unchanged keys are left out. Nulls compare as values."""
    o = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in fields), F.lit(True).alias("in_old"))
    n = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("in_new"))
    both = o.join(n, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in fields)))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.size(changed) > 0, "changed")
    out = both.withColumn("change", change).withColumn("fields", F.when(change == "changed", changed).otherwise(F.array().cast("array<string>")))
    return out.filter(F.col("change").isNotNull())


def latest_label(labels: DataFrame, keys: list[str], day: str, label: str) -> DataFrame:
    """The label on each key's latest day; status AMBIGUOUS (null label) if that day has more than one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    last = labels.withColumn("rk", F.rank().over(w)).filter("rk = 1")
    g = last.groupBy(*keys).agg(F.countDistinct(label).alias("k"), F.max(label).alias("m"), F.max(day).alias(day))
    return g.select(*keys, day, F.when(F.col("k") == 1, F.col("m")).alias(label), F.when(F.col("k") > 1, "AMBIGUOUS").when(F.col("k") == 1, "OK").otherwise("UNKNOWN").alias("status"))


def freeze_first(evaluations: DataFrame, keys: list[str], at: str, kickoff: str, label: str) -> DataFrame:
    """The first label seen strictly before kickoff of each key."""
    ok = evaluations.filter(F.col(label).isin(0, 1) & (F.col(at) < F.col(kickoff)))
    return ok.groupBy(*keys).agg(F.min_by(label, at).alias(label), F.min(at).alias(at))


def reference_signal(primary: Column, secondary: Column) -> Column:
    return F.when((primary == 1) & (secondary == 1), "STRONG_EXCLUDE").when(primary == 1, "EXCLUDE").when(primary == 0, "NO_EXCLUSION_SIGNAL").otherwise("UNKNOWN")


def merge_by_precedence(layers: list[tuple[str, DataFrame]], keys: list[str], label: str) -> DataFrame:
    """The label of the first layer that has one, its source, and FORENSIC_CONFLICT where later layers disagree."""
    out = None
    for name, df in layers:
        part = df.select(*keys, F.col(label).alias(f"l_{name}"))
        out = part if out is None else out.join(part, keys, "full_outer")
    cols = [F.col(f"l_{n}") for n, _ in layers]
    named = [F.when(F.col(f"l_{n}").isNotNull(), F.lit(n)) for n, _ in layers]
    known = F.array_distinct(F.array_compact(F.array(*cols)))
    return out.select(*keys, F.coalesce(*cols).alias(label), F.coalesce(*named).alias("label_source"), F.concat_ws(",", *named).alias("provenance"), F.when(F.size(known) > 1, "FORENSIC_CONFLICT").otherwise("OK").alias("status"))
