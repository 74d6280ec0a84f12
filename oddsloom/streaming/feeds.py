"""Snapshot feeds as Structured Streaming jobs. Each takes and gives a streaming DataFrame (or a batch one)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def snapshots(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Append-only JSON lines, a few files a trigger."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def timely(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    return feed.withWatermark("ts", delay)


def without_repeats(feed: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Exact repeats within the watermark are dropped."""
    return timely(feed, delay).dropDuplicatesWithinWatermark(keys)


def windows(feed: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and mean values of tumbling or sliding windows by event type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timely(feed, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def sessions(feed: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of one match: a session ends after a gap."""
    return timely(feed, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def velocity(feed: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """First to last value per minute in each window of a match."""
    us = F.unix_micros("ts")
    rate = (F.max_by("value", "ts") - F.min_by("value", "ts")) / F.nullif((F.max(us) - F.min(us)) / 6e7, F.lit(0.0))
    return timely(feed, delay).groupBy(F.window("ts", size).alias("w"), "user_id").agg(rate.alias("per_minute"))


def _in_order(batches: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    """A group's rows of one micro-batch in the order of their times: they come in chunks that are not."""
    rows = pd.concat([b[["ts", "event_id", column]] for b in batches])
    return rows.sort_values(["ts", "event_id"], ignore_index=True)


def _tags(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _in_order(batches, "value")
    was = rows["value"].shift()
    if state.exists:
        was.iloc[0] = state.get[0]
    step = (rows["value"] - was).abs()
    tag = np.select([was.isna(), step >= 6, step > 1], ["FIRST", "STRUCTURE_SHIFT", "FINE_TUNE"], "NO_MATERIAL_CHANGE")
    state.update((float(rows["value"].iloc[-1]),))
    yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "event_type": key[1], "tag": tag})


def change_tags(feed: DataFrame) -> DataFrame:
    """The change of every quote against the last one of its match and book, kept as state."""
    return feed.groupBy("user_id", "event_type").applyInPandasWithState(_tags, "event_id long, user_id long, event_type string, tag string", "last double", "append", GroupStateTimeout.NoTimeout)


def _changes(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _in_order(batches, "digest")
    was = rows["digest"].shift()
    if state.exists:
        was.iloc[0] = state.get[0]
    state.update((rows["digest"].iloc[-1],))
    rows = rows[rows["digest"] != was]
    yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "digest": rows["digest"]})


def content_changes(feed: DataFrame) -> DataFrame:
    """Only snapshots whose content differs from the last one of the match."""
    digest = F.sha2(F.concat_ws("|", "event_type", F.floor(F.col("value") / 20)), 256)
    return feed.withColumn("digest", digest).groupBy("user_id").applyInPandasWithState(_changes, "event_id long, user_id long, digest string", "last string", "append", GroupStateTimeout.NoTimeout)


def append_with_latest(feed: DataFrame, path: str, checkpoint: str):
    """Append every snapshot and refresh the newest one per match and book of each micro-batch."""
    from oddsloom.sources.sinks import latest_per_key

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").parquet(f"{path}/timeline")
        latest_per_key(batch, ["user_id", "event_type"], ["ts", "event_id"]).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/latest")

    return feed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
