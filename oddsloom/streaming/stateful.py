"""Feeds with state of their own that ends: processors with value state, event-time timers and time-outs.

Keys are dealt over a fixed number of buckets, and a bucket's state is one table with a row a key: Python is called once a bucket and
micro-batch, and works on all of its keys at once. A key's row goes when the watermark passes its end: ``keep`` after the key's last row,
or at kickoff. A bucket has one timer, at the first of its ends. Rows that are later than the watermark never reach a processor;
``late_marks`` is the side output that counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STRUCTURE_STEP, FINE_STEP = 6.0, 1.0
HOUR_MS = 3_600_000
BUCKETS = 512
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Processors need the RocksDB state store; a session that has chosen one already keeps it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


class _Buckets(StatefulProcessor):
    """State ``rows`` of a bucket: a table with a row for each of its keys, of the columns ``kept``; ``ends`` is the time in ms after which a row goes."""

    keys: tuple[str, ...] = ()
    kept: dict[str, pa.DataType] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "rows binary, timer long")

    def held(self) -> pd.DataFrame:
        if not self.state.exists():
            return pa.schema(self.kept).empty_table().to_pandas()
        return pa.ipc.open_stream(bytes(self.state.get()[0])).read_pandas()

    def hold(self, table: pd.DataFrame) -> None:
        was = self.state.get()[1] if self.state.exists() else None
        at = int(table["ends"].min()) if "ends" in self.kept and len(table) else None
        if was is not None and was != at:
            self.handle.deleteTimer(was)
        if at is not None and was != at:
            self.handle.registerTimer(at)
        if not len(table):
            self.state.clear()
            return
        rows = pa.Table.from_pandas(table, pa.schema(self.kept), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.state.update((sink.getvalue().to_pybytes(), at))

    def in_turn(self, held: pd.DataFrame, own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of held and own rows, key by key, a key's held row first; which are held, and which are the first of their key."""
        keys = list(self.keys)
        both = pd.concat([held[keys], own[keys]], ignore_index=True) if len(held) else own[keys]
        group = both.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        return order, order < len(held), np.diff(group[order], prepend=-1) != 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held()
        over = held["ends"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self.hold(held[~over])
        return self.ended(held[over])

    def ended(self, table: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def _joined(held: pd.DataFrame, own: pd.DataFrame, order: np.ndarray, column: str, of_own: np.ndarray | None = None) -> np.ndarray:
    """A column of held and own rows in turn; ``of_own``: in place of the own rows' column."""
    new = own[column].to_numpy() if of_own is None else of_own
    return np.concatenate((held[column].to_numpy(), new))[order] if len(held) else new[order]


class _Tags(_Buckets):
    keys = ("user_id", "event_type")
    kept = {"user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "direction": pa.int32(), "ends": pa.int64()}

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, own = self.held(), pd.concat(list(rows)).sort_values(["us", "event_id"], ignore_index=True)
        order, old, head = self.in_turn(held, own)
        value = _joined(held, own, order, "value").astype(float)
        step = np.where(head, np.nan, np.diff(value, prepend=np.nan))
        size = np.abs(step)
        tag = np.select([np.isnan(step), size >= STRUCTURE_STEP, size > FINE_STEP], ["FIRST", "STRUCTURE_SHIFT", "FINE_TUNE"], "NO_MATERIAL_CHANGE")
        moved = np.where(size > FINE_STEP, np.sign(step), 0)  # a step from nothing compares as False
        moved = np.where(old, _joined(held, own, order, "direction", np.zeros(len(own))), moved).astype(int)
        turn = np.maximum.accumulate(np.where(head | (moved != 0), np.arange(len(order)), 0))  # the key's last move up to each row
        before = np.where(head, 0, moved[np.roll(turn, 1)])
        ends = _joined(held, own, order, "ends", own["us"].to_numpy() // 1000 + self.keep_ms)
        starts = np.flatnonzero(head)
        last = np.append(starts[1:], len(order)) - 1
        names = {c: _joined(held, own, order, c) for c in self.keys}
        self.hold(pd.DataFrame({**{c: x[last] for c, x in names.items()}, "value": value[last], "direction": moved[turn[last]], "ends": np.maximum.reduceat(ends, starts)}))
        event = own["event_id"].to_numpy()[order[~old] - len(held)]
        yield pd.DataFrame({"event_id": event, **{c: x[~old] for c, x in names.items()}, "tag": tag[~old], "reversal": ((moved != 0) & (moved == -before))[~old]})


class _Changes(_Buckets):
    keys = ("user_id",)
    kept = {"user_id": pa.int64(), "digest": pa.string(), "ends": pa.int64()}

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, own = self.held(), pd.concat(list(rows)).sort_values(["us", "event_id"], ignore_index=True)
        order, old, head = self.in_turn(held, own)
        user, digest = (_joined(held, own, order, c) for c in ("user_id", "digest"))
        ends = _joined(held, own, order, "ends", own["us"].to_numpy() // 1000 + self.keep_ms)
        starts = np.flatnonzero(head)
        last = np.append(starts[1:], len(order)) - 1
        self.hold(pd.DataFrame({"user_id": user[last], "digest": digest[last], "ends": np.maximum.reduceat(ends, starts)}))
        new = ~old & (head | (digest != np.roll(digest, 1)))
        yield pd.DataFrame({"event_id": own["event_id"].to_numpy()[order[new] - len(held)], "user_id": user[new], "digest": digest[new]})


class _UntilKickoff(_Buckets):
    """Counts rows until the timer at their kickoff closes the session and gives its row."""

    keys = ("user_id", "kickoff")
    kept = {"user_id": pa.int64(), "kickoff": pa.int64(), "started": pa.int64(), "ended": pa.int64(), "n": pa.int64(), "ends": pa.int64()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows))
        own = own[list(self.keys)].assign(started=own["us"], ended=own["us"], n=1, ends=own["kickoff"] // 1000)
        held = self.held()
        both = pd.concat([held, own], ignore_index=True) if len(held) else own
        self.hold(both.groupby(list(self.keys), dropna=False, sort=False, as_index=False).agg({"started": "min", "ended": "max", "n": "sum", "ends": "min"}))
        return iter(())

    def ended(self, table: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield table[["user_id", "kickoff", "started", "ended", "n"]]


class _Late(_Buckets):
    """Each row against the newest time that its key has shown before it, in order of arrival."""

    keys = ("user_id", "event_type")
    kept = {"user_id": pa.int64(), "event_type": pa.string(), "us": pa.int64(), "late": pa.int64()}

    def __init__(self, delay_ms: int):
        self.delay_us = delay_ms * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, own = self.held(), pd.concat(list(rows)).sort_values("arrival", ignore_index=True)
        order, old, head = self.in_turn(held, own)
        group = np.cumsum(head)
        newest = pd.Series(_joined(held, own, order, "us")).groupby(group).cummax().to_numpy()
        before = np.roll(newest, 1)
        late = ~head & (_joined(held, own, order, "us") < before - self.delay_us)
        total = pd.Series(np.where(old, _joined(held, own, order, "late", np.zeros(len(own), np.int64)), late)).groupby(group).cumsum().to_numpy()
        last = np.append(np.flatnonzero(head)[1:], len(order)) - 1
        names = {c: _joined(held, own, order, c) for c in self.keys}
        self.hold(pd.DataFrame({**{c: x[last] for c, x in names.items()}, "us": newest[last], "late": total[last]}))
        event = own["event_id"].to_numpy()[order[~old] - len(held)]
        yield pd.DataFrame({"event_id": event, **{c: x[~old] for c, x in names.items()}, "late": late[~old], "late_so_far": total[~old]})


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, buckets: int = BUCKETS, per: tuple[str, ...] = ()) -> DataFrame:
    """``processor`` over the ``buckets`` of ``keys`` (within each of ``per``); rows with a null in a key have a bucket of their own, as their numbers are no integers in pandas."""
    with_store(rows.sparkSession)
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(k).isNull()
    bucket = F.when(lost, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(buckets))).cast("int")
    return rows.withColumn("bucket", bucket).groupBy(*per, "bucket").transformWithStateInPandas(processor, schema, "append", mode)


def _us(time: str) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(0))


def change_tags(feed: DataFrame, delay: str = "1 hour", keep_hours: float = 24 * 30) -> DataFrame:
    """The change of every quote against the last one of its match and book, and whether it turns the last move round."""
    rows = feed.withWatermark("ts", delay).select("event_id", "ts", _us("ts").alias("us"), "user_id", "event_type", "value")
    return _run(rows, ["user_id", "event_type"], _Tags(int(keep_hours * HOUR_MS)), "event_id long, user_id long, event_type string, tag string, reversal boolean", "EventTime")


def content_changes(feed: DataFrame, delay: str = "1 hour", keep_hours: float = 24 * 30) -> DataFrame:
    """Only snapshots whose content differs from the last one of the match; after ``keep_hours`` of silence any content is new."""
    digest = F.sha2(F.concat_ws("|", "event_type", F.floor(F.col("value") / 20)), 256)
    rows = feed.withWatermark("ts", delay).select("event_id", "ts", _us("ts").alias("us"), "user_id", digest.alias("digest"))
    return _run(rows, ["user_id"], _Changes(int(keep_hours * HOUR_MS)), "event_id long, user_id long, digest string", "EventTime")


def sessions_until_kickoff(feed: DataFrame, start_hours: float = 12, delay: str = "1 hour", buckets: int = 64) -> DataFrame:
    """One row per match (user_id, kickoff) once the watermark passes its kickoff: what was collected from ``start_hours`` before it.

    Matches are dealt over ``buckets`` in each hour of kickoff.
    """
    rows = feed.withWatermark("ts", delay).filter((F.col("ts") < F.col("kickoff")) & (F.col("ts") >= F.col("kickoff") - F.make_dt_interval(hours=F.lit(int(start_hours)))))
    rows = rows.select("ts", _us("ts").alias("us"), "user_id", F.date_trunc("hour", "kickoff").alias("slot"), _us("kickoff").alias("kickoff"))
    out = _run(rows, ["user_id"], _UntilKickoff(), "user_id long, kickoff long, started long, ended long, n long", "EventTime", buckets, ("slot",))
    return out.select("user_id", *(F.timestamp_micros(c).alias(c) for c in ("kickoff", "started", "ended")), "n")


def late_marks(feed: DataFrame, delay_hours: float = 1) -> DataFrame:
    """Every row with whether it came later than ``delay_hours`` behind its key's newest one, and the key's late rows so far; column ``arrival`` orders the rows of a micro-batch."""
    rows = feed.select("event_id", _us("ts").alias("us"), "user_id", "event_type", "arrival")
    return _run(rows, ["user_id", "event_type"], _Late(int(delay_hours * HOUR_MS)), "event_id long, user_id long, event_type string, late boolean, late_so_far long", "None")
