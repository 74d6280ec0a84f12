"""Processors over micro-batches: reversals, state that ends, timers that give rows, late rows counted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from oddsloom.streaming import feeds, stateful

from tests.test_streams import drain, feed, write


def steps(spark, tmp_path, make, name, *batches):
    """Each batch is a micro-batch of its own over the same state."""
    src = tmp_path / "in"
    for k, rows in enumerate(batches):
        write(spark, src, rows, k)
        out = drain(make(feed(spark, src)), tmp_path, name)
    return out


def test_tags_know_reversals_and_forget(spark, tmp_path):
    day = lambda k, h=0: f"2024-01-{k:02d} {h:02d}:00:00"
    make = lambda f: stateful.change_tags(f, keep_hours=48)
    got = steps(spark, tmp_path, make, "tags", [(1, day(1), 7, "ah", 10.0), (2, day(1, 1), 7, "ah", 18.0)], [(3, day(1, 2), 7, "ah", 16.0), (4, day(1, 3), 7, "ah", 15.5)], [(5, day(1, 4), 7, "ah", 12.0), (6, day(9), 8, "ah", 1.0)], [(7, day(10), 8, "ah", 1.0)], [(8, day(11), 7, "ah", 30.0)])
    tags = {r.event_id: (r.tag, r.reversal) for r in got}
    assert tags[2] == ("STRUCTURE_SHIFT", False) and tags[3] == ("FINE_TUNE", True) and tags[4] == ("NO_MATERIAL_CHANGE", False) and tags[5] == ("FINE_TUNE", False)
    assert tags[8] == ("FIRST", False) and tags[7][0] == "NO_MATERIAL_CHANGE"  # 7 was silent for longer than its state is kept


def test_contents_are_new_again_after_a_silence(spark, tmp_path):
    make = lambda f: stateful.content_changes(f, keep_hours=10)
    got = steps(spark, tmp_path, make, "changes", [(1, "2024-01-01 00:00:00", 7, "ah", 10.0), (2, "2024-01-01 00:01:00", 7, "ah", 11.0)], [(3, "2024-01-01 01:00:00", 7, "ah", 12.0), (4, "2024-01-03 00:00:00", 8, "ah", 1.0)], [(5, "2024-01-03 01:00:00", 8, "ah", 1.0)], [(6, "2024-01-04 00:00:00", 7, "ah", 10.0)])
    assert sorted(r.event_id for r in got) == [1, 4, 6]


def test_a_timer_closes_the_session_at_kickoff(spark, tmp_path):
    make = lambda f: stateful.sessions_until_kickoff(f.withColumn("kickoff", F.to_timestamp(F.lit("2024-01-01 20:00:00"))), start_hours=12)
    first = [(1, "2024-01-01 07:00:00", 7, "ah", 1.0), (2, "2024-01-01 09:00:00", 7, "ah", 1.0), (3, "2024-01-01 10:00:00", 7, "ah", 1.0)]
    assert steps(spark, tmp_path, make, "sessions", first) == []
    write(spark, tmp_path / "in", [(4, "2024-01-01 19:59:00", 7, "ah", 1.0), (5, "2024-01-01 20:30:00", 7, "ah", 1.0)], 1)
    late = lambda f: stateful.sessions_until_kickoff(f.withColumn("kickoff", F.when(F.col("user_id") == 7, F.to_timestamp(F.lit("2024-01-01 20:00:00"))).otherwise(F.to_timestamp(F.lit("2024-02-01 00:00:00")))), start_hours=12)
    assert drain(make(feed(spark, tmp_path / "in")), tmp_path, "sessions") == []
    write(spark, tmp_path / "in", [(6, "2024-01-31 20:00:00", 8, "ah", 1.0)], 2)
    write(spark, tmp_path / "in", [(7, "2024-01-31 20:10:00", 8, "ah", 1.0)], 3)
    got = drain(late(feed(spark, tmp_path / "in")), tmp_path, "sessions")
    assert [(r.user_id, str(r.started), str(r.ended), r.n) for r in got] == [(7, "2024-01-01 09:00:00", "2024-01-01 19:59:00", 3)]


def test_late_rows_equal_a_replay(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, f"2024-01-01 {int(h):02d}:{int(m):02d}:00", int(u), "ah", 1.0) for k, (h, m, u) in enumerate(zip(r.integers(0, 10, 90), r.integers(0, 60, 90), r.integers(0, 3, 90), strict=True))]
    make = lambda f: stateful.late_marks(f.withColumn("arrival", F.col("event_id")), 1)
    got = {x.event_id: (x.late, x.late_so_far) for x in steps(spark, tmp_path, make, "late", rows[:30], rows[30:60], rows[60:])}
    newest, count = {}, {}
    for k, ts, u, *_ in rows:
        minute = int(ts[11:13]) * 60 + int(ts[14:16])
        late = minute < newest.get(u, -999) - 60
        newest[u] = max(newest.get(u, -999), minute)
        count[u] = count.get(u, 0) + late
        assert got[k] == (late, count[u])
    assert sum(count.values()) > 10


def test_velocity_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, [(1, "2024-01-01 00:00:00", 7, "ah", 10.0), (2, "2024-01-01 01:00:00", 7, "ah", 40.0)], 0)
    write(spark, src, [(3, "2024-01-03 00:00:00", 7, "ah", 1.0)], 1)
    write(spark, src, [(4, "2024-01-05 00:00:00", 7, "ah", 1.0)], 2)
    rows = drain(feeds.velocity(feed(spark, src)), tmp_path, "velocity")
    assert [r.per_minute for r in rows if r.w.start.day == 1] == [0.5]


def test_calls_do_not_grow_with_the_keys(spark, tmp_path, monkeypatch):
    """600 keys in 4 buckets, in two micro-batches: each key on its own state, by few calls of Python; keys with nulls are keys too."""
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")
    for of in (stateful._UntilKickoff, stateful._Tags, stateful._Late):

        class Counted(of):
            def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
                import tempfile

                tempfile.mkstemp(dir=folder)
                return super().handleInputRows(key, rows, timerValues)

        monkeypatch.setattr(stateful, of.__name__, Counted)
    plain = stateful._run
    monkeypatch.setattr(stateful, "_run", lambda rows, keys, processor, schema, mode, buckets=0, per=(): plain(rows, keys, processor, schema, mode, 4, per))
    src, at = tmp_path / "in", lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    first = [(u, at(9, u % 60), u, "ah", 10.0) for u in range(600)] + [(9000, at(9, 0), None, "ah", 10.0)]
    second = [(1000 + u, at(10, u % 60), u, "ah", 10.0 + u % 9) for u in range(600)] + [(9001, at(10, 0), None, "ah", 18.0)]
    write(spark, src, first, 0)
    write(spark, src, second, 1)
    write(spark, src, [(5000, "2024-01-02 20:00:00", 7777, "ah", 1.0)], 2)
    write(spark, src, [(5001, "2024-01-02 20:01:00", 7777, "ah", 1.0)], 3)
    tags = {r.event_id: (r.user_id, r.tag) for r in drain(stateful.change_tags(feed(spark, src)), tmp_path, "tags")}
    assert tags[9001] == (None, "STRUCTURE_SHIFT") and len(tags) == 1204
    assert all(tags[u] == (u, "FIRST") and tags[1000 + u] == (u, "STRUCTURE_SHIFT" if u % 9 >= 6 else "FINE_TUNE" if u % 9 > 1 else "NO_MATERIAL_CHANGE") for u in range(600))
    kickoff = lambda f: f.withColumn("kickoff", F.when(F.col("user_id") == 7777, F.lit("2024-02-01 00:00:00")).otherwise(F.lit("2024-01-01 20:00:00")).cast("timestamp"))
    got = {r.user_id: (str(r.started), str(r.ended), r.n) for r in drain(stateful.sessions_until_kickoff(kickoff(feed(spark, src))), tmp_path, "sessions")}
    assert got == {u: (at(9, (u or 0) % 60), at(10, (u or 0) % 60), 2) for u in [*range(600), None]}
    late = drain(stateful.late_marks(feed(spark, src).withColumn("arrival", F.col("event_id")), 1), tmp_path, "late")
    assert len(late) == 1204 and not any(r.late for r in late)
    import os

    assert len(os.listdir(folder)) <= 3 * 2 * 5 + 6
