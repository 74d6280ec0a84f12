"""Streams over file sources: micro-batches carry state on and late repeats are dropped."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.sources import sinks
from oddsloom.streaming import feeds

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write(spark, path, rows, k):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("{}"))
    df.coalesce(1).write.mode("append").json(f"{path}/{k}")


def drain(stream, tmp, name):
    q = stream.writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp}/{name}").collect()


def feed(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(path))


def test_tags_across_micro_batches(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, [(1, "2024-01-01 00:00:00", 7, "ah", 10.0), (2, "2024-01-01 00:01:00", 7, "ah", 18.0)], 0)
    drain(feeds.change_tags(feed(spark, src)), tmp_path, "tags")
    write(spark, src, [(3, "2024-01-01 00:02:00", 7, "ah", 18.5), (4, "2024-01-01 00:03:00", 8, "ah", 1.0)], 1)
    got = {r.event_id: r.tag for r in drain(feeds.change_tags(feed(spark, src)), tmp_path, "tags")}
    assert got == {1: "FIRST", 2: "STRUCTURE_SHIFT", 3: "NO_MATERIAL_CHANGE", 4: "FIRST"}


def test_tags_of_a_group_in_many_chunks(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(k, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", 7, "ah", float(k * 37 % 11)) for k in range(400)]
    write(spark, src, rows[::-1], 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.event_id: r.tag for r in drain(feeds.change_tags(feed(spark, src)), tmp_path, "tags")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    step = lambda k: abs(rows[k][4] - rows[k - 1][4])
    assert got == {k: "FIRST" if not k else "STRUCTURE_SHIFT" if step(k) >= 6 else "FINE_TUNE" if step(k) > 1 else "NO_MATERIAL_CHANGE" for k in range(400)}


def test_repeats_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    row = (1, "2024-01-01 00:00:00", 7, "ah", 10.0)
    write(spark, src, [row, row, (2, "2024-01-01 00:00:01", 7, "ah", 10.0)], 0)
    write(spark, src, [row], 1)
    assert sorted(r.event_id for r in drain(feeds.without_repeats(feed(spark, src), ["event_id"]), tmp_path, "dedup")) == [1, 2]


def test_content_changes_and_latest(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, [(1, "2024-01-01 00:00:00", 7, "ah", 10.0), (2, "2024-01-01 00:01:00", 7, "ah", 11.0), (3, "2024-01-01 00:02:00", 7, "ah", 30.0)], 0)
    assert sorted(r.event_id for r in drain(feeds.content_changes(feed(spark, src)), tmp_path, "changes")) == [1, 3]
    feeds.append_with_latest(feed(spark, src), f"{tmp_path}/store", f"{tmp_path}/store-state").awaitTermination()
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/store/latest").collect()] == [3]
    assert spark.read.parquet(f"{tmp_path}/store/timeline").count() == 3


def test_windows_close_with_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, [(1, "2024-01-01 00:10:00", 7, "ah", 10.0), (2, "2024-01-01 00:20:00", 7, "ah", 20.0)], 0)
    write(spark, src, [(3, "2024-01-01 06:00:00", 7, "ah", 1.0)], 1)
    write(spark, src, [(4, "2024-01-01 06:01:00", 7, "ah", 1.0)], 2)
    rows = drain(feeds.windows(feed(spark, src), "1 hour"), tmp_path, "win")
    assert [(r.n, r.mean_value) for r in rows] == [(2, 15.0)]


def test_published_versions(spark, tmp_path):
    one = spark.createDataFrame([(1, 1)], "a int, crawler_ts int")
    sinks.publish(one, str(tmp_path), "2024-01-01", "aa", "PASS")
    sinks.publish(one.withColumn("crawler_ts", F.lit(2)), str(tmp_path), "2024-01-01", "bb", "WARN")
    sinks.publish(one.withColumn("crawler_ts", F.lit(3)), str(tmp_path), "2024-01-01", "cc", "FAIL")
    assert [r.content_hash for r in sinks.current(spark, str(tmp_path), "crawler_ts").collect()] == ["bb"]


def test_packets_and_labels(spark):
    from oddsloom.sources import packets

    text = "intro\n### Odds 2 rows\n```jsonl\n{\"a\": 1}\nnot json\n{\"a\": 2}\n```\n{\"a\": 3}\n### Other 1 rows\n```\n{\"a\": 4}\n```"
    rows = packets.packet_rows(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    assert [(r.table, r.record) for r in rows] == [("Odds", '{"a": 1}'), ("Odds", '{"a": 2}'), ("Other", '{"a": 4}')]
    codes = ",".join(str(ord(c) + 5) for c in "[[1,2],[3]]")
    out = spark.createDataFrame([(codes,), ("x,y",)], "n string").select(packets.decode_labels(F.col("n"), 5).alias("x")).collect()
    assert out[0].x == [[1, 2], [3]] and out[1].x is None
