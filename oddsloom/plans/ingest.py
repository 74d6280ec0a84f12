"""Ingest of texts and pages, and streams over the event feed (S-02..04, S-12, R-01..08)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.sources import packets, pages
from oddsloom.sources.bind import matches, table
from oddsloom.streaming import feeds, stateful

from .registry import Plans

PLANS = Plans()


@PLANS.add("""SELECT conv_id, 'Turns' AS "table", CAST(turn + 2 AS INT) AS line_no, CAST(length(role) AS BIGINT) AS role_chars, CAST(length(text) AS BIGINT) AS text_chars FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn FROM conversations)""")
def s02_packet_archive(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.concat(F.lit("### Turns 3 rows\n```jsonl\n"), F.array_join(F.transform("t", lambda x: F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("text")))), "\n"), F.lit("\n```\nend"))
    rows = packets.packet_rows(c.select("conv_id", text.alias("text")), "conv_id", "text")
    return rows.select("conv_id", "table", "line_no", F.length(F.get_json_object("record", "$.role")).cast("long").alias("role_chars"), F.length(F.get_json_object("record", "$.text")).cast("long").alias("text_chars"))


@PLANS.add("SELECT page_id, unnest(range(len(x))) AS \"row\", CAST(length(unnest(x)) AS BIGINT) AS item_chars FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS x FROM pages)")
def s03_html_items(spark, d):
    rows = packets.list_items(table(spark, d, "pages"), "page_id", "html", "p")
    return rows.select("page_id", F.col("row").cast("long").alias("row"), F.length("item").cast("long").alias("item_chars"))


_POOL_FIELDS = {"no": "c-no", "league": "c-league", "teams": "c-team", "time": "c-time"}


def _pool_pages(spark, d):
    """A page a day with the matches in two tables, and the encoded indices of the draws. A task holds the text of one page at a time."""
    m = matches(spark, d).withColumn("day", F.date_format("kickoff", "yyyy-MM-dd")).withColumn("table_id", F.when(F.col("match_id") % 2 == 0, "tbl").otherwise("bdtbl"))
    m = m.repartition("day").withColumn("idx", F.row_number().over(Window.partitionBy("day", "table_id").orderBy("match_id")) - 1)
    cell = lambda c, x: F.concat(F.lit(f'<td class="{c}">'), x, F.lit("</td>"))
    teams = F.concat(F.lit("<b>T"), F.col("home_team"), F.lit("</b> vs T"), F.col("away_team"), F.lit("<table><tbody><tr><td> &amp; more</td></tr></tbody></table>"))
    tr = F.concat(F.lit('<tr data-idx="'), F.col("idx"), F.lit('" data-key="k'), F.col("match_id"), F.lit('">'), cell("c-no", F.col("match_id").cast("string")), cell("c-league", F.col("competition")), cell("c-team", teams), cell("c-time", F.date_format("kickoff", "yyyy-MM-dd HH:mm")), F.lit("</tr>"))
    rows = m.sortWithinPartitions("day", "table_id", "match_id").select("day", "table_id", "idx", tr.alias("tr"), (F.col("home_goals") == F.col("away_goals")).alias("draw"))
    return rows.mapInArrow(_day_pages, "day string, html string")


def _day_pages(batches):
    """The page of each day from its rows, which come one after another, by table and index."""
    def page(day, rows, draws):
        codes = ",".join(str(ord(c) + 13) for c in json.dumps([draws["tbl"], draws["bdtbl"]], separators=(",", ":")))
        head = f'<html><script>var _mk=[{codes}].map(function(c){{return String.fromCharCode(c-13);}}).join("");</script><table id="tbl"><thead><tr><th>no</th></tr></thead><tbody>'
        html = "".join((head, *rows["tbl"], '</tbody></table><table id="bdtbl"><tbody>', *rows["bdtbl"], "</tbody></table></html>"))
        return pa.RecordBatch.from_arrays([pa.array([day], pa.string()), pa.array([html], pa.string())], ["day", "html"])

    of, rows, draws = None, None, None
    for batch in batches:
        for day, table_id, idx, tr, draw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows is None or day != of:
                if rows is not None:
                    yield page(of, rows, draws)
                of, rows, draws = day, {"tbl": [], "bdtbl": []}, {"tbl": [], "bdtbl": []}
            if tr is not None:
                rows[table_id].append(tr)
            if draw:
                draws[table_id].append(idx)
    if rows is not None:
        yield page(of, rows, draws)


#: Parquet's writer looks at its memory after every row, and ends row groups early: what is written and what is read at once stay some pages, however long these are.
_LONG_ROWS = {"parquet.block.size": 2 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
_BATCH = 16 << 20  # bytes of an Arrow batch of rows or pages


@PLANS.add("""WITH m AS (SELECT *, strftime(kickoff, '%Y-%m-%d') AS day, CASE WHEN match_id % 2 = 0 THEN 'tbl' ELSE 'bdtbl' END AS table_id FROM matches), i AS (SELECT *, row_number() OVER (PARTITION BY day, table_id ORDER BY match_id) - 1 AS idx FROM m)
    SELECT day, table_id, CAST(idx AS INT) AS "row", CAST(idx AS INT) AS data_idx, 'k' || match_id AS data_key, CAST(match_id AS VARCHAR) AS "no", competition AS league, 'T' || home_team || ' vs T' || away_team || ' & more' AS teams, strftime(kickoff, '%Y-%m-%d %H:%M') AS "time", CAST(home_goals = away_goals AS INT) AS label FROM i""")
def s03_page_tables(spark, d):
    """The rows of two tables of each day's page with their labels; a page with any problem would be refused as a whole."""
    made = _once(_pool_pages(spark, d), "pages", _LONG_ROWS, _BATCH)  # read for the cells and for the labels
    rows = _once(pages.labelled_rows(made, "day", "html", ["tbl", "bdtbl"], _POOL_FIELDS, list(_POOL_FIELDS)), "page-rows", batch_bytes=_BATCH)
    return pages.accepted(rows, "day")


@PLANS.add("SELECT o_orderkey, CAST(o_orderkey % 50 AS INT) AS first_index, 2 AS groups FROM orders")
def s04_label_decode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("[["), F.col("o_orderkey") % 50, F.lit(",7],["), F.col("o_orderkey") % 9, F.lit("]]")).alias("t"))
    codes = F.array_join(F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: F.ascii(c) + 13), ",")
    x = packets.decode_labels(codes, 13)
    return o.select("o_orderkey", x.alias("x")).select("o_orderkey", F.col("x")[0][0].alias("first_index"), F.size("x").alias("groups"))


def _feed(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@PLANS.add("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def r04_window_aggregates(spark, d):
    """The batch form of the windowed feed: the same plan runs on a stream."""
    w = feeds.windows(_feed(spark, d), "1 day")
    return w.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("mean_value", 6).alias("mean_value"))


@PLANS.add("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k""")
def r06_collection_sessions(spark, d):
    return feeds.sessions(_feed(spark, d)).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@PLANS.add("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round((arg_max(value, ts) - arg_min(value, ts)) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 0), 6) AS per_minute FROM events GROUP BY ALL")
def r07_window_velocity(spark, d):
    return feeds.velocity(_feed(spark, d)).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), F.round("per_minute", 6).alias("per_minute"))


def _stream(spark, d):
    """The events file as a stream of its own, all of it in one trigger."""
    schema = table(spark, d, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; an own one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="oddsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _once(df, name, options=None, batch_bytes=None):
    """``df`` written into the shared folder, and read from there as often as it is needed; ``batch_bytes``: the size of Arrow batches during this write."""
    import uuid

    path, conf = f"{shared_folder(df.sparkSession)}/{name}/{uuid.uuid4().hex[:12]}", df.sparkSession.conf
    was = conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes or was)
        df.write.options(**(options or {})).parquet(path)
    finally:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drain(stream, name):
    """Run a streaming DataFrame over what is there, into a table in the shared folder, and read it."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@PLANS.add("SELECT event_id, user_id FROM events")
def s12_r03_stream_without_repeats(spark, d):
    return _drain(feeds.without_repeats(_stream(spark, d), ["event_id"]), "r03").select("event_id", "user_id")


@PLANS.add("""WITH l AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step FROM events), m AS (SELECT *, CASE WHEN abs(step) > 1 THEN sign(step) END AS move FROM l)
    SELECT event_id, user_id, event_type, CASE WHEN step IS NULL THEN 'FIRST' WHEN abs(step) >= 6 THEN 'STRUCTURE_SHIFT' WHEN abs(step) > 1 THEN 'FINE_TUNE' ELSE 'NO_MATERIAL_CHANGE' END AS tag,
    coalesce(move = -last_value(move IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reversal FROM m""")
def r05_stream_change_tags(spark, d):
    return _drain(stateful.change_tags(_stream(spark, d)), "r05")


@PLANS.add("SELECT event_id, user_id FROM (SELECT *, event_type || '|' || CAST(floor(value / 20) AS BIGINT) AS g, lag(event_type || '|' || CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE l IS NULL OR g <> l")
def r08_stream_content_changes(spark, d):
    return _drain(stateful.content_changes(_stream(spark, d)), "r08").select("event_id", "user_id")


@PLANS.add("""WITH e AS (SELECT user_id, ts, date_trunc('day', ts) + INTERVAL 1 DAY AS kickoff FROM events) SELECT user_id, CAST(kickoff AS TIMESTAMP) AS kickoff, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM e
    WHERE ts >= kickoff - INTERVAL 12 HOUR AND kickoff <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def r06_kickoff_sessions(spark, d):
    """What was collected in the 12 hours before each kickoff (here the end of the day), given once the stream is past it."""
    feed = _stream(spark, d).withColumn("kickoff", F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"))
    out = _drain(stateful.sessions_until_kickoff(feed, start_hours=12), "r06")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("kickoff", "started", "ended")), "n")


_LATE = "SELECT event_type, count(*) AS late FROM (SELECT event_type, ts, max(ts) OVER (PARTITION BY event_type, user_id ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen - INTERVAL 1 HOUR GROUP BY 1"


@PLANS.add(_LATE)
def r02_stream_late_rows(spark, d):
    """The rows that a stream's state marks as too late, in an order of arrival unlike that of their times."""
    feed = _stream(spark, d).withColumn("arrival", F.struct(F.col("event_id") * 7919 % 10007, "event_id")).withColumn("arrival", F.format_string("%06d|%020d", "arrival.col1", "arrival.event_id"))
    return _drain(stateful.late_marks(feed, 1), "r02").filter("late").groupBy("event_type").agg(F.count(F.lit(1)).alias("late"))


@PLANS.add("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def r01_latest_per_key(spark, d):
    from oddsloom.sources.sinks import latest_per_key

    return latest_per_key(_feed(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@PLANS.add(_LATE)
def r02_late_rows(spark, d):
    """Rows over an hour older than what their key has shown before, in an order of arrival unlike that of their times."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy(F.col("event_id") * 7919 % 10007, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _feed(spark, d).withColumn("seen", F.max("ts").over(w))
    return e.filter(F.col("ts") < F.col("seen") - F.expr("INTERVAL 1 HOUR")).groupBy("event_type").agg(F.count(F.lit(1)).alias("late"))
