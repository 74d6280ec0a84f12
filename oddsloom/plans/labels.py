"""Snapshots and labels (U-01, W-10..14, A-19, A-20, A-23, J-11..15, J-22..25, K-02, K-03, K-07..09)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.operators import snapshots as ops
from oddsloom.sources.bind import matches, pool, table

from .registry import Plans

PLANS = Plans()
DAY = "DATE '2024-01-10'"


@PLANS.add("""WITH d AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS following FROM (SELECT DISTINCT snapshot_date FROM pool)), o AS (SELECT following AS snapshot_date, match_id, market, label, visible FROM pool JOIN d USING (snapshot_date) WHERE following IS NOT NULL), n AS (SELECT * FROM pool WHERE snapshot_date IN (SELECT following FROM d))
    SELECT snapshot_date, match_id, market, CASE WHEN o.label IS NULL THEN 'added' WHEN n.label IS NULL THEN 'deleted' ELSE 'changed' END AS change, CASE WHEN o.label IS NULL OR n.label IS NULL THEN '' WHEN o.label <> n.label AND o.visible <> n.visible THEN 'label,visible' WHEN o.label <> n.label THEN 'label' ELSE 'visible' END AS fields
    FROM o FULL JOIN n USING (snapshot_date, match_id, market) WHERE o.label IS DISTINCT FROM n.label OR o.visible IS DISTINCT FROM n.visible""")
def u01_snapshot_diff(spark, d):
    """Every snapshot day against the one before."""
    p = pool(spark, d)
    days = p.select("snapshot_date").distinct()
    next_ = F.broadcast(days.withColumn("next", F.lead("snapshot_date").over(Window.orderBy("snapshot_date"))).filter("next IS NOT NULL"))
    old = p.join(next_, "snapshot_date").drop("snapshot_date").withColumnRenamed("next", "snapshot_date")
    new = p.join(next_.select(F.col("next").alias("snapshot_date")), "snapshot_date")
    keys = ["snapshot_date", "match_id", "market"]
    return ops.diff(old, new, keys, ["label", "visible"]).select(*keys, "change", F.concat_ws(",", "fields").alias("fields"))


_SNAP = "SELECT CAST(ts AS DATE) AS day, event_id, ts, event_type || '-' || CAST(floor(value / 20) AS BIGINT) AS digest FROM events"


@PLANS.add(f"""WITH s AS ({_SNAP}), f AS (SELECT *, min({{'t': ts, 'e': event_id}}) OVER (PARTITION BY day, digest) AS f, lag(digest) OVER (PARTITION BY day ORDER BY ts, event_id) = digest AS same FROM s)
    SELECT day, event_id, dense_rank() OVER (PARTITION BY day ORDER BY f) AS content_version, same AS same_as_previous FROM f""")
def w10_content_version(spark, d):
    s = table(spark, d, "events").selectExpr("CAST(ts AS DATE) AS day", "event_id", "ts", "concat(event_type, '-', CAST(floor(value / 20) AS BIGINT)) AS digest")
    return ops.content_versions(s, "day", ["ts", "event_id"], "digest").select("day", "event_id", F.col("content_version").cast("long").alias("content_version"), "same_as_previous")


@PLANS.add("""WITH l AS (SELECT match_id, label, snapshot_date, rank() OVER (PARTITION BY match_id ORDER BY snapshot_date DESC) AS r FROM pool)
    SELECT match_id, max(snapshot_date) AS snapshot_date, CASE WHEN count(DISTINCT label) = 1 THEN max(label) END AS label, CASE WHEN count(DISTINCT label) > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM l WHERE r = 1 GROUP BY match_id""")
def w11_latest_label(spark, d):
    return ops.latest_label(pool(spark, d), ["match_id"], "snapshot_date", "label")


@PLANS.add("SELECT match_id, snapshot_date, market, visible FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY snapshot_date DESC, visible DESC, market DESC) AS rn FROM pool) WHERE rn = 1")
def w12_newest_batch_wins(spark, d):
    rank = F.struct("snapshot_date", F.array("visible"), "market")
    w = Window.partitionBy("match_id").orderBy(rank.desc())
    return pool(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("match_id", "snapshot_date", "market", "visible")


@PLANS.add("SELECT event_id, lag(event_id) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS previous_id FROM events")
def w13_previous_snapshot(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.select("event_id", F.lag("event_id").over(Window.partitionBy("day", "event_type").orderBy("ts", "event_id")).alias("previous_id"))


_TAG = "CASE WHEN l IS NULL THEN 'FIRST' WHEN label <> l THEN 'LINE_SHIFT' WHEN abs(visible - v) >= 6 THEN 'WATER_STRUCTURE_SHIFT' WHEN abs(visible - v) > 1 THEN 'WATER_FINE_TUNE' ELSE 'NO_MATERIAL_CHANGE' END"


@PLANS.add(f"SELECT snapshot_date, match_id, market, {_TAG} AS tag FROM (SELECT *, lag(label) OVER w AS l, lag(visible) OVER w AS v FROM pool WINDOW w AS (PARTITION BY match_id, market ORDER BY snapshot_date))")
def w14_change_tags(spark, d):
    w = Window.partitionBy("match_id", "market").orderBy("snapshot_date")
    p = pool(spark, d).withColumn("l", F.lag("label").over(w)).withColumn("v", F.lag("visible").over(w))
    return p.select("snapshot_date", "match_id", "market", F.expr(_TAG).alias("tag"))


_EVAL = "SELECT p.match_id, p.market, p.snapshot_date AS seen_at, DATE '2024-01-01' + CAST(p.match_id % 30 AS INT) AS kickoff, p.label, CAST(p.match_id % 4 = 0 AS INT) AS outcome FROM pool p"


def _evaluations(spark, d):
    return pool(spark, d).selectExpr("match_id", "market", "snapshot_date AS at", "DATE '2024-01-01' + CAST(match_id % 30 AS INT) AS kickoff", "label", "CAST(match_id % 4 = 0 AS INT) AS outcome")


@PLANS.add(f"""WITH e AS ({_EVAL}), f AS (SELECT match_id, market, arg_min(label, seen_at) AS label, any_value(outcome) AS outcome FROM e WHERE seen_at < kickoff GROUP BY ALL)
    SELECT market, count(*) AS samples, count(*) FILTER (WHERE outcome = 0) AS hits, count(*) FILTER (WHERE outcome = 1) AS failures, round(count(*) FILTER (WHERE outcome = 0) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM f WHERE label = 1 GROUP BY market""")
def a19_label_statistics(spark, d):
    e = _evaluations(spark, d)
    frozen = ops.freeze_first(e, ["match_id", "market"], "at", "kickoff", "label").filter("label = 1")
    outcomes = e.select("match_id", "outcome").distinct()
    clean = outcomes.groupBy("match_id").agg(F.max("outcome").alias("outcome"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    g = frozen.join(clean, "match_id").groupBy("market").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("outcome") == 0).alias("hits"), F.count_if(F.col("outcome") == 1).alias("failures"))
    return g.withColumn("hit_rate", F.round(F.col("hits") / F.col("samples"), 6))


@PLANS.add("SELECT market, count(*) AS n, count(DISTINCT match_id) AS distinct_matches, count(*) - count(DISTINCT (match_id, snapshot_date)) AS duplicates, count(*) FILTER (WHERE label IS NULL) AS unknown, count(*) = count(*) FILTER (WHERE label IN (0, 1)) AS invariant_ok FROM pool GROUP BY market")
def a20_pool_qc(spark, d):
    return pool(spark, d).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("distinct_matches"), (F.count(F.lit(1)) - F.countDistinct("match_id", "snapshot_date")).alias("duplicates"), F.count_if(F.col("label").isNull()).alias("unknown"), (F.count(F.lit(1)) == F.count_if(F.col("label").isin(0, 1))).alias("invariant_ok"))


@PLANS.add("SELECT CASE WHEN label = 1 AND visible > 40 THEN 'A' WHEN label = 1 THEN 'B' WHEN visible > 10 THEN 'C' ELSE 'D' END AS bucket, count(*) AS n FROM pool GROUP BY ALL")
def a23_teacher_student_buckets(spark, d):
    return pool(spark, d).groupBy(F.expr("CASE WHEN label = 1 AND visible > 40 THEN 'A' WHEN label = 1 THEN 'B' WHEN visible > 10 THEN 'C' ELSE 'D' END").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@PLANS.add("SELECT p.match_id, p.market, p.snapshot_date, CASE WHEN m.match_id IS NULL THEN NULL WHEN (m.home_goals = m.away_goals) THEN 0 ELSE 1 END AS success FROM pool p LEFT JOIN (SELECT * FROM matches WHERE match_id % 2 = 0) m USING (match_id) WHERE p.label = 1")
def j11_teacher_evaluation(spark, d):
    m = matches(spark, d).filter("match_id % 2 = 0").select("match_id", (F.col("home_goals") == F.col("away_goals")).alias("draw"))
    return pool(spark, d).filter("label = 1").join(m, "match_id", "left").select("match_id", "market", "snapshot_date", F.when(F.col("draw").isNotNull(), (~F.col("draw")).cast("int")).alias("success"))


@PLANS.add("SELECT a.match_id, a.market, a.snapshot_date, a.label, round(b.value, 6) AS odds FROM pool a JOIN (SELECT CAST(ts AS DATE) AS snapshot_date, user_id AS match_id, event_type AS market, max(value) AS value FROM events GROUP BY ALL) b USING (match_id, market, snapshot_date)")
def j12_label_observation(spark, d):
    o = table(spark, d, "events").groupBy(F.to_date("ts").alias("snapshot_date"), F.col("user_id").alias("match_id"), F.col("event_type").alias("market")).agg(F.round(F.max("value"), 6).alias("odds"))
    return pool(spark, d).join(o, ["match_id", "market", "snapshot_date"]).select("match_id", "market", "snapshot_date", "label", "odds")


@PLANS.add("SELECT snapshot_date, match_id, max(label) FILTER (WHERE market = 'click') AS jc_label, max(label) FILTER (WHERE market = 'view') AS bd_label FROM pool WHERE market IN ('click', 'view') GROUP BY ALL")
def j13_market_layers(spark, d):
    p = pool(spark, d).filter(F.col("market").isin("click", "view"))
    return p.groupBy("snapshot_date", "match_id").pivot("market", ["click", "view"]).agg(F.max("label")).withColumnsRenamed({"click": "jc_label", "view": "bd_label"})


@PLANS.add("SELECT competition, count(*) AS covered FROM matches m WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = m.match_id AND l.l_returnflag = 'R') GROUP BY competition")
def j14_coverage_exists(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"))
    return matches(spark, d).join(li, "match_id", "left_semi").groupBy("competition").agg(F.count(F.lit(1)).alias("covered"))


@PLANS.add("SELECT p.match_id, p.market, m.competition, n.n_name AS region FROM pool p JOIN matches m USING (match_id) JOIN nation n ON n.n_nationkey = m.home_team WHERE p.label <> 1 AND m.season_start = 1997")
def j15_unresolved_report(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("home_team"), F.col("n_name").alias("region"))
    m = matches(spark, d).filter("season_start = 1997").select("match_id", "competition", "home_team")
    return pool(spark, d).filter("label <> 1").join(m, "match_id").join(F.broadcast(n), "home_team").select("match_id", "market", "competition", "region").orderBy("match_id", "market")


@PLANS.add("""WITH a AS (SELECT match_id, max(label) AS label FROM pool WHERE market = 'click' GROUP BY ALL), b AS (SELECT match_id, max(label) AS label FROM pool WHERE market = 'view' AND match_id % 2 = 0 GROUP BY ALL), c AS (SELECT match_id, min(label) AS label FROM pool WHERE market = 'error' GROUP BY ALL)
    SELECT match_id, coalesce(a.label, b.label, c.label) AS label, CASE WHEN a.label IS NOT NULL THEN 'snapshot' WHEN b.label IS NOT NULL THEN 'manual' ELSE 'screenshot' END AS label_source, concat_ws(',', CASE WHEN a.label IS NOT NULL THEN 'snapshot' END, CASE WHEN b.label IS NOT NULL THEN 'manual' END, CASE WHEN c.label IS NOT NULL THEN 'screenshot' END) AS provenance,
    CASE WHEN greatest(a.label, b.label, c.label) <> least(a.label, b.label, c.label) THEN 'FORENSIC_CONFLICT' ELSE 'OK' END AS status FROM a FULL JOIN b USING (match_id) FULL JOIN c USING (match_id)""")
def j22_j23_label_precedence(spark, d):
    p = pool(spark, d)
    a = p.filter("market = 'click'").groupBy("match_id").agg(F.max("label").alias("label"))
    b = p.filter("market = 'view' AND match_id % 2 = 0").groupBy("match_id").agg(F.max("label").alias("label"))
    c = p.filter("market = 'error'").groupBy("match_id").agg(F.min("label").alias("label"))
    return ops.merge_by_precedence([("snapshot", a), ("manual", b), ("screenshot", c)], ["match_id"], "label")


@PLANS.add("""WITH j AS (SELECT match_id, max(label) AS j FROM pool WHERE market = 'click' AND match_id % 3 > 0 GROUP BY ALL), b AS (SELECT match_id, min(label) AS b FROM pool WHERE market = 'view' AND match_id % 5 > 0 GROUP BY ALL)
    SELECT match_id, j AS jc_label, b AS bd_label, CASE WHEN j = 1 AND b = 1 THEN 'STRONG_EXCLUDE' WHEN j = 1 THEN 'EXCLUDE' WHEN j = 0 THEN 'NO_EXCLUSION_SIGNAL' ELSE 'UNKNOWN' END AS signal, coalesce(j = 1 AND b = 0, false) AS counterevidence, coalesce(b = 1 AND j IS DISTINCT FROM 1, false) AS risk_hint FROM j FULL JOIN b USING (match_id)""")
def j24_combined_signal(spark, d):
    p = pool(spark, d)
    j = p.filter("market = 'click' AND match_id % 3 > 0").groupBy("match_id").agg(F.max("label").alias("jc_label"))
    b = p.filter("market = 'view' AND match_id % 5 > 0").groupBy("match_id").agg(F.min("label").alias("bd_label"))
    jl, bl = F.col("jc_label"), F.col("bd_label")
    return j.join(b, "match_id", "full_outer").select("match_id", "jc_label", "bd_label", ops.reference_signal(jl, bl).alias("signal"), F.coalesce((jl == 1) & (bl == 0), F.lit(False)).alias("counterevidence"), F.coalesce((bl == 1) & ~jl.eqNullSafe(F.lit(1)), F.lit(False)).alias("risk_hint"))


@PLANS.add("SELECT m.competition, CASE l.l_returnflag WHEN 'A' THEN '1x2' WHEN 'N' THEN 'ah' ELSE 'ou' END AS market, count(*) AS attached FROM matches m JOIN lineitem l ON l.l_orderkey = m.match_id GROUP BY ALL")
def j25_timeline_ingestion(spark, d):
    return _attached(spark, d, matches(spark, d))


def _attached(spark, d, wanted):
    from oddsloom.sources.bind import quotes

    resolved = wanted.select("match_id", "competition")
    return quotes(spark, d).join(resolved, "match_id").groupBy("competition", "market").agg(F.count(F.lit(1)).alias("attached"))


@PLANS.add("SELECT snapshot_date, n, h, h IS NOT DISTINCT FROM lag(h) OVER (ORDER BY snapshot_date) AS no_change FROM (SELECT snapshot_date, count(*) AS n, CAST(sum(label) % 7 AS BIGINT) AS h FROM pool GROUP BY snapshot_date)")
def k02_no_change_detection(spark, d):
    g = pool(spark, d).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), (F.sum("label") % 7).alias("h"))
    return g.withColumn("no_change", F.lag("h").over(Window.orderBy("snapshot_date")).eqNullSafe(F.col("h")))


@PLANS.add("SELECT market, visible AS content_hash, max(snapshot_date) AS last_seen, count(*) AS times FROM pool GROUP BY ALL")
def k03_history_upsert(spark, d):
    p = pool(spark, d).withColumnRenamed("visible", "content_hash")
    w = Window.partitionBy("market", "content_hash").orderBy(F.desc("snapshot_date"))
    times = F.count(F.lit(1)).over(Window.partitionBy("market", "content_hash"))
    return p.withColumn("rn", F.row_number().over(w)).withColumn("times", times).filter("rn = 1").select("market", "content_hash", F.col("snapshot_date").alias("last_seen"), "times")


@PLANS.add("SELECT market, count(DISTINCT (user_id, d)) AS inserted, count(*) - count(DISTINCT (user_id, d)) AS ignored FROM (SELECT event_type AS market, user_id, CAST(ts AS DATE) AS d FROM events WHERE value > 1) GROUP BY market")
def k07_insert_or_ignore(spark, d):
    e = table(spark, d, "events").filter("value > 1").withColumn("event_key", F.sha2(F.concat_ws("|", "event_type", "user_id", F.to_date("ts")), 256))
    kept = e.dropDuplicates(["event_key"]).groupBy(F.col("event_type").alias("market")).agg(F.count(F.lit(1)).alias("inserted"))
    return kept.join(e.groupBy(F.col("event_type").alias("market")).agg(F.count(F.lit(1)).alias("n")), "market").select("market", "inserted", (F.col("n") - F.col("inserted")).alias("ignored"))


@PLANS.add("SELECT match_id, market, arg_max(label, snapshot_date) FILTER (WHERE label IS NOT NULL) AS label, arg_min(visible, snapshot_date) FILTER (WHERE visible IS NOT NULL) AS first_visible FROM pool GROUP BY ALL")
def k08_evaluation_upsert(spark, d):
    """All days upserted in turn: the last label replaces earlier ones, what was visible first is preserved."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("snapshot_date"))
    return pool(spark, d).groupBy("match_id", "market").agg(F.max_by("label", known("label")).alias("label"), F.min_by("visible", known("visible")).alias("first_visible"))


@PLANS.add("SELECT 'match' AS target, count(DISTINCT match_id) AS n FROM pool UNION ALL SELECT 'snapshot', count(DISTINCT snapshot_date) FROM pool UNION ALL SELECT 'label', count(*) FROM pool WHERE label IS NOT NULL UNION ALL SELECT 'visible_odds', count(*) FROM pool WHERE visible IS NOT NULL")
def k09_star_load(spark, d):
    p = pool(spark, d)
    return p.select(F.expr("stack(4, 'match', CAST(match_id AS STRING), 'snapshot', CAST(snapshot_date AS STRING), 'label', IF(label IS NULL, NULL, concat_ws('|', snapshot_date, match_id, market)), 'visible_odds', IF(visible IS NULL, NULL, concat_ws('|', snapshot_date, match_id, market))) AS (target, key)")).filter("key IS NOT NULL").groupBy("target").agg(F.countDistinct("key").alias("n"))
