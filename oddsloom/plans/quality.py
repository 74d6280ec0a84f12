"""Data quality and batch health (Q-01..11, A-04, U-02, U-03, T-03, K-01, K-04..06, S-01, S-08)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.functions import odds, redaction
from oddsloom.operators import health
from oddsloom.sources.bind import matches, quotes, table

from .registry import Plans

PLANS = Plans()
_OVER = "1/p_home + 1/p_draw + 1/p_away - 1"


def profile(df, name: str):
    """Per column of a table: rows, nulls and distinct kinds of cell, by one aggregation."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]
    cells = df.select(F.expr("stack({}, {}) AS (column, cell)".format(len(cols), ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols))))
    kind = F.when(F.col("cell").isNull(), "null").when(F.col("cell").rlike(r"^-?\d+$"), "integer").when(F.col("cell").try_cast("double").isNotNull(), "number").otherwise("string")
    return cells.groupBy("column", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))


@PLANS.add("""SELECT 'customer' AS "table", col AS "column", CASE WHEN cell IS NULL THEN 'null' WHEN regexp_full_match(cell, '-?\\d+') THEN 'integer' WHEN TRY_CAST(cell AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS kind, count(*) AS n FROM
    (SELECT 'c_custkey' AS col, CAST(c_custkey AS VARCHAR) AS cell FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) GROUP BY ALL""")
def q03_cell_kinds(spark, d):
    return profile(table(spark, d, "customer"), "customer")


_WANT = [("c_custkey", "integer", None), ("c_name", "number", None), ("c_segment", "string", "c_mktsegment"), ("c_acctbal", "number", None), ("c_phone", "string", None)]


@PLANS.add("""WITH want AS (SELECT * FROM (VALUES ('c_custkey', 'integer', NULL), ('c_name', 'number', NULL), ('c_segment', 'string', 'c_mktsegment'), ('c_acctbal', 'number', NULL), ('c_phone', 'string', NULL)) t(col, want, renamed)), has AS (SELECT column_name AS col FROM duckdb_columns() WHERE table_name = 'customer'),
    cells AS (SELECT 'c_name' AS col, c_name AS cell FROM customer UNION ALL SELECT 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer),
    kinds AS (SELECT col, avg(CASE WHEN want = 'integer' THEN regexp_full_match(cell, '-?\\d+')::INT ELSE (TRY_CAST(cell AS DOUBLE) IS NOT NULL)::INT END) AS fits FROM cells JOIN want USING (col) GROUP BY col)
    SELECT w.col, CASE WHEN w.renamed IN (SELECT col FROM has) THEN 'RENAMED_COLUMN' ELSE 'MISSING_COLUMN' END AS code, CASE WHEN w.renamed IN (SELECT col FROM has) THEN 'WARN' ELSE 'FAIL' END AS severity FROM want w WHERE w.col NOT IN (SELECT col FROM has)
    UNION ALL SELECT col, 'UNKNOWN_COLUMN', 'INFO' FROM has WHERE col NOT IN (SELECT col FROM want) AND col NOT IN (SELECT renamed FROM want WHERE renamed IS NOT NULL) UNION ALL SELECT col, 'TYPE_DRIFT', 'WARN' FROM kinds WHERE fits < 0.8e0
    UNION ALL SELECT 'c_nationkey', 'DUPLICATE_KEY', 'FAIL' FROM customer HAVING count(DISTINCT c_nationkey) < count(c_nationkey) UNION ALL SELECT 'c_custkey', 'DUPLICATE_KEY', 'FAIL' FROM customer HAVING count(DISTINCT c_custkey) < count(c_custkey) UNION ALL SELECT 'c_custkey', 'ALL_NULL_KEY', 'FAIL' FROM customer HAVING count(c_custkey) = 0""")
def q01_u02_schema_drift(spark, d):
    """Columns that are missing, renamed, unknown or of another type, and keys that are null throughout or repeat."""
    df = table(spark, d, "customer")
    expected = spark.createDataFrame(_WANT, "col string, want string, renamed string")
    seen = profile(df, "customer").groupBy(F.col("column").alias("col")).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    names = [c.name for c in df.schema]
    both = expected.join(seen, "col", "full_outer").join(expected.filter("renamed IS NOT NULL").select(F.col("renamed").alias("col"), F.lit(True).alias("known")), "col", "left")
    n = F.coalesce(F.try_element_at("kinds", F.col("want")), F.lit(0)) + F.when(F.col("want") == "number", F.coalesce(F.try_element_at("kinds", F.lit("integer")), F.lit(0))).otherwise(0)
    missing = F.when(F.col("renamed").isin(names), "RENAMED_COLUMN").otherwise("MISSING_COLUMN")
    code = F.when(F.col("all").isNull(), missing).when(F.col("want").isNull() & F.col("known").isNull(), "UNKNOWN_COLUMN").when(F.col("want").isNotNull() & (n < 0.8 * F.col("all")), "TYPE_DRIFT")
    columns = both.select("col", code.alias("code"))
    keys = df.select(F.expr("stack(2, 'c_custkey', CAST(c_custkey AS STRING), 'c_nationkey', CAST(c_nationkey AS STRING)) AS (col, key)")).groupBy("col", "key").count()
    of = keys.groupBy("col").agg(F.max(F.when(F.col("key").isNotNull(), F.col("count"))).alias("most"))
    broken = of.select("col", F.when(F.col("most").isNull(), "ALL_NULL_KEY").when(F.col("most") > 1, "DUPLICATE_KEY").alias("code"))
    severity = F.when(F.col("code").isin("MISSING_COLUMN", "ALL_NULL_KEY", "DUPLICATE_KEY"), "FAIL").when(F.col("code") == "UNKNOWN_COLUMN", "INFO").otherwise("WARN")
    return columns.unionByName(broken).filter("code IS NOT NULL").withColumn("severity", severity)


@PLANS.add("SELECT n_nationkey AS id, 'PROTECTED_IDENTITY_CHANGED' AS code FROM nation WHERE n_nationkey < 10 AND n_nationkey % 4 = 1 UNION ALL SELECT 99, 'PROTECTED_IDENTITY_MISSING'")
def q02_protected_identity(spark, d):
    n = table(spark, d, "nation")
    expected = n.filter("n_nationkey < 10").selectExpr("n_nationkey AS id", "IF(n_nationkey % 4 = 1, concat(n_name, '?'), n_name) AS want").union(spark.range(1).selectExpr("99", "'x'"))
    j = expected.join(n, F.col("id") == F.col("n_nationkey"), "left").filter("n_name IS NULL OR n_name <> want")
    return j.select("id", F.when(F.col("n_name").isNull(), "PROTECTED_IDENTITY_MISSING").otherwise("PROTECTED_IDENTITY_CHANGED").alias("code"))


# what the feed would say of each quote, derived from its row
_FLAGS = f"""f AS (SELECT *, p_home < 1.35e0 AS impossible, {_OVER} AS over, CASE WHEN source_row % 211 = 0 THEN 1 + {_OVER} ELSE 1e0 END AS devig_sum, source_row % 53 = 0 AS conflict, book_id < 3 AS core, source_row % 97 = 0 AS foreign_row FROM quotes),
    c AS (SELECT match_id, count(*) AS n FROM (SELECT match_id, book_id, market, ts, line_q FROM f GROUP BY ALL HAVING count(DISTINCT {{'h': p_home, 'd': p_draw, 'a': p_away}}) > 1) GROUP BY match_id),
    o AS (SELECT match_id, count(*) AS n FROM (SELECT match_id, book_id, market FROM (SELECT *, lag(ts) OVER (PARTITION BY match_id, book_id, market ORDER BY seq, source_row) AS before FROM f) GROUP BY ALL HAVING bool_or(ts < before)) GROUP BY match_id)"""


def _flagged(spark, d):
    over = odds.overround(F.array("p_home", "p_draw", "p_away"))
    q = quotes(spark, d).withColumn("over", over).withColumnRenamed("source_row", "row_no")
    return q.select("match_id", "book_id", "market", "ts", "seq", "row_no", F.col("line_q").alias("line"), F.struct("p_home", "p_draw", "p_away").alias("prices"), (F.col("p_home") < 1.35).alias("impossible"), "over", F.when(F.col("row_no") % 211 == 0, 1 + F.col("over")).otherwise(F.lit(1.0)).alias("devig_sum"), (F.col("row_no") % 53 == 0).alias("conflict"), (F.col("book_id") < 3).alias("core"), (F.col("row_no") % 97 == 0).alias("foreign_row"))


@PLANS.add(f"""WITH {_FLAGS}, m AS (SELECT match_id, count(*) FILTER (WHERE impossible) AS impossible, count(*) FILTER (WHERE abs(devig_sum - 1) > 1e-9) AS bad_sum, count(*) FILTER (WHERE market = '1x2' AND over > 0.25e0) AS extreme, count(*) FILTER (WHERE conflict) AS conflict, count(*) FILTER (WHERE conflict AND core) AS core_conflict, count(*) FILTER (WHERE foreign_row) AS contaminated FROM f GROUP BY match_id)
    SELECT match_id, 'IMPOSSIBLE_ODDS_OR_LINE' AS code, 'WARN' AS severity, impossible AS n FROM m WHERE impossible > 0 UNION ALL SELECT match_id, 'DEVIG_SUM_INVALID', 'FAIL', bad_sum FROM m WHERE bad_sum > 0 UNION ALL SELECT match_id, 'EXTREME_OVERROUND', 'WARN', extreme FROM m WHERE extreme > 0
    UNION ALL SELECT match_id, CASE WHEN core_conflict > 0 THEN 'CORE_BOOKMAKER_IDENTITY_CONFLICT' ELSE 'BOOKMAKER_IDENTITY_CONFLICT' END, CASE WHEN core_conflict > 0 THEN 'FAIL' ELSE 'WARN' END, conflict FROM m WHERE conflict > 0 UNION ALL SELECT match_id, 'CROSS_MATCH_CONTAMINATION', 'FAIL', contaminated FROM m WHERE contaminated > 0
    UNION ALL SELECT match_id, 'CONFLICTING_DUPLICATE', 'WARN', n FROM c UNION ALL SELECT match_id, 'TIMELINE_SOURCE_REVERSE_ORDER', 'WARN', n FROM o""")
def q04_semantic_events(spark, d):
    return health.semantic_events(_flagged(spark, d))


@PLANS.add("""WITH s AS (SELECT m.match_id, b.book_id, CASE WHEN count(q.ts) = 0 THEN 'BROKEN' WHEN count(q.ts) < 2 OR count(*) FILTER (WHERE q.seq = 1) = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM (SELECT DISTINCT match_id FROM quotes) m CROSS JOIN (SELECT unnest([0, 1, 2]) AS book_id) b LEFT JOIN quotes q USING (match_id, book_id) GROUP BY ALL)
    SELECT match_id, count(*) FILTER (WHERE state = 'BROKEN') AS broken, CASE WHEN count(*) FILTER (WHERE state = 'BROKEN') >= 0.5 * count(*) THEN 'BROKEN' WHEN count(*) FILTER (WHERE state = 'COMPLETE') = count(*) THEN 'COMPLETE' ELSE 'PARTIAL' END AS overall FROM s GROUP BY match_id""")
def q05_timeline_state(spark, d):
    q = quotes(spark, d)
    core = spark.range(3).toDF("book_id")
    g = q.groupBy("match_id", "book_id").agg(F.count("ts").alias("n"), F.count_if(F.col("seq") == 1).alias("opening"))
    s = q.select("match_id").distinct().crossJoin(F.broadcast(core)).join(g, ["match_id", "book_id"], "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "BROKEN").when((F.col("n") < 2) | (F.col("opening") == 0), "PARTIAL").otherwise("COMPLETE")
    out = s.withColumn("state", state).groupBy("match_id").agg(F.count_if(F.col("state") == "BROKEN").alias("broken"), F.count_if(F.col("state") == "COMPLETE").alias("complete"), F.count(F.lit(1)).alias("n"))
    return out.select("match_id", "broken", F.when(F.col("broken") >= 0.5 * F.col("n"), "BROKEN").when(F.col("complete") == F.col("n"), "COMPLETE").otherwise("PARTIAL").alias("overall"))


@PLANS.add("SELECT match_id, count(DISTINCT line_q) AS lines, count(*) FILTER (WHERE seq = 1) AS main_rows, count(*) FILTER (WHERE seq > 1) AS alt_rows, CASE WHEN count(DISTINCT line_q) >= 2 AND count(*) FILTER (WHERE seq = 1) > 0 AND count(*) FILTER (WHERE seq > 1) > 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM quotes WHERE market = 'ou' GROUP BY match_id")
def q07_ladder_completeness(spark, d):
    g = quotes(spark, d).filter("market = 'ou'").groupBy("match_id").agg(F.countDistinct("line_q").alias("lines"), F.count_if(F.col("seq") == 1).alias("main_rows"), F.count_if(F.col("seq") > 1).alias("alt_rows"))
    return g.withColumn("status", F.when((F.col("lines") >= 2) & (F.col("main_rows") > 0) & (F.col("alt_rows") > 0), "COMPLETE").otherwise("INCOMPLETE"))


_BATCH = "SELECT CAST(date_trunc('month', ts) AS DATE) AS batch, count(*) AS n, count(DISTINCT book_id) / 6e0 AS cov, avg((source_row % 13 = 0)::INT) AS missing FROM quotes GROUP BY 1"


def _batches(spark, d):
    return quotes(spark, d).groupBy(F.date_trunc("month", "ts").cast("date").alias("batch")).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("book_id") / 6).alias("cov"), F.avg((F.col("source_row") % 13 == 0).cast("int")).alias("missing"))


@PLANS.add(f"SELECT batch, n, round(avg(n) OVER (ORDER BY batch ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM ({_BATCH})")
def a04_trailing_baseline(spark, d):
    w = Window.orderBy("batch").rowsBetween(-5, -1)
    return _batches(spark, d).select("batch", "n", F.round(F.avg("n").over(w), 6).alias("baseline"))


_RATES = f"""{_FLAGS}, b AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS batch, match_id, book_id, market, line_q, ts, impossible, source_row % 3 = 0 AND extract(month FROM ts) % 2 = 0 OR source_row % 7 > 0 AND extract(month FROM ts) = 7 AS no_time, {{'h': p_home, 'd': p_draw, 'a': p_away}} AS prices FROM f),
    r AS (SELECT batch, count(*) AS records, count(DISTINCT match_id) AS matches, avg(impossible::INT) AS impossible, avg(no_time::INT) AS missing, count(*) / CAST(count(DISTINCT match_id) AS DOUBLE) AS rows_per_match FROM b GROUP BY batch),
    d AS (SELECT batch, count(*) AS groups FROM (SELECT batch, match_id, book_id, market, ts, line_q FROM b GROUP BY ALL HAVING count(DISTINCT prices) > 1) GROUP BY batch),
    k AS (SELECT batch, market, book_id, count(DISTINCT match_id) AS covered FROM b GROUP BY ALL), v AS (SELECT k.batch, market, book_id, covered / CAST(matches AS DOUBLE) AS cov FROM k JOIN r USING (batch))"""
_TRAIL = "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING"


@PLANS.add(f"""WITH {_RATES}, t AS (SELECT *, avg(rows_per_match) OVER (ORDER BY batch {_TRAIL}) AS base FROM r), u AS (SELECT *, avg(cov) OVER (PARTITION BY market, book_id ORDER BY batch {_TRAIL}) AS base FROM v)
    SELECT batch, 'HISTORICAL_BASELINE_UNAVAILABLE' AS code, 'INFO' AS severity, CAST(NULL AS VARCHAR) AS what FROM t WHERE base IS NULL
    UNION ALL SELECT batch, 'STRUCTURAL_DEGRADATION_ALERT', CASE WHEN (base - rows_per_match) / base >= 0.70e0 THEN 'FAIL' ELSE 'WARN' END, NULL FROM t WHERE (base - rows_per_match) / base >= 0.45e0
    UNION ALL SELECT batch, 'COVERAGE_DROP_ALERT', CASE WHEN cov - base <= -0.50e0 AND base >= 0.80e0 THEN 'FAIL' ELSE 'WARN' END, market || ':' || book_id FROM u WHERE cov - base < -0.25e0
    UNION ALL SELECT batch, CASE WHEN missing >= 0.80e0 THEN 'TIMESTAMP_FORMAT_OR_PARSE_FAILURE' ELSE 'MISSING_TIMESTAMPS_HIGH' END, CASE WHEN missing >= 0.80e0 THEN 'FAIL' ELSE 'WARN' END, NULL FROM r WHERE missing >= 0.30e0
    UNION ALL SELECT batch, 'IMPOSSIBLE_ODDS_WIDESPREAD', 'FAIL', NULL FROM r WHERE impossible >= 0.10e0
    UNION ALL SELECT batch, 'CONFLICTING_DUPLICATES_WIDESPREAD', 'FAIL', NULL FROM r JOIN d USING (batch) WHERE groups / CAST(records AS DOUBLE) >= 0.05e0""")
def q08_batch_health(spark, d):
    """Rates and drops of every month's batch against the mean of the five before it."""
    month = F.month("ts")
    no_time = ((F.col("row_no") % 3 == 0) & (month % 2 == 0)) | ((F.col("row_no") % 7 > 0) & (month == 7))
    rows = _flagged(spark, d).withColumn("batch", F.date_trunc("month", "ts").cast("date")).withColumn("no_time", no_time)
    return health.batch_events(rows)


@PLANS.add(f"""WITH b AS (SELECT *, avg(n) OVER w AS base, avg(cov) OVER w AS bcov FROM ({_BATCH}) WINDOW w AS (ORDER BY batch ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT batch, CASE WHEN base IS NULL THEN 'HISTORICAL_BASELINE_UNAVAILABLE' WHEN (base - n) / base >= 0.70 THEN 'STRUCTURE_FAIL' WHEN (base - n) / base >= 0.45 THEN 'STRUCTURE_WARN' WHEN cov - bcov <= -0.25 THEN 'COVERAGE_DROP' WHEN missing >= 0.3 THEN 'MISSING_TIMESTAMPS_HIGH' ELSE 'OK' END AS status FROM b""")
def q08_history_drops(spark, d):
    w = Window.orderBy("batch").rowsBetween(-5, -1)
    b = _batches(spark, d).withColumn("base", F.avg("n").over(w)).withColumn("bcov", F.avg("cov").over(w))
    return b.select("batch", F.expr("CASE WHEN base IS NULL THEN 'HISTORICAL_BASELINE_UNAVAILABLE' WHEN (base - n) / base >= 0.70 THEN 'STRUCTURE_FAIL' WHEN (base - n) / base >= 0.45 THEN 'STRUCTURE_WARN' WHEN cov - bcov <= -0.25 THEN 'COVERAGE_DROP' WHEN missing >= 0.3 THEN 'MISSING_TIMESTAMPS_HIGH' ELSE 'OK' END").alias("status"))


_EV = "SELECT event_type AS code, user_id AS match_id, CASE WHEN value > 60 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS level FROM events"


@PLANS.add(f"""WITH u AS (SELECT code, match_id, max(level) AS level FROM ({_EV}) GROUP BY ALL) SELECT match_id, CASE WHEN max(level) = 2 THEN 'FAIL' WHEN count(*) FILTER (WHERE level = 1) > 2 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (WHERE level = 1) AS warnings,
    coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE level = 2), '') AS fail_codes FROM u GROUP BY match_id""")
def q09_t03_rule_rollup(spark, d):
    e = table(spark, d, "events").selectExpr("event_type AS code", "user_id AS match_id", "CASE WHEN value > 60 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS level")
    u = e.groupBy("code", "match_id").agg(F.max("level").alias("level"))
    g = u.groupBy("match_id").agg(F.max("level").alias("top"), F.count_if(F.col("level") == 1).alias("warnings"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("level") == 2, F.col("code"))))).alias("fail_codes"))
    return g.select("match_id", F.when(F.col("top") == 2, "FAIL").when(F.col("warnings") > 2, "WARN").otherwise("PASS").alias("status"), "warnings", "fail_codes")


@PLANS.add("""SELECT match_id, concat_ws(',', CASE WHEN match_id % 2 = 0 THEN 'lineups' END, CASE WHEN match_id % 3 = 0 THEN 'market' END, CASE WHEN match_id % 5 = 0 AND competition = '1-URGENT' THEN 'tie_state' END) AS missing, CASE WHEN match_id % 2 = 0 OR match_id % 3 = 0 OR (match_id % 5 = 0 AND competition = '1-URGENT') THEN 'BLOCKED' ELSE 'PASS' END AS status FROM matches""")
def q10_required_flags(spark, d):
    flags = "map('lineups', match_id % 2 <> 0, 'market', match_id % 3 <> 0, 'tie_state', match_id % 5 <> 0)"
    m = matches(spark, d).selectExpr("match_id", f"{flags} AS flags", "IF(competition = '1-URGENT', array('lineups', 'market', 'tie_state'), array('lineups', 'market')) AS required")
    missing = F.array_except("required", F.map_keys(F.map_filter("flags", lambda _, v: v)))
    return m.select("match_id", F.concat_ws(",", missing).alias("missing"), F.when(F.size(missing) > 0, "BLOCKED").otherwise("PASS").alias("status"))


@PLANS.add("""WITH s AS (SELECT *, 1/p_home + 1/p_draw + 1/p_away AS t, lag(ts) OVER (PARTITION BY match_id, book_id, market ORDER BY seq, source_row, ts) AS was FROM quotes) SELECT count(*) AS quotes, count(*) FILTER (WHERE abs((1/p_home)/t + (1/p_draw)/t + (1/p_away)/t - 1) > 1e-12) AS bad_sums,
    count(*) FILTER (WHERE ts < was) AS unsorted, (SELECT count(*) FROM quotes ANTI JOIN (SELECT match_id FROM matches WHERE match_id % 5 > 0) USING (match_id)) AS foreign_quotes FROM s""")
def q11_packet_invariants(spark, d):
    """Probabilities that do not sum to 1, steps back in a book's timeline, and quotes of matches outside the packet's selection."""
    q = quotes(spark, d)
    s = odds.total(odds.devig_multiplicative(F.array("p_home", "p_draw", "p_away")))
    was = F.lag("ts").over(Window.partitionBy("match_id", "book_id", "market").orderBy("seq", "source_row", "ts"))
    foreign = q.join(matches(spark, d).filter("match_id % 5 > 0"), "match_id", "left_anti").agg(F.count(F.lit(1)).alias("foreign_quotes"))
    return q.withColumn("was", was).agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.abs(s - 1) > 1e-12).alias("bad_sums"), F.count_if(F.col("ts") < F.col("was")).alias("unsorted")).crossJoin(foreign)


@PLANS.add("WITH a AS (SELECT DISTINCT match_id FROM quotes), b AS (SELECT match_id FROM matches) SELECT (SELECT count(*) FROM a WHERE match_id NOT IN (SELECT match_id FROM b)) AS orphan_ids, (SELECT count(*) FROM b WHERE match_id NOT IN (SELECT match_id FROM a)) AS missing_ids, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS counts_equal")
def u03_packet_ids(spark, d):
    a = quotes(spark, d).select("match_id").distinct().withColumn("a", F.lit(1))
    both = a.join(matches(spark, d).select("match_id").withColumn("b", F.lit(1)), "match_id", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("orphan_ids"), F.count_if(F.col("a").isNull()).alias("missing_ids"), (F.count("a") == F.count("b")).alias("counts_equal"))


@PLANS.add("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS declared_ok UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) = count(DISTINCT n_nationkey) FROM nation)")
def s01_declared_counts(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("declared")).select("table_name", "n", (F.col("n") == F.col("declared")).alias("declared_ok")) for t, k in (("orders", "o_orderkey"), ("nation", "n_nationkey"))]
    return parts[0].unionByName(parts[1])


@PLANS.add("SELECT 'orders' AS source_table, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey) FROM customer")
def s01_checked_scan(spark, d):
    """Tables with lineage, staged under the counts of a manifest (here from the files' footers): a wrong count would raise."""
    import uuid

    from oddsloom.plans.ingest import shared_folder
    from oddsloom.sources import declared

    keys = {"orders": "o_orderkey", "nation": "n_nationkey", "customer": "c_custkey"}
    manifest = spark.createDataFrame([(t, table(spark, d, t).count()) for t in keys], "table string, rows long")
    staged = declared.stage(spark, {t: declared.scan(spark, f"{d}/{t}.parquet", t) for t in keys}, manifest, f"{shared_folder(spark)}/staged/{uuid.uuid4().hex[:12]}")
    out = None
    for t, k in keys.items():
        part = staged[t].groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


@PLANS.add("SELECT count(*) AS n, count(*) FILTER (WHERE kickoff IS NULL) AS null_kickoff, CAST(min(kickoff) AS DATE) AS first_day, CAST(max(kickoff) AS DATE) AS last_day, count(*) FILTER (WHERE home_team = away_team) AS self_matches FROM matches")
def s08_dataset_audit(spark, d):
    return matches(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kickoff").isNull()).alias("null_kickoff"), F.min("kickoff").cast("date").alias("first_day"), F.max("kickoff").cast("date").alias("last_day"), F.count_if(F.col("home_team") == F.col("away_team")).alias("self_matches"))


_REQUIRED = ("match_id", "kickoff", "competition", "home_team", "away_team", "home_goals", "away_goals", "referee")


@PLANS.add("WITH n AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR match_id % {k + 5} = 0) AS n_{c}" for k, c in enumerate(_REQUIRED[:-1])) + " FROM matches) " + " UNION ALL ".join(f"SELECT '{c}' AS field, n, n_{c} AS nulls, false AS missing FROM n" for c in _REQUIRED[:-1]) + " UNION ALL SELECT 'referee', n, n, true FROM n")
def s08_field_audit(spark, d):
    """Nulls of every required field (here some are made null), and required fields that the table does not have."""
    m = matches(spark, d)
    m = m.select(*(F.when(F.col("match_id") % (k + 5) != 0, F.col(c)).alias(c) for k, c in enumerate(_REQUIRED[:-1])))
    return field_audit(m, _REQUIRED)


def field_audit(rows, required):
    """(field, n, nulls, missing): one aggregation; a field that is missing is null throughout."""
    has = set(rows.columns)
    g = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in required if c in has))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col("n").alias("n"), (F.col(f"n_{c}") if c in has else F.col("n")).alias("nulls"), F.lit(c not in has).alias("missing")) for c in required))
    return g.select(F.explode(each).alias("x")).select("x.*")


_RESULTS = "SELECT match_id, kickoff, competition, home_team, away_team, CASE WHEN match_id % 11 = 0 THEN NULL ELSE home_goals END AS home_goals FROM matches UNION ALL SELECT match_id, kickoff, competition, home_team, away_team, home_goals + 1 FROM matches WHERE match_id % 10 = 1 UNION ALL SELECT match_id + 100000000, kickoff, competition, home_team, away_team, home_goals FROM matches WHERE match_id % 7 = 2"


@PLANS.add(f"""WITH r AS ({_RESULTS}), a AS (SELECT *, home_goals IS NULL AS invalid, row_number() OVER (PARTITION BY match_id, home_goals IS NULL ORDER BY kickoff, home_goals) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY competition, kickoff, home_team, away_team, invalid OR k > 1 ORDER BY match_id) AS f FROM a)
    SELECT CASE WHEN invalid THEN 'INVALID' WHEN k > 1 THEN 'DUPLICATE_ID' WHEN f > 1 THEN 'DUPLICATE_FIXTURE' ELSE 'KEPT' END AS cause, count(*) AS n FROM b GROUP BY 1""")
def s09_drop_causes(spark, d):
    """What a results scan drops and why: invalid rows first, then later rows of an id, then later rows of a fixture."""
    m = matches(spark, d).select("match_id", "kickoff", "competition", "home_team", "away_team", "home_goals")
    made = m.withColumn("home_goals", F.when(F.col("match_id") % 11 != 0, F.col("home_goals")))
    made = made.unionByName(m.filter("match_id % 10 = 1").withColumn("home_goals", F.col("home_goals") + 1)).unionByName(m.filter("match_id % 7 = 2").withColumn("match_id", F.col("match_id") + 100000000))
    return drop_causes(made).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def drop_causes(results):
    """``results`` with the cause for which a row is dropped, or KEPT. Rows that are out already never stand for an id or fixture."""
    a = results.withColumn("invalid", F.col("home_goals").isNull())
    a = a.withColumn("k", F.row_number().over(Window.partitionBy("match_id", "invalid").orderBy("kickoff", "home_goals")))
    b = a.withColumn("f", F.row_number().over(Window.partitionBy("competition", "kickoff", "home_team", "away_team", F.col("invalid") | (F.col("k") > 1)).orderBy("match_id")))
    return b.withColumn("cause", F.when(F.col("invalid"), "INVALID").when(F.col("k") > 1, "DUPLICATE_ID").when(F.col("f") > 1, "DUPLICATE_FIXTURE").otherwise("KEPT")).drop("invalid", "k", "f")


@PLANS.add("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS record_json FROM nation")
def k05_record_export(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct(*sorted(n.columns))).alias("record_json"))


_EXPORTED = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:s o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:s",
}


def _export_sql() -> str:
    parts = []
    for t, columns in _EXPORTED.items():
        fields = [f"""'"{c}":{'"' if k == "s" else ""}' || {f'replace(CAST({c} AS VARCHAR), chr(34), chr(92) || chr(34))' if k == "s" else f'CAST({c} AS VARCHAR)'} || '{'"' if k == "s" else ""}'""" for c, k in sorted(x.split(":") for x in columns.split())]
        parts.append(f"""SELECT '{t}' AS "table", '{{' || {" || ',' || ".join(fields)} || '}}' AS record_json FROM {t}""")
    return " UNION ALL ".join(parts)


def export_records(tables):
    """(table, record_json) of every row of ``tables`` (name -> rows): sorted keys, secrets redacted, times as text."""
    out = None
    for name, rows in tables.items():
        clean = redaction.redacted(rows.select(*(F.col(c).cast("string").alias(c) if t.startswith(("timestamp", "date")) else F.col(c) for c, t in rows.dtypes)))
        part = clean.select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(rows.columns))).alias("record_json"))
        out = part if out is None else out.unionByName(part)
    return out


@PLANS.add(_export_sql())
def k05_export_tables(spark, d):
    """All tables of the star as one feed of redacted records."""
    return export_records({t: table(spark, d, t) for t in _EXPORTED})


def content_hash(rows):
    """One row, content_hash: of a table's rows in any order, by sums of the words of their sha256, which combine before the shuffle."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    words = rows.select(*(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(8)))
    sums = words.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(f"w{k}").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"w{k}") for k in range(8)))
    return sums.select(F.sha2(F.concat_ws("|", "n", *(f"w{k}" for k in range(8))), 256).alias("content_hash"))


@PLANS.add()
def k06_content_hash(spark, d):
    """An order-free hash of a table's content."""
    return content_hash(table(spark, d, "orders"))
