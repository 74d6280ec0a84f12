"""Quotes: identity, deduplication, movements, slices, differences and coverage (J-01..05, U-05, W-01..09, A-01..07, A-21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.operators import quotes as ops
from oddsloom.sources.bind import matches, odds_events, quotes, table

from .registry import Plans

PLANS = Plans()
KEY = ["match_id", "book_id", "market"]
ORDER = ["ts", "source_row", "seq"]
_W = "PARTITION BY match_id, book_id, market ORDER BY ts, source_row, seq"
_DEVIG = "1/p_home / (1/p_home + 1/p_draw + 1/p_away)"


def _q(col: str):
    prices = F.array("p_home", "p_draw", "p_away")
    return odds.devig_multiplicative(prices)[["home", "draw", "away"].index(col)]


@PLANS.add("""SELECT b.book_id, count(DISTINCT q.match_id) AS matches, round(avg(1/p_home + 1/p_draw + 1/p_away - 1), 6) AS mean_overround, CAST(sum(line_move) AS BIGINT) AS line_moves, CAST(sum(price_move) AS BIGINT) AS price_moves
    FROM (SELECT *, CASE WHEN n > 1 AND line_q <> l THEN 1 ELSE 0 END AS line_move, CASE WHEN n > 1 AND line_q = l AND (p_home <> h OR p_draw <> d OR p_away <> a) THEN 1 ELSE 0 END AS price_move FROM
    (SELECT *, row_number() OVER w AS n, lag(line_q) OVER w AS l, lag(p_home) OVER w AS h, lag(p_draw) OVER w AS d, lag(p_away) OVER w AS a FROM
     (SELECT *, row_number() OVER (PARTITION BY match_id, book_id, market, ts, line_q, p_home, p_draw, p_away ORDER BY source_row, seq) AS rn FROM quotes) WHERE rn = 1
     WINDOW w AS (PARTITION BY match_id, book_id, market ORDER BY ts, source_row, seq))) q JOIN (SELECT DISTINCT book_id FROM quotes) b USING (book_id) GROUP BY b.book_id""")
def slice_book_summary(spark, d):
    """Per bookmaker: coverage, mean overround, line moves and price moves of the deduplicated quotes."""
    q = ops.deduplicate(quotes(spark, d), [*KEY, "ts", "line_q", "p_home", "p_draw", "p_away"], ["source_row", "seq"], ["ts", "book_id"]).filter("dup_rank = 1")
    moved = ops.movements(q, KEY, ORDER, "line_q", ["p_home", "p_draw", "p_away"])
    return moved.groupBy("book_id").agg(F.countDistinct("match_id").alias("matches"), F.round(F.avg(odds.overround(F.array("p_home", "p_draw", "p_away"))), 6).alias("mean_overround"), F.sum("line_move").alias("line_moves"), F.sum("price_move").alias("price_moves"))


@PLANS.add("SELECT CASE WHEN book_id = 5 THEN 'unverified' WHEN source_row % 10 = 0 THEN 'conflict' ELSE 'verified' END AS identity_status, CASE WHEN book_id < 5 THEN 'Book ' || book_id END AS book_name, count(*) AS n FROM quotes GROUP BY ALL")
def j01_book_identity(spark, d):
    books = spark.range(5).selectExpr("concat('eu:', id) AS book_key", "concat('Book ', id) AS book_name", "array(concat('Book ', id), concat('B', id)) AS full_names")
    q = quotes(spark, d).selectExpr("concat('eu:', book_id) AS book_key", "IF(source_row % 10 = 0, 'Other', concat('B', book_id)) AS raw_name")
    return ops.resolve_books(q, F.broadcast(books)).groupBy("identity_status", "book_name").agg(F.count(F.lit(1)).alias("n"))


@PLANS.add("""WITH e AS (SELECT match_id, book_key, epoch_us(date_trunc('hour', ts)) AS us, record_id, price FROM odds_events),
    t AS (SELECT DISTINCT match_id, us FROM e), r AS (SELECT t.match_id, t.us, e.book_key, e.record_id, e.price, abs(e.us - t.us) / 6e7 AS gap, e.us > t.us AS ahead,
      row_number() OVER (PARTITION BY t.match_id, t.us, e.book_key ORDER BY abs(e.us - t.us), e.us > t.us, e.record_id) AS rn FROM t JOIN e USING (match_id))
    SELECT match_id, book_key, us, record_id, round(price, 6) AS price, round(gap, 6) AS gap_minutes, ahead AS lookahead, gap <= 30 AS aligned FROM r WHERE rn = 1""")
def j02_synchronised_slices(spark, d):
    e = odds_events(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    s = ops.synchronised_slices(e)
    return s.select("match_id", "book_key", "us", "record_id", F.round("price", 6).alias("price"), F.round("gap_minutes", 6).alias("gap_minutes"), "lookahead", "aligned")


@PLANS.add("""WITH e AS (SELECT match_id, book_key, epoch_us(date_trunc('hour', ts)) AS us FROM odds_events), t AS (SELECT DISTINCT match_id, us FROM e),
    g AS (SELECT t.match_id, t.us, e.book_key, min(abs(e.us - t.us)) <= 1800000000 AS ok FROM t JOIN e USING (match_id) GROUP BY ALL), s AS (SELECT match_id, us, count(*) AS books, count(*) FILTER (WHERE ok) AS good FROM g GROUP BY ALL)
    SELECT match_id, count(*) AS slices, count(*) FILTER (WHERE good >= 2 AND good = books) AS aligned_slices, CASE WHEN count(*) FILTER (WHERE good >= 2 AND good = books) >= 0.8 * count(*) THEN 'STRONG' WHEN count(*) FILTER (WHERE good >= 2 AND good = books) >= 0.5 * count(*) THEN 'ACCEPTABLE' ELSE 'WEAK' END AS status FROM s GROUP BY match_id""")
def q06_slice_alignment(spark, d):
    s = ops.slice_status(ops.synchronised_slices(odds_events(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))))
    g = s.groupBy("match_id").agg(F.count(F.lit(1)).alias("slices"), F.count_if("slice_aligned").alias("aligned_slices"))
    ratio = F.col("aligned_slices") / F.col("slices")
    return g.withColumn("status", F.when(ratio >= 0.8, "STRONG").when(ratio >= 0.5, "ACCEPTABLE").otherwise("WEAK"))


_LATEST = f"""SELECT match_id, book_id, {_DEVIG} AS q FROM (SELECT *, row_number() OVER (PARTITION BY match_id, book_id ORDER BY ts DESC, source_row DESC, seq DESC) AS rn FROM quotes) WHERE rn = 1"""


def _latest(spark, d):
    w = Window.partitionBy("match_id", "book_id").orderBy(F.desc("ts"), F.desc("source_row"), F.desc("seq"))
    return quotes(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("match_id", "book_id", _q("home").alias("q"))


@PLANS.add(f"WITH l AS ({_LATEST}) SELECT a.match_id, a.book_id AS book_a, b.book_id AS book_b, round(100 * (a.q - b.q), 6) AS diff_pp FROM l a JOIN l b ON a.match_id = b.match_id AND a.book_id < b.book_id")
def j03_book_differences(spark, d):
    a = _latest(spark, d)
    b = a.select("match_id", F.col("book_id").alias("book_b"), F.col("q").alias("qb"))
    return a.join(b, "match_id").filter("book_id < book_b").select("match_id", F.col("book_id").alias("book_a"), "book_b", F.round(100 * (F.col("q") - F.col("qb")), 6).alias("diff_pp"))


@PLANS.add(f"WITH l AS ({_LATEST}) SELECT a.match_id, a.book_id, round(100 * (a.q - b.q), 6) AS diff_pp FROM l a JOIN l b ON a.match_id = b.match_id AND b.book_id = 0 AND a.book_id <> 0")
def j04_anchor_divergence(spark, d):
    a = _latest(spark, d)
    anchor = a.filter("book_id = 0").select("match_id", F.col("q").alias("qb"))
    return a.filter("book_id <> 0").join(anchor, "match_id").select("match_id", "book_id", F.round(100 * (F.col("q") - F.col("qb")), 6).alias("diff_pp"))


@PLANS.add(f"""WITH e AS (SELECT match_id, avg({_DEVIG}) AS q FROM quotes WHERE market = '1x2' GROUP BY match_id), b AS (SELECT match_id, avg({_DEVIG}) AS q FROM quotes WHERE market = 'ou' GROUP BY match_id)
    SELECT match_id, round(100 * (e.q - b.q), 6) AS pp FROM e JOIN b USING (match_id)""")
def j05_u04_common_outcomes_pp(spark, d):
    q = quotes(spark, d)
    one, two = (q.filter(F.col("market") == m).groupBy("match_id").agg(F.avg(_q("home")).alias(n)) for m, n in (("1x2", "e"), ("ou", "b")))
    return one.join(two, "match_id").select("match_id", F.round(100 * (F.col("e") - F.col("b")), 6).alias("pp"))


@PLANS.add("""SELECT match_id, book_id, role, market, round(price, 6) AS price FROM (SELECT match_id, book_id, market, 'current' AS role, p_home AS price FROM quotes WHERE seq = 1 UNION ALL SELECT match_id, book_id, market, 'opening', p_draw FROM quotes WHERE seq = 1 UNION ALL SELECT match_id, book_id, market, 'history', p_away FROM quotes WHERE seq > 1)""")
def u05_role_union(spark, d):
    q = quotes(spark, d)
    two = q.filter("seq = 1").selectExpr("match_id", "book_id", "market", "stack(2, 'opening', p_draw, 'current', p_home) AS (role, price)")
    one = q.filter("seq > 1").selectExpr("match_id", "book_id", "market", "'history' AS role", "p_away AS price")
    return two.unionByName(one, allowMissingColumns=True).withColumn("price", F.round("price", 6))


_DEDUP = "SELECT *, CASE WHEN t IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY match_id, book_id, market, t, line_q ORDER BY source_row, seq, p_home, p_draw) END AS rn, first_value(source_row) OVER (PARTITION BY match_id, book_id, market, t, line_q ORDER BY source_row, seq, p_home, p_draw) AS kept FROM (SELECT *, CASE WHEN source_row % 13 <> 0 THEN date_trunc('month', ts) END AS t FROM quotes)"


def _dedup(spark, d):
    q = quotes(spark, d).withColumn("t", F.when(F.col("source_row") % 13 != 0, F.date_trunc("month", "ts")))
    return ops.deduplicate(q, ["match_id", "book_id", "market", "t", "line_q"], ["source_row", "seq", "p_home", "p_draw"], ["t"])


@PLANS.add(f"SELECT match_id, book_id, market, count(*) AS kept_rows, count(t) AS timed_rows FROM ({_DEDUP}) WHERE rn = 1 GROUP BY ALL")
def w01_timeline_dedupe(spark, d):
    return _dedup(spark, d).filter("dup_rank = 1").groupBy("match_id", "book_id", "market").agg(F.count(F.lit(1)).alias("kept_rows"), F.count("t").alias("timed_rows"))


@PLANS.add(f"SELECT match_id, book_id, kept, source_row AS duplicate FROM ({_DEDUP}) WHERE rn > 1")
def w02_duplicate_pairs(spark, d):
    return _dedup(spark, d).filter("dup_rank > 1").select("match_id", "book_id", F.col("kept_first").alias("kept"), F.col("source_row").alias("duplicate"))


@PLANS.add(f"""SELECT match_id, book_id, market, CAST(sum(CASE WHEN line_q <> l THEN 1 ELSE 0 END) AS BIGINT) AS line_moves, CAST(sum(CASE WHEN line_q = l AND p_home <> h THEN 1 ELSE 0 END) AS BIGINT) AS price_moves
    FROM (SELECT *, lag(line_q) OVER ({_W}) AS l, lag(p_home) OVER ({_W}) AS h FROM quotes) GROUP BY ALL""")
def w03_movements(spark, d):
    return ops.movements(quotes(spark, d), KEY, ORDER, "line_q", ["p_home"]).groupBy(*KEY).agg(F.sum("line_move").alias("line_moves"), F.sum("price_move").alias("price_moves"))


@PLANS.add(f"""SELECT match_id, book_id, round(100 * (arg_max(q, k) - arg_min(q, k)), 6) AS change_pp FROM (SELECT match_id, book_id, {_DEVIG} AS q, row_number() OVER (PARTITION BY match_id, book_id ORDER BY ts, source_row, seq, p_home) AS k FROM quotes) GROUP BY ALL""")
def w04_opening_to_current(spark, d):
    k = F.struct("ts", "source_row", "seq", "p_home")
    return quotes(spark, d).withColumn("q", _q("home")).withColumn("k", k).groupBy("match_id", "book_id").agg(F.round(100 * (F.max_by("q", "k") - F.min_by("q", "k")), 6).alias("change_pp"))


@PLANS.add("SELECT match_id, book_key, bool_or(ts < l) AS disorder FROM (SELECT *, lag(ts) OVER (PARTITION BY match_id, book_key ORDER BY price, record_id) AS l FROM odds_events) GROUP BY ALL HAVING bool_or(ts < l)")
def w05_source_disorder(spark, d):
    w = Window.partitionBy("match_id", "book_key").orderBy("price", "record_id")
    return odds_events(spark, d).withColumn("back", F.col("ts") < F.lag("ts").over(w)).groupBy("match_id", "book_key").agg(F.bool_or("back").alias("disorder")).filter("disorder")


@PLANS.add("""SELECT match_id, book_key, count(*) AS n_quotes, round(max(g), 6) AS max_gap_hours, coalesce(max(g) > 24, false) AS large_gap FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY match_id, book_key ORDER BY ts, record_id)) / 3.6e9 AS g FROM odds_events) GROUP BY ALL""")
def w06_quote_gaps(spark, d):
    return ops.gaps(odds_events(spark, d), ["match_id", "book_key"], ["ts", "record_id"], 24.0).withColumn("max_gap_hours", F.round("max_gap_hours", 6))


@PLANS.add(f"""WITH s AS (SELECT *, line_q - lag(line_q) OVER ({_W}) AS dl, row_number() OVER ({_W}) AS n FROM quotes), z AS (SELECT *, sign(dl) <> sign(lag(dl) OVER (PARTITION BY match_id, book_id, market ORDER BY n)) AS flip FROM s WHERE dl <> 0),
    f AS (SELECT match_id, book_id, market, count(*) FILTER (WHERE flip) AS reversals FROM z GROUP BY ALL)
    SELECT match_id, book_id, market, arg_min(line_q, n) AS opening, arg_max(line_q, n) AS current, min(line_q) AS deepest, max(line_q) AS shallowest, arg_max(line_q, n) - arg_min(line_q, n) AS net, coalesce(any_value(reversals), 0) AS reversals,
    arg_min(line_q, n) - min(line_q) >= 1 AND arg_max(line_q, n) - min(line_q) >= 1 AS failed_upgrade FROM s LEFT JOIN f USING (match_id, book_id, market) GROUP BY ALL""")
def w07_line_lifecycle(spark, d):
    """All of a line's figures stand in its last quote, from one sort: no map of lines is held."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.signum(F.col("line_q") - F.lag("line_q").over(w))
    q = quotes(spark, d).select(*KEY, *ORDER, "line_q").withColumn("step", F.when(step != 0, step))
    before = F.last("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    q = q.withColumn("flip", F.coalesce(F.col("step") != before, F.lit(False)).cast("long"))
    q = q.withColumns({"opening": F.first("line_q").over(upto), "deepest": F.min("line_q").over(upto), "shallowest": F.max("line_q").over(upto), "reversals": F.sum("flip").over(upto), "more": F.lead(F.lit(True), 1, False).over(w)})
    g = q.filter("NOT more").select(*KEY, "opening", F.col("line_q").alias("current"), "deepest", "shallowest", "reversals")
    return g.withColumn("net", F.col("current") - F.col("opening")).withColumn("failed_upgrade", (F.col("opening") - F.col("deepest") >= 1) & (F.col("current") - F.col("deepest") >= 1))


@PLANS.add("""SELECT match_id, book_key, CAST(arg_max(n, {'p': price, 'n': -n}) AS BIGINT) AS peak_at, CAST(arg_min(n, {'p': price, 'n': n}) AS BIGINT) AS trough_at, round(max(price) - arg_max(price, n), 6) AS fall_from_peak, round(arg_max(price, n) - min(price), 6) AS rise_from_trough
    FROM (SELECT match_id, book_key, price, row_number() OVER (PARTITION BY match_id, book_key ORDER BY ts, record_id) AS n FROM odds_events) GROUP BY ALL""")
def w08_probability_lifecycle(spark, d):
    w = Window.partitionBy("match_id", "book_key").orderBy("ts", "record_id")
    e = odds_events(spark, d).withColumn("n", F.row_number().over(w).cast("long"))
    last = F.max_by("price", "n")
    return e.groupBy("match_id", "book_key").agg(F.max_by("n", F.struct("price", -F.col("n"))).alias("peak_at"), F.min_by("n", F.struct("price", "n")).alias("trough_at"), F.round(F.max("price") - last, 6).alias("fall_from_peak"), F.round(last - F.min("price"), 6).alias("rise_from_trough"))


@PLANS.add("""SELECT match_id, book_key, round((arg_max(price, ts) - arg_min(price, ts)) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 0), 6) AS per_minute, bool_or(ts <= l) AS out_of_order FROM (SELECT *, lag(ts) OVER (PARTITION BY match_id, book_key ORDER BY record_id) AS l FROM odds_events) GROUP BY ALL""")
def w09_velocity(spark, d):
    w = Window.partitionBy("match_id", "book_key").orderBy("record_id")
    e = odds_events(spark, d).withColumn("late", F.lag("ts").over(w) >= F.col("ts")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    minutes = (F.max("us") - F.min("us")) / 6e7
    return e.groupBy("match_id", "book_key").agg(F.round((F.max_by("price", "ts") - F.min_by("price", "ts")) / F.nullif(minutes, F.lit(0.0)), 6).alias("per_minute"), F.bool_or("late").alias("out_of_order"))


@PLANS.add("SELECT m.match_id, b.book_id, count(q.book_id) > 0 AS present FROM (SELECT DISTINCT match_id FROM matches) m CROSS JOIN (SELECT unnest([0, 2, 4]) AS book_id) b LEFT JOIN quotes q USING (match_id, book_id) GROUP BY ALL")
def a01_core_coverage(spark, d):
    return _core_coverage(spark, d, matches(spark, d))


def _core_coverage(spark, d, wanted):
    core = spark.range(0, 6, 2).toDF("book_id")
    seen = quotes(spark, d).select("match_id", "book_id").distinct().withColumn("present", F.lit(True))
    return wanted.select("match_id").crossJoin(F.broadcast(core)).join(seen, ["match_id", "book_id"], "left").fillna({"present": False})


@PLANS.add("SELECT market, book_id, round(count(DISTINCT match_id) / (SELECT CAST(count(DISTINCT match_id) AS DOUBLE) FROM quotes), 6) AS coverage FROM quotes GROUP BY ALL UNION ALL SELECT 'ou_base', book_id, round(count(DISTINCT match_id) FILTER (WHERE market = 'ou' AND line_q = 2) / (SELECT CAST(count(DISTINCT match_id) AS DOUBLE) FROM quotes), 6) FROM quotes WHERE book_id < 2 GROUP BY ALL")
def a02_batch_coverage(spark, d):
    q = quotes(spark, d)
    n = q.agg(F.countDistinct("match_id").alias("n"))
    base = q.filter("book_id < 2").groupBy("book_id").agg(F.countDistinct(F.when((F.col("market") == "ou") & (F.col("line_q") == 2), F.col("match_id"))).alias("k")).withColumn("market", F.lit("ou_base"))
    got = q.groupBy("market", "book_id").agg(F.countDistinct("match_id").alias("k")).unionByName(base)
    return got.crossJoin(F.broadcast(n)).select("market", "book_id", F.round(F.col("k") / F.col("n"), 6).alias("coverage"))


@PLANS.add("""WITH m AS (SELECT match_id, count(DISTINCT book_id) AS books, count(*) AS n FROM quotes GROUP BY match_id), l AS (SELECT match_id, book_id, count(DISTINCT line_q) AS lines FROM quotes WHERE market = 'ou' GROUP BY ALL), r AS (SELECT round(avg((source_row % 13 = 0)::INT), 6) AS missing_rate FROM quotes)
    SELECT round((SELECT avg(books) FROM m), 6) AS books_per_match, round((SELECT avg(n) FROM m), 6) AS rows_per_match, round((SELECT avg(lines) FROM l), 6) AS ladder_lines, missing_rate FROM r""")
def a03_batch_metrics(spark, d):
    q = quotes(spark, d)
    m = q.groupBy("match_id").agg(F.countDistinct("book_id").alias("books"), F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("books"), 6).alias("books_per_match"), F.round(F.avg("n"), 6).alias("rows_per_match"))
    ladder = q.filter("market = 'ou'").groupBy("match_id", "book_id").agg(F.countDistinct("line_q").alias("k")).agg(F.round(F.avg("k"), 6).alias("ladder_lines"))
    rate = q.agg(F.round(F.avg((F.col("source_row") % 13 == 0).cast("int")), 6).alias("missing_rate"))
    return m.crossJoin(ladder).crossJoin(rate)


@PLANS.add("SELECT issue, count(*) AS n, min(record_id) AS first_record FROM (SELECT event_id AS record_id, unnest(CASE event_id % 4 WHEN 0 THEN ['impossible_line', 'cross_match_url'] WHEN 1 THEN ['timestamp_unverified'] ELSE [] END) AS issue FROM events) GROUP BY issue")
def a05_issue_rollup(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS record_id", "CASE event_id % 4 WHEN 0 THEN array('impossible_line', 'cross_match_url') WHEN 1 THEN array('timestamp_unverified') ELSE CAST(array() AS ARRAY<STRING>) END AS issues")
    return e.select("record_id", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"))


@PLANS.add("SELECT match_id, book_id, ts, line_q, count(DISTINCT (p_home, p_draw, p_away)) AS distinct_quotes FROM (SELECT * REPLACE (date_trunc('month', ts) AS ts) FROM quotes) GROUP BY ALL HAVING count(DISTINCT (p_home, p_draw, p_away)) > 1")
def a06_timestamp_collisions(spark, d):
    q = quotes(spark, d).withColumn("ts", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return q.groupBy("match_id", "book_id", "ts", "line_q").agg(F.countDistinct("p_home", "p_draw", "p_away").alias("distinct_quotes")).filter("distinct_quotes > 1")


@PLANS.add("SELECT home_team, away_team, count(*) AS fixtures, min(match_id) AS first_id FROM matches GROUP BY ALL HAVING count(*) > 1")
def a07_index_qc(spark, d):
    return matches(spark, d).groupBy("home_team", "away_team").agg(F.count(F.lit(1)).alias("fixtures"), F.min("match_id").alias("first_id")).filter("fixtures > 1")


@PLANS.add("SELECT match_id, round(coalesce((sum(p_home) FILTER (WHERE market = '1x2') - sum(p_away) FILTER (WHERE market = '1x2')) / nullif(sum(p_home + p_away) FILTER (WHERE market = '1x2'), 0), 0), 6) AS imbalance FROM quotes GROUP BY match_id")
def a21_book_imbalance(spark, d):
    back, lay = (F.sum(F.when(F.col("market") == "1x2", F.col(c))) for c in ("p_home", "p_away"))
    return quotes(spark, d).groupBy("match_id").agg(F.round(F.coalesce((back - lay) / F.nullif(back + lay, F.lit(0.0)), F.lit(0.0)), 6).alias("imbalance"))
