"""Entities and fixtures (J-06..10, J-16, J-18..21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.operators import entities as ops
from oddsloom.sources.bind import matches, odds_events, pool, quotes, table

from .registry import Plans

PLANS = Plans()


@PLANS.add("""WITH r AS (SELECT o_custkey AS request_id, home_team AS h, away_team AS a, kickoff AS k FROM (SELECT o_custkey, any_value(o_orderkey) FROM orders GROUP BY 1) c(o_custkey, x) JOIN matches m ON m.match_id = (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = c.o_custkey)),
    c AS (SELECT request_id, match_id, 1 AS rank FROM r JOIN matches m ON m.home_team = h AND m.away_team = a AND m.kickoff = k UNION ALL SELECT request_id, match_id, 2 FROM r JOIN matches m ON m.home_team = h AND m.kickoff = k WHERE request_id % 10 = 0),
    b AS (SELECT *, min(rank) OVER (PARTITION BY request_id) AS best FROM c WHERE NOT (rank = 1 AND request_id % 10 = 0))
    SELECT request_id, CASE WHEN count(DISTINCT match_id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT match_id) = 1 THEN min(match_id) END AS match_id, count(DISTINCT match_id) AS candidates, min(rank) AS rank FROM b WHERE rank = best GROUP BY request_id""")
def j06_fixture_resolution(spark, d):
    return _resolved(matches(spark, d), table(spark, d, "orders"))


def _resolved(m, orders):
    o = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("match_id"))
    r = o.join(m, "match_id").selectExpr("o_custkey AS request_id", "home_team AS h", "away_team AS a", "kickoff AS k")
    exact = r.filter("request_id % 10 <> 0").join(m, (m.home_team == F.col("h")) & (m.away_team == F.col("a")) & (m.kickoff == F.col("k")))
    single = r.filter("request_id % 10 = 0").join(m, (m.home_team == F.col("h")) & (m.kickoff == F.col("k")))
    return ops.resolve(r, [(1, exact), (2, single)], "request_id", "match_id")


@PLANS.add("""WITH p AS (SELECT user_id, event_type, ts, event_id FROM events), q AS (SELECT user_id, event_type, ts AS t2, event_id AS e2 FROM events),
    j AS (SELECT event_id, e2, abs(epoch_us(ts) - epoch_us(t2)) / 6e7 AS g FROM p JOIN q USING (user_id, event_type) WHERE CAST(ts AS DATE) = CAST(t2 AS DATE) AND event_id < e2)
    SELECT event_id, e2, CASE WHEN g <= 30 THEN 0.95e0 ELSE 0.85e0 END AS confidence FROM j WHERE g <= 30 OR abs(g - 60) <= 5 OR abs(g - 480) <= 5""")
def j07_pool_matcher(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    q = e.withColumnsRenamed({"us": "us2", "event_id": "e2"})
    j = e.join(q, ["user_id", "event_type", "day"]).filter("event_id < e2")
    return j.select("event_id", "e2", ops.time_confidence((F.col("us") - F.col("us2")) / 6e7).alias("confidence")).filter("confidence IS NOT NULL")


@PLANS.add("""WITH c AS (SELECT c_custkey, c_nationkey, lower(c_name) AS n FROM customer), r AS (SELECT a.c_custkey AS a, b.c_custkey AS b, 1 - levenshtein(a.n, b.n) / CAST(greatest(length(a.n), length(b.n)) AS DOUBLE) AS s FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey)
    SELECT a, b, round(s, 6) AS ratio, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) AS rn FROM r WHERE round(s, 6) >= 0.88) WHERE rn <= 5""")
def j08_fuzzy_suggestions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lower("c_name").alias("n"))
    return ops.close_names(c, "c_custkey", "c_nationkey", "n", 5, 0.88)


@PLANS.add("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, epoch_us(ts) AS us2, event_id AS e2 FROM events WHERE event_type = 'view')
    SELECT event_id, e2, g AS gap_us FROM (SELECT event_id, e2, abs(us - us2) AS g, row_number() OVER (PARTITION BY event_id ORDER BY abs(us - us2), e2) AS rn FROM a JOIN b USING (user_id) WHERE abs(us - us2) <= 10800000000) WHERE rn = 1""")
def j09_provider_fixture_match(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = e.filter("event_type = 'purchase'").drop("event_type")
    b = e.filter("event_type = 'view'").select("user_id", F.col("us").alias("us2"), F.col("event_id").alias("e2"))
    return ops.nearest_in_time(a, b, ["user_id"], "us", "us2", "e2", 10_800_000_000).select("event_id", "e2", "gap_us")


_STATE = "SELECT competition, season_start, home_team AS team, round(avg(home_goals), 6) AS state FROM matches WHERE home_team % 3 > 0 GROUP BY ALL"


@PLANS.add(f"""WITH s AS ({_STATE}) SELECT m.match_id, coalesce(a.state, b.state, 0e0) AS state, CASE WHEN a.state IS NOT NULL THEN 'current' WHEN b.state IS NOT NULL THEN 'previous' ELSE 'baseline' END AS origin, CASE WHEN a.state IS NOT NULL THEN 0e0 WHEN b.state IS NOT NULL THEN 0.04e0 ELSE 0.25e0 END AS added_variance
    FROM matches m LEFT JOIN s a ON a.competition = m.competition AND a.team = m.away_team AND a.season_start = m.season_start + 1 LEFT JOIN s b ON b.competition = m.competition AND b.team = m.away_team AND b.season_start = m.season_start""")
def j10_season_state_lookup(spark, d):
    m = matches(spark, d)
    s = m.filter("home_team % 3 > 0").groupBy("competition", "season_start", F.col("home_team").alias("away_team")).agg(F.round(F.avg("home_goals"), 6).alias("state"))
    now = s.withColumnRenamed("state", "now").withColumn("season_start", F.col("season_start") - 1)
    out = m.join(now, ["competition", "season_start", "away_team"], "left").join(s, ["competition", "season_start", "away_team"], "left")
    return out.select("match_id", F.coalesce("now", "state", F.lit(0.0)).alias("state"), F.expr("CASE WHEN now IS NOT NULL THEN 'current' WHEN state IS NOT NULL THEN 'previous' ELSE 'baseline' END").alias("origin"), F.expr("CASE WHEN now IS NOT NULL THEN 0e0 WHEN state IS NOT NULL THEN 0.04e0 ELSE 0.25e0 END").alias("added_variance"))


_TEAM = "SELECT match_id, kickoff, competition, home_team AS team FROM matches UNION ALL SELECT match_id, kickoff, competition, away_team FROM matches"


@PLANS.add(f"""WITH t AS ({_TEAM}), x AS (SELECT *, max(CASE WHEN competition = '1-URGENT' THEN kickoff END) OVER (PARTITION BY team ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS euro FROM t),
    y AS (SELECT *, row_number() OVER (PARTITION BY team, euro ORDER BY kickoff, match_id) AS rn FROM x WHERE competition <> '1-URGENT' AND euro IS NOT NULL)
    SELECT team, match_id, euro AS exposed_by, rn = 1 AND kickoff - euro <= INTERVAL 168 HOUR AS exposed FROM y""")
def j16_post_event_exposure(spark, d):
    m = matches(spark, d).withColumn("us", F.unix_micros(F.col("kickoff").cast("timestamp")))
    t = m.select("match_id", "kickoff", "competition", "us", F.explode(F.array("home_team", "away_team")).alias("team"))
    before = Window.partitionBy("team").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    x = t.withColumn("euro", F.max(F.when(F.col("competition") == "1-URGENT", F.struct("us", "kickoff"))).over(before)).filter("competition <> '1-URGENT' AND euro IS NOT NULL")
    rn = F.row_number().over(Window.partitionBy("team", "euro.us").orderBy("us", "match_id"))
    return x.withColumn("rn", rn).select("team", "match_id", F.col("euro.kickoff").alias("exposed_by"), ((F.col("rn") == 1) & (F.col("us") - F.col("euro.us") <= 168 * 3_600_000_000)).alias("exposed"))


@PLANS.add("SELECT a.match_id, a.n AS n_a, b.n AS n_b, c.n AS n_c FROM (SELECT match_id, count(*) AS n FROM quotes WHERE market = '1x2' GROUP BY 1) a JOIN (SELECT match_id, count(*) AS n FROM quotes WHERE market = 'ah' GROUP BY 1) b USING (match_id) JOIN (SELECT match_id, count(*) AS n FROM quotes WHERE market = 'ou' GROUP BY 1) c USING (match_id)")
def j18_common_sample(spark, d):
    q = quotes(spark, d)
    a, b, c = (q.filter(F.col("market") == m).groupBy("match_id").agg(F.count(F.lit(1)).alias(n)) for m, n in (("1x2", "n_a"), ("ah", "n_b"), ("ou", "n_c")))
    return a.join(b, "match_id").join(c, "match_id")


@PLANS.add("""WITH k AS (SELECT match_id, max(epoch_us(ts)) AS ko FROM odds_events GROUP BY 1), n AS (SELECT match_id, ko, unnest([300, 120, 60, 30, 10]) AS node FROM k), j AS (SELECT n.match_id, node, record_id, abs(epoch_us(ts) - (ko - CAST(node AS BIGINT) * 60000000)) AS g, row_number() OVER (PARTITION BY n.match_id, node ORDER BY abs(epoch_us(ts) - (ko - CAST(node AS BIGINT) * 60000000)), record_id) AS rn FROM n JOIN odds_events USING (match_id))
    SELECT match_id, node, CASE WHEN g <= 3600000000 THEN record_id END AS record_id, CASE WHEN g <= 3600000000 THEN round(g / 6e7, 6) END AS deviation_minutes, g > 3600000000 AS missing FROM j WHERE rn = 1""")
def j19_sampling_nodes(spark, d):
    e = odds_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ko = e.groupBy("match_id").agg(F.max("us").alias("ko"))
    nodes = ko.withColumn("node", F.explode(F.array(*map(F.lit, (300, 120, 60, 30, 10))))).withColumn("target", F.col("ko") - F.col("node").cast("long") * 60_000_000).select("match_id", "node", "target")
    gap = F.abs(F.col("us") - F.col("target"))
    best = nodes.join(e.select("match_id", "us", "record_id"), "match_id").groupBy("match_id", "node").agg(F.min(F.struct(gap.alias("g"), "record_id")).alias("b"))
    ok = F.col("b.g") <= 3_600_000_000
    return best.select("match_id", "node", F.when(ok, F.col("b.record_id")).alias("record_id"), F.when(ok, F.round(F.col("b.g") / 6e7, 6)).alias("deviation_minutes"), (~ok).alias("missing"))


@PLANS.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 * 100000 + c_custkey AS VARCHAR) ELSE 'team_' || substr(sha256(regexp_replace(lower(c_name), '[^a-z0-9_]+', '', 'g')), 1, 16) END AS canonical_id, c_custkey % 3 > 0 AS registered FROM customer""")
def j20_canonical_entities(spark, d):
    c = table(spark, d, "customer")
    known = c.filter("c_custkey % 3 > 0").select((F.col("c_custkey") % 3 * 100000 + F.col("c_custkey")).alias("team_id"), F.array("c_name", F.upper("c_name"), F.concat(F.lit("FC "), "c_name")).alias("aliases"))
    return ops.canonical(c.select("c_custkey", F.upper("c_name").alias("name")), "name", ops.alias_dimension(known, "team_id", "aliases"), "team_id", "team").select("c_custkey", "canonical_id", "registered")


@PLANS.add("SELECT m.match_id, h.n_name || ' vs ' || a.n_name AS fixture, CAST(m.kickoff AS DATE) AS kickoff_date, 4 AS fixture_aliases, h.n_name IS NULL OR a.n_name IS NULL AS unresolved FROM matches m LEFT JOIN nation h ON h.n_nationkey = m.home_team LEFT JOIN nation a ON a.n_nationkey = m.away_team")
def j21_match_index(spark, d):
    from oddsloom.functions.scalars import alias_product

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.array("n_name", F.initcap("n_name")).alias("aliases"), "n_name")
    h, a = (F.broadcast(n.select(F.col("k").alias(f"{s}_team"), F.col("aliases").alias(f"{s}_aliases"), F.col("n_name").alias(f"{s}_name"))) for s in ("home", "away"))
    m = matches(spark, d).join(h, "home_team", "left").join(a, "away_team", "left")
    return m.select("match_id", F.concat("home_name", F.lit(" vs "), "away_name").alias("fixture"), F.to_date("kickoff").alias("kickoff_date"), F.size(alias_product(F.col("home_aliases"), F.col("away_aliases"))).alias("fixture_aliases"), (F.col("home_name").isNull() | F.col("away_name").isNull()).alias("unresolved"))
