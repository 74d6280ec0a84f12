"""Scalar functions and predicates over whole tables (F-, P-)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import odds, redaction, scalars
from oddsloom.sources.bind import matches, odds_events, quotes, table

from .registry import Plans

PLANS = Plans()
R6 = 6


def _prices():
    return F.array("p_home", "p_draw", "p_away")


@PLANS.add("""SELECT raw, CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN regexp_full_match(raw, '\\s*-?\\d+\\.0+\\s*') THEN CAST(CAST(CAST(raw AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(raw) END AS id
    FROM (SELECT CASE l_orderkey % 4 WHEN 0 THEN CAST(l_quantity AS VARCHAR) WHEN 1 THEN ' b' || l_suppkey || ' ' WHEN 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS raw FROM lineitem)""")
def f01_identifier(spark, d):
    raw = table(spark, d, "lineitem").selectExpr("CASE l_orderkey % 4 WHEN 0 THEN CAST(l_quantity AS STRING) WHEN 1 THEN concat(' b', l_suppkey, ' ') WHEN 2 THEN '' ELSE CAST(l_partkey AS STRING) END AS raw")
    return raw.select("raw", scalars.identifier(F.col("raw")).alias("id"))


@PLANS.add("""SELECT event_id, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS x
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(round(value, 2) AS VARCHAR) END AS raw FROM events)""")
def f02_number(spark, d):
    raw = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(round(value, 2) AS STRING) END AS raw")
    return raw.select("event_id", scalars.number(F.col("raw")).alias("x"))


@PLANS.add("""WITH raw AS (SELECT o_orderkey, o_orderdate AS a, o_orderkey % 300 - 150 AS k, o_orderkey % 3 AS kind FROM orders),
    l AS (SELECT *, a + INTERVAL 1 HOUR * (k * 24 + 7) AS t FROM raw)
    SELECT o_orderkey, epoch_us(t - INTERVAL 8 HOUR) AS utc_us FROM l""")
def f03_timestamp(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) AS a", "CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, CAST(o_orderkey % 300 - 150 AS INT), 7) AS t", "o_orderkey % 3 AS kind")
    raw = F.when(F.col("kind") == 0, F.date_format("t", "M-d HH:mm")).when(F.col("kind") == 1, F.concat_ws(",", F.year("t"), F.month("t") - 1, F.dayofmonth("t"), F.date_format("t", "HH,mm,ss"))).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("o_orderkey", F.unix_micros(scalars.timestamp(raw, F.col("a"))).alias("utc_us"))


@PLANS.add("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN -0.5e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN -1.25e0 WHEN 3 THEN l_linenumber / 4e0 WHEN 4 THEN NULL ELSE (l_linenumber + l_linenumber + 0.5e0) / 2 END AS line FROM lineitem""")
def f04_asian_line(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CASE l_partkey % 6 WHEN 0 THEN '半球' WHEN 1 THEN '受平手/半球' WHEN 2 THEN '一球/球半' WHEN 3 THEN CAST(l_linenumber / 4e0 AS STRING) WHEN 4 THEN '半球/x' ELSE concat(l_linenumber, '/', l_linenumber + 0.5e0) END AS raw")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scalars.asian_line(F.col("raw"), F.lit("ah")).alias("line"))


@PLANS.add("""SELECT match_id, seq, source_row, fmt, CASE WHEN fmt = 'US' THEN 'unverified_odds_format' WHEN fmt = 'HK' AND least(h, a) <= 0 THEN 'impossible_hk_value' WHEN fmt = 'DECIMAL' AND least(h, a) <= 1 THEN 'impossible_decimal_value' END AS error,
    CASE WHEN fmt = 'HK' AND least(h, a) > 0 THEN round(h + a + 2, 6) WHEN fmt = 'DECIMAL' AND least(h, a) > 1 THEN round(h + a, 6) END AS price_sum
    FROM (SELECT match_id, seq, source_row, CASE book_id WHEN 0 THEN 'US' WHEN 1 THEN 'HK' WHEN 2 THEN 'HK' ELSE 'DECIMAL' END AS fmt, p_home - 1.5e0 AS h, p_away AS a FROM quotes)""")
def f05_decimal_prices(spark, d):
    q = quotes(spark, d).selectExpr("match_id", "seq", "source_row", "CASE book_id WHEN 0 THEN 'US' WHEN 1 THEN 'HK' WHEN 2 THEN 'HK' ELSE 'DECIMAL' END AS fmt", "array(CAST(p_home - 1.5e0 AS STRING), CAST(p_away AS STRING)) AS raw")
    q = q.withColumn("x", odds.decimal_prices(F.col("raw"), F.col("fmt")))
    return q.select("match_id", "seq", "source_row", "fmt", "x.error", F.round(odds.total(F.col("x.prices")), R6).alias("price_sum"))


@PLANS.add("""SELECT match_id, seq, source_row, round(1/p_home + 1/p_draw + 1/p_away - 1, 6) AS overround, round(1/p_home / (1/p_home + 1/p_draw + 1/p_away), 6) AS q_home, round(1/p_draw / (1/p_home + 1/p_draw + 1/p_away), 6) AS q_draw, round(1/p_away / (1/p_home + 1/p_draw + 1/p_away), 6) AS q_away FROM quotes""")
def f06_devig_multiplicative(spark, d):
    q = quotes(spark, d).withColumn("p", odds.devig_multiplicative(_prices()))
    return q.select("match_id", "seq", "source_row", F.round(odds.overround(_prices()), R6).alias("overround"), *(F.round(F.col("p")[k], R6).alias(f"q_{n}") for k, n in enumerate(("home", "draw", "away"))))


def _bisection_sql(kind: str) -> str:
    """The same bisection in a recursive table expression."""
    raw = "SELECT match_id, seq, source_row, 1/p_home AS a, 1/p_draw AS b, 1/p_away AS c FROM quotes"
    if kind == "power":
        low, high, g = "0.01e0", "20e0", "pow(a, x) + pow(b, x) + pow(c, x) - 1"
        out = ["pow(a, z)", "pow(b, z)", "pow(c, z)"]
        ok = "TRUE"
    else:
        one = "(sqrt(x*x + 4*(1-x)*{q}*{q}/(a+b+c)) - x) / (2*(1-x))"
        low, high, g = "0e0", "1 - 1e-10", " + ".join(one.format(q=q) for q in "abc") + " - 1"
        out = [one.replace("x", "z").replace("sqrt", "sqrt").format(q=q) for q in "abc"]
        ok = "a + b + c > 1 + 1e-9"
    return f"""WITH RECURSIVE base AS ({raw}), it AS (SELECT *, {low} AS lo, {high} AS hi, 0 AS n FROM base WHERE {ok}
        UNION ALL SELECT match_id, seq, source_row, a, b, c, CASE WHEN g > 0 THEN x ELSE lo END, CASE WHEN g > 0 THEN hi ELSE x END, n + 1 FROM (SELECT *, {g} AS g FROM (SELECT *, (lo + hi) / 2 AS x FROM it WHERE n < 60)))
        SELECT match_id, seq, source_row, round({out[0]}, 6) AS q_home, round({out[1]}, 6) AS q_draw, round({out[2]}, 6) AS q_away FROM (SELECT *, (lo + hi) / 2 AS z FROM it WHERE n = 60)"""


def _devigged(spark, d, how):
    q = quotes(spark, d).withColumn("p", how(_prices())).filter("p[0] IS NOT NULL")
    return q.select("match_id", "seq", "source_row", *(F.round(F.col("p")[k], R6).alias(f"q_{n}") for k, n in enumerate(("home", "draw", "away"))))


@PLANS.add(_bisection_sql("power"))
def f07_devig_power(spark, d):
    return _devigged(spark, d, odds.devig_power)


@PLANS.add(_bisection_sql("shin"))
def f08_devig_shin(spark, d):
    rows = quotes(spark, d).filter("1/p_home + 1/p_draw + 1/p_away > 1 + 1e-9").withColumn("p", odds.devig_shin(_prices()))
    return rows.select("match_id", "seq", "source_row", *(F.round(F.col("p")[k], R6).alias(f"q_{n}") for k, n in enumerate(("home", "draw", "away"))))


_POWER = _bisection_sql("power").partition(" SELECT match_id, seq, source_row, round(")[0]


@PLANS.add(f"""{_POWER} SELECT method, count(*) AS n, round(avg(home), 6) AS mean_home FROM (SELECT 'multiplicative' AS method, 1/p_home / (1/p_home + 1/p_draw + 1/p_away) AS home FROM quotes UNION ALL SELECT 'power', pow(a, (lo + hi) / 2) FROM it WHERE n = 60) GROUP BY method""")
def f09_devig_dispatch(spark, d):
    q = quotes(spark, d)
    parts = [q.select(F.lit(m).alias("method"), odds.DEVIG[m](_prices())[0].alias("home")) for m in ("multiplicative", "power")]
    return parts[0].unionByName(parts[1]).groupBy("method").agg(F.count("home").alias("n"), F.round(F.avg("home"), R6).alias("mean_home"))


@PLANS.add("""SELECT page_id, regexp_extract(lower(url), '[?&]id=([^&#]*)', 1) AS query_id, regexp_extract(url, '/(\\d+)(?:cn|sb)?\\.(?:js|htm)', 1) AS path_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages""")
def f10_url_fields(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.coalesce(F.regexp_extract(F.lower("url"), "[?&]id=([^&#]*)", 1), F.lit("")).alias("query_id"), F.regexp_extract("url", r"/(\d+)(?:cn|sb)?\.(?:js|htm)", 1).alias("path_id"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@PLANS.add("SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS folded, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS strict FROM customer")
def f11_f12_fold(spark, d):
    c = table(spark, d, "customer")
    wide = F.translate(F.concat(F.lit("　"), F.regexp_replace(F.upper("c_name"), "#", " 　")), scalars.NARROW.strip(), scalars.WIDE[:-1])
    return c.select("c_custkey", scalars.fold(wide).alias("folded"), scalars.fold_strict(F.col("c_name")).alias("strict"))


@PLANS.add("""WITH n AS (SELECT n_nationkey, n_name, list_distinct(list_filter(string_split(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS t FROM nation)
    SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name = b.n_name THEN 1.0e0 ELSE greatest(round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6),
    CASE WHEN contains(array_to_string(string_split(lower(a.n_name), '_'), ' '), array_to_string(string_split(lower(b.n_name), '_'), ' ')) OR contains(array_to_string(string_split(lower(b.n_name), '_'), ' '), array_to_string(string_split(lower(a.n_name), '_'), ' ')) THEN 0.92e0 ELSE 0e0 END) END AS score
    FROM n a JOIN n b ON a.n_nationkey <= b.n_nationkey""")
def f13_name_score(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("nb"))
    return n.join(b, F.col("n_nationkey") <= F.col("b")).select(F.col("n_nationkey").alias("a"), "b", F.round(scalars.name_score(F.col("n_name"), F.col("nb")), R6).alias("score"))


@PLANS.add("SELECT c_custkey, 'team_' || substr(sha256(c_name), 1, 16) AS team_id FROM customer")
def f14_stable_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.stable_id("team", F.col("c_name")).alias("team_id"))


_SECRET_SQL = scalars.SECRET.replace("(?i)", "").replace("'", "''")


@PLANS.add(f"""SELECT doc_id, length(r) AS n_chars_after, r <> text AS changed, regexp_matches(text, '{_SECRET_SQL}', 'i') AS has_secret
    FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_SECRET_SQL}', '[REDACTED]', 'gi'), '{scalars.HOME_PATH.replace("'", "''")}', '[REDACTED_PATH]', 'g') AS r FROM documents)""")
def f15_f16_redaction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", scalars.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.length("r").cast("long").alias("n_chars_after"), (F.col("r") != F.col("text")).alias("changed"), scalars.has_secret(F.col("text")).alias("has_secret"))


@PLANS.add("""SELECT doc_id, '[REDACTED]' AS api_key, lang AS name, '' AS token, CASE WHEN source IS NULL OR source = '' THEN source ELSE '[REDACTED]' END AS password, 'see [REDACTED_PATH]' AS note, CASE WHEN coalesce(source, '') <> '' THEN 'account.api_key,account.password,extra' ELSE 'account.api_key,extra' END AS redactions FROM documents""")
def f15_nested_redaction(spark, d):
    """Sensitive names and texts at any depth of a record, with the places that changed."""
    docs = table(spark, d, "documents")
    account = F.struct(F.concat(F.lit("k"), F.col("doc_id")).alias("api_key"), F.col("lang").alias("name"), F.lit("").alias("token"), F.col("source").alias("password"))
    rows = docs.select("doc_id", account.alias("account"), F.create_map(F.lit("note"), F.lit("see /home/me/x"), F.lit("session_id"), F.lit("s1")).alias("extra"))
    out = redaction.redacted(rows)
    return out.select("doc_id", "account.*", F.col("extra")["note"].alias("note"), F.array_join("redactions", ",").alias("redactions"))


@PLANS.add("SELECT match_id, CASE WHEN match_id % 7 = 0 THEN NULL ELSE season_start END AS season FROM matches")
def f17_season_start(spark, d):
    m = matches(spark, d)
    raw = F.when(F.col("match_id") % 7 == 0, "none").otherwise(F.concat(F.lit("season "), F.col("season_start"), F.lit("/"), F.col("season_start") + 1))
    return m.select("match_id", scalars.season_start(raw).alias("season"))


@PLANS.add("SELECT match_id, round(pow(0.5e0, greatest(0, date_diff('day', CAST(kickoff AS DATE), DATE '1998-01-01')) / 365e0), 6) AS weight FROM matches")
def f18_time_weight(spark, d):
    return matches(spark, d).select("match_id", F.round(odds.time_weight(F.datediff(F.lit("1998-01-01").cast("date"), F.col("kickoff").cast("date")).cast("double"), 365.0), R6).alias("weight"))


_Q3 = "SELECT match_id, seq, source_row, 1/p_home/s AS a, 1/p_draw/s AS b, 1/p_away/s AS c, seq % 3 AS y FROM (SELECT *, 1/p_home + 1/p_draw + 1/p_away AS s FROM quotes)"


@PLANS.add(f"SELECT match_id, seq, source_row, round(-(a*ln(a) + b*ln(b) + c*ln(c)), 6) AS entropy, round(-(a*ln(a) + b*ln(b) + c*ln(c)) / ln(3), 6) AS entropy_norm FROM ({_Q3})")
def f19_entropy(spark, d):
    return quotes(spark, d).withColumn("p", odds.devig_multiplicative(_prices())).select("match_id", "seq", "source_row", F.round(odds.entropy(F.col("p")), R6).alias("entropy"), F.round(odds.normalised_entropy(F.col("p")), R6).alias("entropy_norm"))


@PLANS.add(f"""SELECT match_id, seq, source_row, round((pow(a - (y=0)::INT, 2) + pow(b - (y=1)::INT, 2) + pow(c - (y=2)::INT, 2)) / 3, 6) AS brier, round(-ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END), 6) AS log_loss,
    round((pow(a - (y=0)::INT, 2) + pow(a + b - (y<=1)::INT, 2)) / 2, 6) AS rps FROM ({_Q3})""")
def f20_scores(spark, d):
    q = quotes(spark, d).withColumn("p", odds.devig_multiplicative(_prices())).withColumn("y", (F.col("seq") % 3).cast("int"))
    p, y = F.col("p"), F.col("y")
    return q.select("match_id", "seq", "source_row", F.round(odds.brier_mean(p, y), R6).alias("brier"), F.round(odds.log_loss(p, y), R6).alias("log_loss"), F.round(odds.rps(p, y), R6).alias("rps"))


@PLANS.add("""SELECT match_id, round(exp(-r) * pow(r, home_goals) / factorial(CAST(home_goals AS INT)), 6) AS pmf, round(r - home_goals * ln(r) + ln(CAST(factorial(CAST(home_goals AS INT)) AS DOUBLE)), 6) AS nll,
    round(CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - r * r * -0.05e0 WHEN home_goals = 0 AND away_goals = 1 THEN 1 + r * -0.05e0 WHEN home_goals = 1 AND away_goals = 0 THEN 1 + r * -0.05e0 WHEN home_goals = 1 AND away_goals = 1 THEN 1.05e0 ELSE 1e0 END, 6) AS tau
    FROM (SELECT *, 0.8e0 + match_id % 7 / 5e0 AS r FROM matches)""")
def f21_f22_poisson(spark, d):
    m = matches(spark, d).withColumn("r", F.expr("0.8e0 + match_id % 7 / 5e0"))
    h, a, r = F.col("home_goals"), F.col("away_goals"), F.col("r")
    return m.select("match_id", F.round(odds.poisson_pmf(h, r), R6).alias("pmf"), F.round(odds.poisson_nll(h, r), R6).alias("nll"), F.round(odds.dixon_coles_tau(h, a, r, r, F.lit(-0.05)), R6).alias("tau"))


@PLANS.add("SELECT match_id, seq, source_row, CASE WHEN line_q % 2 <> 0 THEN line_q - 1 ELSE line_q END AS leg_low, CASE WHEN line_q % 2 <> 0 THEN line_q + 1 ELSE line_q END AS leg_high, CASE WHEN abs(line_q % 4) = 2 THEN 'binary_win_loss' ELSE 'settlement_weighted' END AS semantics FROM quotes")
def f23_f24_quarter_lines(spark, d):
    legs = odds.quarter_legs(F.col("line_q"))
    return quotes(spark, d).select("match_id", "seq", "source_row", legs[0].alias("leg_low"), legs[1].alias("leg_high"), odds.line_semantics(F.col("line_q") / 4).alias("semantics"))


@PLANS.add("""WITH l AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, c FROM (SELECT DISTINCT c FROM (SELECT unnest(range(101, 200, 1)) AS c UNION ALL SELECT unnest(range(200, 300, 2)) UNION ALL SELECT unnest(range(300, 400, 5)) UNION ALL SELECT unnest(range(400, 600, 10)) UNION ALL SELECT unnest(range(600, 1000, 20))
    UNION ALL SELECT unnest(range(1000, 2000, 50)) UNION ALL SELECT unnest(range(2000, 3000, 100)) UNION ALL SELECT unnest(range(3000, 5000, 200)) UNION ALL SELECT unnest(range(5000, 10000, 500)) UNION ALL SELECT unnest(range(10000, 100001, 1000)))))
    SELECT e.record_id, l.i AS tick, b.i - l.i AS distance FROM (SELECT record_id, CAST(round(price * 100) AS BIGINT) AS c FROM odds_events) e LEFT JOIN l USING (c) LEFT JOIN l b ON b.c = 300""")
def f25_ticks(spark, d):
    e = odds_events(spark, d).select("record_id", F.round(F.col("price") * 100).cast("long").alias("c"))
    return e.select("record_id", odds.tick_index(F.col("c")).cast("long").alias("tick"), (odds.tick_index(F.lit(300)) - odds.tick_index(F.col("c"))).cast("long").alias("distance"))


@PLANS.add("SELECT match_id, seq, source_row, round(100 * (1/p_home + 1/p_draw + 1/p_away), 6) AS book_pct, CASE WHEN p_away >= p_home THEN round(p_away - p_home, 6) END AS spread, CASE WHEN p_away >= p_home THEN round(100 * (1/p_home - 1/p_away), 6) END AS spread_pp FROM quotes")
def f26_implied(spark, d):
    q = quotes(spark, d).withColumn("s", odds.book_spread(F.col("p_home"), F.col("p_away")))
    return q.select("match_id", "seq", "source_row", F.round(100 * odds.total(odds.implied(_prices())), R6).alias("book_pct"), F.round("s.spread", R6).alias("spread"), F.round("s.spread_pp", R6).alias("spread_pp"))


@PLANS.add("""SELECT event_id, CASE WHEN value > 30 THEN 'STALE_BLOCK' WHEN value > 10 THEN 'STALE_WARNING' ELSE 'FRESH' END AS freshness, CASE event_id % 3 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'NOT_EXCLUDED' ELSE 'UNKNOWN' END AS branch,
    CASE WHEN event_id % 5 - 2 > 0 AND value > 20 THEN 'SECONDARY_LEADS_CONFIRMED' WHEN event_id % 5 - 2 > 0 THEN 'SECONDARY_LEADS_UNCONFIRMED' WHEN event_id % 5 - 2 < 0 THEN 'MAINSTREAM_LEADS' ELSE 'SIMULTANEOUS' END AS lead,
    CASE event_id % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'pre_match' WHEN 2 THEN 'finished' ELSE 'UNKNOWN' END AS status FROM events""")
def f27_f29_f30_f31_labels(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    branch = F.when(k % 3 == 0, F.when(k % 2 == 0, "1").otherwise("EXCLUDED")).when(k % 3 == 1, "0")
    state = F.when(k % 4 == 0, "-1").when(k % 4 == 1, "0").otherwise("5")
    return e.select("event_id", scalars.freshness(F.col("value"), 30, 10).alias("freshness"), scalars.draw_branch(branch).alias("branch"), scalars.lead_lag(k % 5 - 2, F.col("value") > 20).alias("lead"), scalars.match_status(state, k % 4 == 2).alias("status"))


@PLANS.add("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 6 < 3 THEN 'REST_LT_3D' WHEN event_id % 6 < 4 THEN 'REST_LT_4D' END, CASE WHEN event_id % 8 <= 3 THEN 'NEXT_PRIORITY_LE_3D' WHEN event_id % 8 <= 5 THEN 'NEXT_PRIORITY_LE_5D' END, CASE WHEN event_id % 9 = 0 THEN 'LONG_TRAVEL' END], lambda x: x IS NOT NULL), ',') AS flags FROM events""")
def f28_schedule_pressure(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.concat_ws(",", scalars.schedule_pressure(k % 6, k % 8, F.when(k % 9 == 0, 3000).otherwise(100))).alias("flags"))


@PLANS.add("SELECT a.n_regionkey AS region, a.n_name || ' vs ' || b.n_name AS alias FROM nation a JOIN nation b USING (n_regionkey)")
def f32_alias_product(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return g.select(F.col("n_regionkey").alias("region"), F.explode(scalars.alias_product(F.col("names"), F.col("names"))).alias("alias"))


@PLANS.add("SELECT book_id, count(*) AS n, count(*) FILTER (WHERE source_row % 3 <> 0 AND book_id <> 5 AND source_row % 11 <> 0) AS usable FROM quotes GROUP BY book_id")
def p01_usable_quotes(spark, d):
    from oddsloom.operators.quotes import usable

    q = quotes(spark, d).selectExpr("*", "CASE source_row % 3 WHEN 0 THEN array('impossible_line', 'timestamp_unverified') WHEN 1 THEN array('timestamp_unverified') ELSE CAST(array() AS ARRAY<STRING>) END AS issues", "IF(book_id = 5, 'unverified', 'verified') AS status", "IF(source_row % 11 = 0, 'SUMMARY', 'HISTORY_EVENT') AS kind")
    ok = usable(F.col("issues"), F.col("status"), F.col("kind"))
    return q.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("usable"))


@PLANS.add("SELECT q.match_id, q.seq, q.source_row, q.ts > m.kickoff + INTERVAL 60 DAY AS after_crawl FROM quotes q JOIN matches m USING (match_id)")
def p02_lookahead_guard(spark, d):
    return quotes(spark, d).join(matches(spark, d).select("match_id", "kickoff"), "match_id").select("match_id", "seq", "source_row", F.expr("ts > kickoff + INTERVAL 60 DAY").alias("after_crawl"))


@PLANS.add("SELECT market, count(*) AS quarantined FROM quotes WHERE match_id NOT IN (SELECT match_id FROM matches WHERE competition = '1-URGENT') GROUP BY market")
def p03_unselected_rows(spark, d):
    return quotes(spark, d).join(matches(spark, d).filter("competition = '1-URGENT'"), "match_id", "left_anti").groupBy("market").agg(F.count(F.lit(1)).alias("quarantined"))


@PLANS.add("SELECT book_id, market, count(*) AS n FROM quotes WHERE book_id IN (0, 2, 4) GROUP BY ALL")
def p04_core_books(spark, d):
    core = spark.range(0, 6, 2).toDF("book_id")
    return quotes(spark, d).join(F.broadcast(core), "book_id", "left_semi").groupBy("book_id", "market").agg(F.count(F.lit(1)).alias("n"))


@PLANS.add("SELECT a.match_id, (SELECT count(*) FROM matches b WHERE b.competition = a.competition AND b.kickoff < a.kickoff) AS known FROM matches a")
def p05_strict_cutoff(spark, d):
    from pyspark.sql import Window

    m = matches(spark, d).withColumn("us", F.unix_micros(F.col("kickoff").cast("timestamp")))
    return m.select("match_id", F.count(F.lit(1)).over(Window.partitionBy("competition").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)).alias("known"))


@PLANS.add("SELECT event_id, 'k' AS key FROM events WHERE props LIKE '%\"k\"%'")
def p06_forbidden_keys(spark, d):
    e = table(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return e.filter(F.col("key").rlike("^(k|result|final_score)$"))


@PLANS.add("""SELECT match_id, seq, source_row, CASE WHEN ts > kickoff + INTERVAL 90 DAY THEN 'CONTEXT_AFTER_KICKOFF' WHEN ts > kickoff + INTERVAL 45 DAY THEN 'CONTEXT_NEWER_THAN_MARKET' ELSE 'OK' END AS reason FROM quotes JOIN matches USING (match_id)""")
def p07_context_order(spark, d):
    q = quotes(spark, d).join(matches(spark, d).select("match_id", "kickoff"), "match_id")
    return q.select("match_id", "seq", "source_row", F.expr("CASE WHEN ts > kickoff + INTERVAL 90 DAY THEN 'CONTEXT_AFTER_KICKOFF' WHEN ts > kickoff + INTERVAL 45 DAY THEN 'CONTEXT_NEWER_THAN_MARKET' ELSE 'OK' END").alias("reason"))


@PLANS.add("SELECT match_id FROM matches WHERE kickoff - INTERVAL 48 HOUR <= TIMESTAMP '1996-01-10 06:00:00' AND TIMESTAMP '1996-01-10 06:00:00' < kickoff - INTERVAL 5 MINUTE")
def p08_active_window(spark, d):
    return matches(spark, d).filter("kickoff - INTERVAL 48 HOURS <= TIMESTAMP_NTZ '1996-01-10 06:00:00' AND TIMESTAMP_NTZ '1996-01-10 06:00:00' < kickoff - INTERVAL 5 MINUTES").select("match_id")


@PLANS.add("SELECT event_type AS market, count(*) AS n_current FROM events WHERE CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOUR AS DATE) GROUP BY event_type")
def p09_source_current(spark, d):
    return table(spark, d, "events").filter("CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOURS AS DATE)").groupBy(F.col("event_type").alias("market")).agg(F.count(F.lit(1)).alias("n_current"))
