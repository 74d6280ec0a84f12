"""Typed views of the library's data model over the warehouse tables.

``matches``, ``quotes``, ``odds_events`` and ``pool`` are derived by plain projections, so column
pruning and filters still reach the Parquet scans. SQL holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS match_id",
        "o_orderdate AS kickoff",
        "o_orderpriority AS competition",
        "year(o_orderdate) AS season_start",
        "o_custkey % 20 AS home_team",
        "(o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_team",
        "(o_orderkey * 7 + o_custkey) % 5 AS home_goals",
        "(o_orderkey * 3 + o_custkey * 2) % 4 AS away_goals",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS match_id",
        "l_suppkey % 6 AS book_id",
        "CASE l_returnflag WHEN 'A' THEN '1x2' WHEN 'N' THEN 'ah' ELSE 'ou' END AS market",
        "l_shipdate AS ts",
        "l_linenumber AS seq",
        "1.2e0 + l_quantity / 10 AS p_home",
        "2.5e0 + l_discount * 10 AS p_draw",
        "1.3e0 + (l_partkey % 400) / 100e0 AS p_away",
        "l_linenumber % 9 - 4 AS line_q",
        "l_partkey AS source_row",
    )


def odds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS match_id", "event_type AS book_key", "ts", "event_id AS record_id", "1.01e0 + value / 100 AS price")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("CAST(ts AS DATE) AS snapshot_date", "user_id AS match_id", "event_type AS market", "CAST(value > 20 AS INT) AS label", "value AS visible", "ts", "event_id")
    last = Window.partitionBy("snapshot_date", "match_id", "market").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("snapshot_date", "match_id", "market", "label", "visible")


SQL = {
    "matches": """SELECT o_orderkey AS match_id, o_orderdate AS kickoff, o_orderpriority AS competition, year(o_orderdate) AS season_start,
        o_custkey % 20 AS home_team, (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_team,
        (o_orderkey * 7 + o_custkey) % 5 AS home_goals, (o_orderkey * 3 + o_custkey * 2) % 4 AS away_goals FROM orders""",
    "quotes": """SELECT l_orderkey AS match_id, l_suppkey % 6 AS book_id, CASE l_returnflag WHEN 'A' THEN '1x2' WHEN 'N' THEN 'ah' ELSE 'ou' END AS market,
        l_shipdate AS ts, l_linenumber AS seq, 1.2e0 + l_quantity / 10 AS p_home, 2.5e0 + l_discount * 10 AS p_draw,
        1.3e0 + (l_partkey % 400) / 100e0 AS p_away, l_linenumber % 9 - 4 AS line_q, l_partkey AS source_row FROM lineitem""",
    "odds_events": "SELECT user_id AS match_id, event_type AS book_key, ts, event_id AS record_id, 1.01e0 + value / 100 AS price FROM events",
    "pool": """SELECT snapshot_date, match_id, market, label, visible FROM (SELECT CAST(ts AS DATE) AS snapshot_date, user_id AS match_id, event_type AS market,
        CAST(value > 20 AS INT) AS label, value AS visible, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names put before it as common table expressions."""
    import re

    used = [k for k in SQL if re.search(rf"\b{k}\b", sql)]
    head = ", ".join(f"{k} AS ({SQL[k]})" for k in used)
    if not head:
        return sql
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
