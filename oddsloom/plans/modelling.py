"""Form, priors and dynamic ratings, context updates and publication (M-08, M-12, M-14, M-15, M-18, M-20, K-01, K-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import forms as ops
from oddsloom.operators import response
from oddsloom.sources.bind import matches, pool, quotes

from .registry import Plans

PLANS = Plans()


def _r6(df, *keys):
    return df.select(*keys, *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


@PLANS.add()
def m18_recent_form(spark, d):
    return _r6(ops.recent_form(matches(spark, d)), "match_id", "venue")


@PLANS.add("""WITH s AS (SELECT a.match_id, count(*) AS ga, sum(b.home_goals) AS ha, sum(b.away_goals) AS aa, count(*) FILTER (WHERE b.season_start = a.season_start) AS gn, coalesce(sum(b.home_goals) FILTER (WHERE b.season_start = a.season_start), 0) AS hn, coalesce(sum(b.away_goals) FILTER (WHERE b.season_start = a.season_start), 0) AS an FROM matches a JOIN matches b ON a.competition = b.competition AND b.kickoff < a.kickoff GROUP BY 1)
    SELECT match_id, round(CASE WHEN gn > 0 THEN (hn + 10e0 * CASE WHEN ga > gn THEN (ha - hn) / CAST(ga - gn AS DOUBLE) ELSE ha / CAST(ga AS DOUBLE) END) / (gn + 10e0) ELSE ha / CAST(ga AS DOUBLE) END, 9) AS home_rate, round(CASE WHEN gn > 0 THEN (an + 10e0 * CASE WHEN ga > gn THEN (aa - an) / CAST(ga - gn AS DOUBLE) ELSE aa / CAST(ga AS DOUBLE) END) / (gn + 10e0) ELSE aa / CAST(ga AS DOUBLE) END, 9) AS away_rate FROM s""")
def m20_baseline_history_shrinkage(spark, d):
    b = ops.history_shrinkage(matches(spark, d))
    return b.select("match_id", F.round("home_rate", 9).alias("home_rate"), F.round("away_rate", 9).alias("away_rate"))


@PLANS.add()
def m19_residual_response(spark, d):
    """What both teams' recent form says of the goals beyond the league's rates: four features, two targets, per competition."""
    import uuid

    from oddsloom.plans.ingest import shared_folder

    m = matches(spark, d)
    form = ops.recent_form(m).select("match_id", "venue", "attack", "defence")
    side = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{c}")
    sides = form.groupBy("match_id").agg(*(side(v, c) for v in ("home", "away") for c in ("attack", "defence")))
    rows = m.select("match_id", "competition", "home_goals", "away_goals").join(sides, "match_id").join(ops.league_rates(m), "match_id")
    rows = rows.select("competition", "home_attack", "away_defence", "away_attack", "home_defence", response.log_residual(F.col("home_goals"), F.col("lh")).alias("home"), response.log_residual(F.col("away_goals"), F.col("la")).alias("away"))
    path = f"{shared_folder(spark)}/response/{uuid.uuid4().hex[:12]}"  # read several times below
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    return _r6(response.residual_response(rows, ["home_attack", "away_defence", "away_attack", "home_defence"], ["home", "away"], "competition", ridge=20.0), "competition", "n", "target", "feature")


@PLANS.add()
def m12_fixture_priors(spark, d):
    m = matches(spark, d)
    return _r6(ops.fixture_priors(m.filter("season_start >= 1998"), ops.rating_posteriors(m, "1998-01-01", 365.0)), "match_id")


@PLANS.add()
def m14_dynamic_ratings(spark, d):
    return _r6(ops.dynamic_ratings(matches(spark, d)), "competition", "month", "param")


@PLANS.add()
def m15_dynamic_fixture_priors(spark, d):
    m = matches(spark, d)
    return _r6(ops.dynamic_fixture_priors(m, ops.dynamic_ratings(m)), "match_id")


_UPD = "SELECT match_id, seq, CASE WHEN market = 'ah' THEN 'inflate' ELSE 'mean' END AS kind, line_q / 40e0 AS shift, 0.2e0 + p_draw / 100 AS var, 0.5e0 AS fraction, 0.1e0 * seq AS inflate, CASE WHEN source_row % 4 = 0 THEN 'SHADOW' ELSE 'VALIDATED' END AS status FROM quotes"


@PLANS.add(f"""WITH u AS ({_UPD}), p AS (SELECT match_id, ln(1.2e0 + home_team / 20e0) AS m, 0.09e0 AS v FROM matches), g AS (SELECT match_id, coalesce(sum(fraction / var) FILTER (WHERE status = 'VALIDATED' AND kind = 'mean'), 0) AS a, coalesce(sum(fraction / var * shift) FILTER (WHERE status = 'VALIDATED' AND kind = 'mean'), 0) AS b, coalesce(product(1 + inflate) FILTER (WHERE status = 'VALIDATED' AND kind = 'inflate'), 1) AS k, count(*) FILTER (WHERE status <> 'VALIDATED') AS rejected FROM u GROUP BY 1),
    j AS (SELECT match_id, m, v * coalesce(k, 1) AS v0, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(rejected, 0) AS rejected FROM p LEFT JOIN g USING (match_id)) SELECT match_id, round((m / v0 + a * m + b) / (1 / v0 + a), 6) AS m, round(1 / (1 / v0 + a), 6) AS v, rejected FROM j""")
def m08_context_updates(spark, d):
    u = quotes(spark, d).selectExpr("match_id", "CAST(seq AS INT) AS seq", "IF(market = 'ah', 'inflate', 'mean') AS kind", "line_q / 40e0 AS shift", "0.2e0 + p_draw / 100 AS var", "0.5e0 AS fraction", "0.1e0 * seq AS inflate", "IF(source_row % 4 = 0, 'SHADOW', 'VALIDATED') AS status")
    p = matches(spark, d).selectExpr("match_id", "ln(1.2e0 + home_team / 20e0) AS m", "0.09e0 AS v")
    return _r6(ops.context_updates(p, u), "match_id")


@PLANS.add("SELECT market, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM pool GROUP BY market")
def k01_k04_publish_current(spark, d):
    """Two versions of a batch and a failed one are published; the newest good version is current."""
    import uuid

    from oddsloom.plans.ingest import shared_folder
    from oddsloom.sources import sinks

    p = pool(spark, d).drop("snapshot_date")
    path = f"{shared_folder(spark)}/published/{uuid.uuid4().hex[:12]}"
    sinks.publish(p.withColumn("crawler_ts", F.lit(1)).filter("label = 1"), path, "2024-01-01", "aaaa", "PASS")
    sinks.publish(p.withColumn("crawler_ts", F.lit(2)), path, "2024-01-01", "bbbb", "WARN")
    sinks.publish(p.withColumn("crawler_ts", F.lit(3)).limit(5), path, "2024-01-01", "cccc", "FAIL")
    return sinks.current(spark, path, "crawler_ts").groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"))


@PLANS.add("SELECT market, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, 'PUBLISHED,NO_CHANGES,REVISED,STALE_SOURCE,QUARANTINED' AS history, 'aaaa' AS revisions FROM pool GROUP BY market")
def k01_k02_commit_log(spark, d):
    """A batch, the same again, its revision, an older source and a failed one under one commit log: what was done with each, and what is current."""
    import uuid

    from oddsloom.plans.ingest import shared_folder
    from oddsloom.sources.commits import BatchLog

    p = pool(spark, d).drop("snapshot_date")
    log = BatchLog(spark, f"{shared_folder(spark)}/commits/{uuid.uuid4().hex[:12]}")
    part = p.filter("label = 1")
    said = [log.publish(part, "2024-01-02", "aaaa", 1), log.publish(part, "2024-01-02", "aaaa", 2), log.publish(p, "2024-01-02", "bbbb", 3), log.publish(part, "2024-01-01", "cccc", 4), log.publish(part, "2024-01-03", "dddd", 5, "FAIL")]
    now = log.current().groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"))
    return now.select("*", F.lit(",".join(said)).alias("history"), F.lit(",".join(log.revisions("2024-01-02"))).alias("revisions"))
