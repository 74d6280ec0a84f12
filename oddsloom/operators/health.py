"""Health of batches of quotes: events per match, and rates and drops of a batch against those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXTREME_OVERROUND, SUM_TOLERANCE = 0.25, 1e-9
IMPOSSIBLE_RATE, CONFLICT_RATE = 0.10, 0.05
COVERAGE_WARN, COVERAGE_FAIL, COLLAPSE_FROM = 0.25, 0.50, 0.80
STRUCTURE_WARN, STRUCTURE_FAIL = 0.45, 0.70
MISSING_WARN, MISSING_FAIL = 0.30, 0.80
WINDOW = 5


def conflicting_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups of one book, market, time and line whose prices differ."""
    g = rows.groupBy(*keys, "book_id", "market", "ts", "line").agg(F.min("prices").alias("low"), F.max("prices").alias("high"))
    return g.filter("low <> high")


def disordered_groups(rows: DataFrame) -> DataFrame:
    """(match_id, book_id, market) whose times go back in the order of the source."""
    w = Window.partitionBy("match_id", "book_id", "market").orderBy("seq", "row_no")
    return rows.withColumn("before", F.lag("ts").over(w)).filter("ts < before").select("match_id", "book_id", "market").distinct()


def semantic_events(rows: DataFrame) -> DataFrame:
    """(match_id, code, severity, n) of seven checks of each match.

    ``rows``: match_id, book_id, market, ts, seq, row_no, line, prices, and what is known of each quote: impossible, over (margin),
    devig_sum, conflict (the book's identity), core (a core book), foreign_row (another match's). One aggregation gives five checks, two
    come from groups of quotes.
    """
    count = lambda c: F.count_if(c)
    m = rows.groupBy("match_id").agg(
        count(F.col("impossible")).alias("impossible"),
        count(F.abs(F.col("devig_sum") - 1) > SUM_TOLERANCE).alias("bad_sum"),
        count((F.col("market") == "1x2") & (F.col("over") > EXTREME_OVERROUND)).alias("extreme"),
        count(F.col("conflict")).alias("conflicts"),
        count(F.col("conflict") & F.col("core")).alias("core_conflicts"),
        count(F.col("foreign_row")).alias("foreign_rows"),
    )
    event = lambda code, severity, n: F.struct(code.alias("code"), severity.alias("severity"), n.alias("n"))
    core = F.col("core_conflicts") > 0
    found = F.array(
        event(F.lit("IMPOSSIBLE_ODDS_OR_LINE"), F.lit("WARN"), F.col("impossible")),
        event(F.lit("DEVIG_SUM_INVALID"), F.lit("FAIL"), F.col("bad_sum")),
        event(F.lit("EXTREME_OVERROUND"), F.lit("WARN"), F.col("extreme")),
        event(F.when(core, "CORE_BOOKMAKER_IDENTITY_CONFLICT").otherwise("BOOKMAKER_IDENTITY_CONFLICT"), F.when(core, "FAIL").otherwise("WARN"), F.col("conflicts")),
        event(F.lit("CROSS_MATCH_CONTAMINATION"), F.lit("FAIL"), F.col("foreign_rows")),
    )
    out = m.select("match_id", F.explode(found).alias("x")).select("match_id", "x.*").filter("n > 0")
    grouped = lambda g, code: g.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).select("match_id", F.lit(code).alias("code"), F.lit("WARN").alias("severity"), "n")
    out = out.unionByName(grouped(conflicting_groups(rows, "match_id"), "CONFLICTING_DUPLICATE"))
    return out.unionByName(grouped(disordered_groups(rows), "TIMELINE_SOURCE_REVERSE_ORDER"))


def batch_events(rows: DataFrame) -> DataFrame:
    """(batch, code, severity, what): rates of each batch, and its drops against the mean of the WINDOW batches before it.

    ``rows``: as for ``semantic_events`` with batch and no_time. What is compared over time is one row a batch, or one a batch,
    market and book, however many quotes there are.
    """
    per_match = rows.groupBy("batch", "match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("impossible").alias("impossible"), F.count_if("no_time").alias("no_time"))
    r = per_match.groupBy("batch").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("matches"), F.sum("impossible").alias("impossible"), F.sum("no_time").alias("no_time"))
    groups = conflicting_groups(rows, "batch", "match_id").groupBy("batch").agg(F.count(F.lit(1)).alias("groups"))
    before = Window.orderBy("batch").rowsBetween(-WINDOW, -1)  # over batches, not quotes
    r = r.join(groups, "batch", "left").withColumn("per_match", F.col("records") / F.col("matches")).withColumn("base", F.avg("per_match").over(before))
    covered = rows.select("batch", "market", "book_id", "match_id").distinct().groupBy("batch", "market", "book_id").agg(F.count(F.lit(1)).alias("covered"))
    own = Window.partitionBy("market", "book_id").orderBy("batch").rowsBetween(-WINDOW, -1)
    v = covered.join(r.select("batch", "matches"), "batch").withColumn("cov", F.col("covered") / F.col("matches")).withColumn("was", F.avg("cov").over(own))
    missing, drop = F.col("no_time") / F.col("records"), (F.col("base") - F.col("per_match")) / F.col("base")
    none = F.lit(None).cast("string")
    event = lambda ok, code, severity: F.when(ok, F.struct(code.alias("code"), severity.alias("severity"), none.alias("what")))
    graded = lambda fail: F.when(fail, "FAIL").otherwise("WARN")
    found = F.array_compact(
        F.array(
            event(F.col("base").isNull(), F.lit("HISTORICAL_BASELINE_UNAVAILABLE"), F.lit("INFO")),
            event(drop >= STRUCTURE_WARN, F.lit("STRUCTURAL_DEGRADATION_ALERT"), graded(drop >= STRUCTURE_FAIL)),
            event(missing >= MISSING_WARN, F.when(missing >= MISSING_FAIL, "TIMESTAMP_FORMAT_OR_PARSE_FAILURE").otherwise("MISSING_TIMESTAMPS_HIGH"), graded(missing >= MISSING_FAIL)),
            event(F.col("impossible") / F.col("records") >= IMPOSSIBLE_RATE, F.lit("IMPOSSIBLE_ODDS_WIDESPREAD"), F.lit("FAIL")),
            event(F.coalesce("groups", F.lit(0)) / F.col("records") >= CONFLICT_RATE, F.lit("CONFLICTING_DUPLICATES_WIDESPREAD"), F.lit("FAIL")),
        )
    )
    change = F.col("cov") - F.col("was")
    drops = v.filter(change < -COVERAGE_WARN).select("batch", F.lit("COVERAGE_DROP_ALERT").alias("code"), graded((change <= -COVERAGE_FAIL) & (F.col("was") >= COLLAPSE_FROM)).alias("severity"), F.concat_ws(":", "market", F.col("book_id").cast("string")).alias("what"))
    return r.select("batch", F.explode(found).alias("x")).select("batch", "x.*").unionByName(drops)
