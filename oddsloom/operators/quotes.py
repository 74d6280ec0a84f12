"""Quote operators: validity, identity, deduplication, movements and synchronised slices.

All of them group by match (and book, market), so one hash partitioning of the quotes by match serves
a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(issues: Column, identity_status: Column, record_type: Column) -> Column:
    """Quotes to calculate with: no issue but an unverified time, verified identity, record-level history."""
    return (F.size(F.array_except(issues, F.array(F.lit("timestamp_unverified")))) == 0) & (identity_status == "verified") & F.coalesce(record_type == "HISTORY_EVENT", F.lit(True))


def resolve_books(quotes: DataFrame, books: DataFrame, key: str = "book_key") -> DataFrame:
    """Add book_name and identity_status (verified, unverified, conflict) from a book dimension (book_key, book_name, full_names)."""
    joined = quotes.join(books.select(key, "book_name", "full_names"), key, "left")
    conflict = F.col("raw_name").isNotNull() & ~F.array_contains("full_names", F.col("raw_name"))
    status = F.when(F.col("book_name").isNull(), "unverified").when(conflict, "conflict").otherwise("verified")
    return joined.withColumn("identity_status", status).drop("full_names")


def deduplicate(rows: DataFrame, key: list[str], order: list[str], never: list[str]) -> DataFrame:
    """Keep the first row of each key; rows with a null in ``never`` are all kept. Adds kept_first: the first row's order value."""
    w = Window.partitionBy(*key).orderBy(*order)
    open_ = F.lit(False)
    for c in never:
        open_ = open_ | F.col(c).isNull()
    return rows.withColumn("dup_rank", F.when(open_, 1).otherwise(F.row_number().over(w))).withColumn("kept_first", F.first(order[0]).over(w))


def movements(rows: DataFrame, part: list[str], order: list[str], line: str, prices: list[str]) -> DataFrame:
    """Flag each quote as a line move or a price move against its predecessor; a null line breaks the pair."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.lag(line).over(w)
    first = F.row_number().over(w) == 1
    pair = ~first & F.col(line).isNotNull() & before.isNotNull()
    moved = F.lit(False)
    for p in prices:
        moved = moved | (F.lag(p).over(w) != F.col(p))
    return rows.withColumn("line_move", (pair & (F.col(line) != before)).cast("int")).withColumn("price_move", (pair & (F.col(line) == before) & moved).cast("int"))


def gaps(rows: DataFrame, part: list[str], order: list[str], large_hours: float) -> DataFrame:
    """Per partition: quotes, the greatest gap in hours and whether it is large."""
    w = Window.partitionBy(*part).orderBy(*order)
    hours = (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(F.lag(order[0]).over(w).cast("timestamp"))) / 3.6e9
    return rows.withColumn("gap_hours", hours).groupBy(*part).agg(F.count(F.lit(1)).alias("n_quotes"), F.max("gap_hours").alias("max_gap_hours"), F.coalesce(F.max("gap_hours") > large_hours, F.lit(False)).alias("large_gap"))


def synchronised_slices(quotes: DataFrame, tolerance_minutes: float = 30.0) -> DataFrame:
    """For every distinct quote time of a match, the nearest quote of each of its books.

    ``quotes``: match_id, book_key, ts, record_id, price. Equal gaps prefer the past, equal times the
    least record_id. An as-of join by two window fills over targets and quotes together: linear in
    targets x books of one match instead of a scan of all its quotes for each target.
    """
    q = quotes.select("match_id", "book_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "record_id", "price")
    first = q.groupBy("match_id", "book_key", "us").agg(F.min(F.struct("record_id", "price")).alias("x"))
    targets = q.select("match_id", "us").distinct()
    grid = targets.join(q.select("match_id", "book_key").distinct(), "match_id")
    rows = grid.join(first, ["match_id", "book_key", "us"], "left").withColumn("x", F.when(F.col("x").isNotNull(), F.struct("us", "x.record_id", "x.price")))
    w = Window.partitionBy("match_id", "book_key").orderBy("us")
    past = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("x", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("past", past).withColumn("later", later)
    back, ahead = F.col("us") - F.col("past.us"), F.col("later.us") - F.col("us")
    pick = F.when(F.col("past").isNull() | (ahead < back), F.col("later")).otherwise(F.col("past"))
    rows = rows.withColumn("pick", pick).withColumn("gap_minutes", F.abs(F.col("pick.us") - F.col("us")) / 6e7)
    return rows.select("match_id", "book_key", "us", F.col("pick.record_id").alias("record_id"), F.col("pick.price").alias("price"), "gap_minutes", (F.col("pick.us") > F.col("us")).alias("lookahead"), (F.col("gap_minutes") <= tolerance_minutes).alias("aligned"))


def slice_status(slices: DataFrame, least_books: int = 2) -> DataFrame:
    """Per match and target: books, aligned books and whether the slice is aligned (at least two, and all)."""
    out = slices.groupBy("match_id", "us").agg(F.count(F.lit(1)).alias("books"), F.sum(F.col("aligned").cast("long")).alias("aligned_books"))
    return out.withColumn("slice_aligned", (F.col("aligned_books") >= least_books) & (F.col("aligned_books") == F.col("books")))
