"""Histogram sort into shards of near equal bytes, in DataFrame operations only.

Rows are ordered by a 63-bit hash of the text and 31 hash bits of the doc_id. Copies of one text are
neighbours, and a hot text can still be cut anywhere between its copies. The splitters are found by
counting exact bytes below candidate borders over all partitions and refining only the cells in which
a target lies, until each is met within the tolerance; then the rows move once, straight to the range
between their splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, partitions

KEY_BITS, TIE_BITS = 63, 31
PROBE_BITS = 9
ROW_BYTES = 16


def refine(rows: DataFrame, column: str, bits: int, targets: dict[int, dict[int, float]], slack: float) -> tuple[dict[int, tuple[int, int]], dict[int, dict[int, float]]]:
    """Borders within each value of ``hot``, from ``rows`` (hot, column, size).

    ``targets``: hot -> target -> bytes of that hot value that lie below it. Each round counts the bytes
    of at most 2^PROBE_BITS cells for each open target. The borders found, target -> (hot, first value
    above); and for targets still off by over ``slack`` inside one single value: value -> target -> bytes.
    """
    found: dict[int, tuple[int, int]] = {}
    stuck: dict[int, dict[int, float]] = {}
    shift = bits
    open_ = {(hot, 0): wanted for hot, wanted in targets.items()}  # (hot, prefix) -> targets inside, and their bytes there
    while open_:
        finer = max(0, shift - PROBE_BITS)
        inside = rows if shift == bits else rows.filter(F.shiftright(column, shift).isin(sorted({p for _, p in open_})))
        cells = sorted((r[0], r[1], r[2]) for r in inside.groupBy("hot", F.shiftright(column, finer)).agg(F.sum("size")).collect())
        deeper: dict[tuple[int, int], dict[int, float]] = {}
        at: dict[tuple[int, int], int] = {}
        last: dict[tuple[int, int], int] = {}
        for hot, cell, size in cells:
            parent = hot, cell >> (shift - finer)
            if parent not in open_:
                continue
            below = at.get(parent, 0)
            for j, want in open_[parent].items():
                if below <= want < below + size:
                    low, high = want - below, below + size - want
                    if min(low, high) <= slack:
                        found[j] = hot, (cell if low <= high else cell + 1) << finer
                    elif finer:
                        deeper.setdefault((hot, cell), {})[j] = low
                    else:
                        stuck.setdefault(cell, {})[j] = low
            at[parent], last[parent] = below + size, cell
        for parent, wanted in open_.items():  # a target at the very end
            for j, want in wanted.items():
                if want >= at.get(parent, 0):
                    found[j] = parent[0], (last.get(parent, -1) + 1) << finer
        open_, shift = deeper, finer
    return found, stuck


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """The first (key, tie) of parts 1 .. parts - 1, from ``keys`` (key, tie, size); within ``tolerance`` of a part's bytes.

    A text that outgrows a part is cut by the tie, between rows of different doc_ids.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / parts
    found, stuck = refine(keys.withColumn("hot", F.lit(0)), "key", KEY_BITS, {0: {j: total * j / parts for j in range(1, parts)}}, slack)
    borders = {j: (value, 0) for j, (_, value) in found.items()}
    if stuck:
        own = keys.filter(F.col("key").isin(sorted(stuck))).withColumn("hot", F.col("key"))
        found, single = refine(own, "tie", TIE_BITS, stuck, slack)
        borders |= found
        for hot, wanted in ((h, w) for h, ts in stuck.items() for w in [{j: x for j, x in ts.items() if j not in found}] if w):
            ties = [(tie, j) for tie, js in single.items() for j in js if j in wanted]
            borders |= {j: (hot, tie) for tie, j in ties}  # rows with one text and id stay together
    return [borders[j] for j in sorted(borders)]


def _over(borders: list[tuple[int, int]]) -> Column:
    """The number of borders at or below a row: a binary search, written as nested conditions."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        key, tie = borders[mid]
        last = (1 << KEY_BITS) - 1
        above = F.lit(False) if key > last else (F.col("key") > key) | ((F.col("key") == key) & (F.col("tie") >= tie))
        return F.when(above, pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(borders))


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.0005) -> DataFrame:
    """Deal all documents to ``shards`` shards of near equal bytes; rows: doc_id, document, size, text_crc32, shard, slot.

    ``document`` is the whole row of ``docs``, which moves to its shard: a partition holds a range of one shard, in the order of
    its slots. Equal texts are neighbours in the order and may lie in two shards only at a border or when they outgrow one. Rows
    with the same doc_id and text stay together. A null text counts as empty, a null doc_id is an id like any other. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    text, doc_id = F.coalesce(F.col("document.text"), F.lit("")), F.col("document.doc_id")
    keys = [
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"),
        F.xxhash64(doc_id).bitwiseAND(F.lit((1 << TIE_BITS) - 1)).alias("tie"),
    ]
    narrow = Scratch(spark, "sharding").save(whole.select(*keys))
    per = max(1, -(-partitions(spark) // shards))  # ranges of a shard, so that all tasks have work
    borders = splitters(narrow, shards * per, tolerance)
    if not borders:
        borders = [(1 << KEY_BITS, 0)] * (shards * per - 1)
    part = _over(borders)
    # a partition is one range: places within it come from the order of its rows, and those of ranges from their counts
    moved = whole.select("document", *keys).withColumn("part", part).repartitionById(shards * per, F.col("part"))
    moved = moved.sortWithinPartitions("part", "key", "tie", doc_id).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.floor(F.col("part") / per).cast("int")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = narrow.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard)
    base = base.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each range
    placed = moved.join(F.broadcast(base), "part")
    return placed.select(doc_id.cast("long").alias("doc_id"), "document", "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), shard.alias("shard"), (F.col("at") + F.col("base")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents that ``placed`` holds as one folder per shard, in slot order within each file, with the columns of ``docs``."""
    placed.select(*(F.col(f"document.`{c}`") for c in docs.columns if c not in ("shard", "slot")), "shard", "slot").write.partitionBy("shard").parquet(path)
