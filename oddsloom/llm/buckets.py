"""Links inside the buckets of a similarity index, without a row for each pair.

Rows that share a key are compared where they meet, and only a spanning forest of the verified links
leaves the task. A bucket of more than ``block`` rows is first split by finer keys, of which any two rows
to be linked share one; only a finer bucket that is still too large is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, partitions
from .textops import give_back

BLOCK = 1024
PAIRS_AT_ONCE = 1 << 17


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) as (vertex, least vertex of its component)."""
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(names)))
    return names[at], names[label[at]]


def pairs_of_runs(heads: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the rows in each run; a bounded number of pairs at a time."""
    sizes = np.diff(np.append(heads, n))
    last = np.repeat(heads + sizes, sizes)
    later = last - np.arange(n) - 1  # partners behind each row
    done = 0
    total = np.cumsum(later)
    while done < n:
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        count = later[done:to]
        i = np.repeat(np.arange(done, to), count)
        step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        yield i, i + step + 1
        done = to


def all_pairs(rows: pa.RecordBatch, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return pairs_of_runs(heads, rows.num_rows)


def _hot(keys: DataFrame, block: int, scratch: Scratch, weight: str | None = None) -> tuple[DataFrame, bool]:
    """(key, blocks) of the crowded keys, broadcast if their counted number is small; and if there are any."""
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(weight) if weight else F.lit(1)).alias("full")).filter((F.col("full") > block) & (F.col("rows") > 2))
    hot = scratch.save(full.select("key", F.least("rows", F.ceil(F.col("full") / block)).cast("int").alias("blocks")))
    n = hot.count()
    return (F.broadcast(hot) if n <= 100_000 else hot), n > 0


def _in_blocks(keys: DataFrame, block: int, scratch: Scratch, weight: str | None = None) -> DataFrame:
    """``keys`` with lo and hi: a crowded key's rows once for each pair of blocks that they belong to."""
    plain = keys.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    hot, any_ = _hot(keys, block, scratch, weight)
    if not any_:
        return plain
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parted = keys.join(hot, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.select(*keys.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return plain.join(hot, "key", "left_anti").unionByName(parted)


def bucket_links(keys: DataFrame, verify: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], scratch: Scratch, block: int = BLOCK, propose=all_pairs, split: Callable[[DataFrame], DataFrame] | None = None, weight: str | None = None) -> DataFrame:
    """(a, b) links of ids whose rows share a key and pass ``verify``.

    ``keys``: key long, id long, then any payload columns; ``verify(rows, i, j)`` says which index
    pairs of an Arrow batch of such rows are links; ``propose(rows, heads)`` gives the pairs to look at,
    among the rows from one bucket's head to the next; ``split(rows)`` gives the rows of crowded buckets
    with a column ``sub`` long, rows that may link sharing a value of it. Rows of one id may repeat.
    A bucket is crowded if it has over ``block`` rows, or if its column ``weight`` adds up to more.
    """
    spark = keys.sparkSession
    if split is None:
        plain = _in_blocks(keys, block, scratch, weight)
    else:
        plain = keys.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
        hot, any_ = _hot(keys, block, scratch, weight)
        if any_:
            finer = scratch.save(split(keys.join(hot, "key", "left_semi")).withColumn("key", F.xxhash64("key", "sub")).select(*keys.columns))
            plain = plain.join(hot, "key", "left_anti").unionByName(_in_blocks(finer, block, scratch, weight))
    place = ["key", "lo", "hi"]
    dealt = plain.repartition(max(2, partitions(spark)), *place).sortWithinPartitions(*place)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        at = [rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in place]
        ids = rows.column(rows.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        head = np.ones(len(ids), bool)
        if len(ids) > 1:
            head[1:] = (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]) | (at[2][1:] != at[2][:-1])
        found = []
        for i, j in propose(rows, np.flatnonzero(head)):
            if len(i):
                keep = np.flatnonzero(ids[i] != ids[j])
                i, j = i[keep], j[keep]
                ok = verify(rows, i, j) if len(i) else np.zeros(0, bool)
                if ok.any():
                    found.append(forest(ids[i[ok]], ids[j[ok]]))
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def run(batches):
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            tail = [whole.column(whole.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in place]
            same = np.ones(whole.num_rows, bool)
            for x in tail:
                same &= x == x[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # rows of the last bucket wait for the next batch
            rest = whole.slice(cut)
            if cut and (out := links(whole.slice(0, cut))) is not None:
                yield out
        if rest is not None and (out := links(rest)) is not None:
            yield out
        give_back()

    return dealt.mapInArrow(run, "a long, b long")
