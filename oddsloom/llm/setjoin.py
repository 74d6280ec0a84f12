"""Exact Jaccard similarity of shingle sets, the few pairs of a bucket that can reach it, and all links within candidate buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import bucket_links, pairs_of_runs
from .components import connected_components
from .store import Scratch, is_empty, partitions
from .textops import give_back, mix

SHINGLES_AT_ONCE = 1 << 18  # of the pairs compared, which bounds the working arrays
BIT_PAIRS, BIT_WORDS = 1 << 15, 1 << 21  # pairs at once, and words of their bit sets
STAR = 512  # rows that one copy of a leader's set is compared with
CROWD = 1 << 19  # shingles of a group beyond which it is split


def jaccard_by_bits(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As ``jaccard``, for many pairs of few rows: rows as bit sets over the shingles that two of them have, if that is the cheaper way."""
    lists = rows.column(rows.schema.get_field_index("grams"))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(i))
    for lo in range(0, len(i), BIT_PAIRS):
        a, b = i[lo : lo + BIT_PAIRS], j[lo : lo + BIT_PAIRS]
        used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        own = lists.take(pa.array(used))
        row = np.repeat(np.arange(len(used)), size[used])
        _, gram, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = count > 1
        width = int(common.sum()) + 63 >> 6
        if len(used) * width > BIT_WORDS or len(a) * width > 8 * (size[a].sum() + size[b].sum()):
            out[lo : lo + BIT_PAIRS] = jaccard(rows, a, b)
            continue
        place = np.cumsum(common) - 1
        keep = common[gram]
        bit = place[gram[keep]]
        table = np.zeros((len(used), max(1, width)), np.uint64)
        np.bitwise_or.at(table, (row[keep], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        step = max(1, BIT_WORDS // max(1, 4 * width))
        for k in range(0, len(a), step):
            x, y = at[: len(a)][k : k + step], at[len(a) :][k : k + step]
            both = np.bitwise_count(table[x] & table[y]).sum(axis=1, dtype=np.int64)
            out[lo + k : lo + k + len(x)] = both / np.maximum(size[a[k : k + step]] + size[b[k : k + step]] - both, 1)
    return out


def jaccard(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the ``grams`` sets of the index pairs."""
    lists = rows.column(rows.schema.get_field_index("grams"))
    flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros(len(i))
    step = max(1, int(SHINGLES_AT_ONCE // max(1, size.max(initial=1))))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        both = np.concatenate((a, b))
        pair = np.repeat(np.tile(np.arange(len(a)), 2), size[both])
        at = np.repeat(offsets[both] - np.concatenate(([0], np.cumsum(size[both])[:-1])), size[both]) + np.arange(size[both].sum())
        gram = flat[at]
        order = np.lexsort((gram, pair))
        gram, pair = gram[order], pair[order]
        twice = (gram[1:] == gram[:-1]) & (pair[1:] == pair[:-1])
        common = np.bincount(pair[1:][twice], minlength=len(a))
        out[lo : lo + step] = common / np.maximum(size[a] + size[b] - common, 1)
    return out


def prefix_pairs(rows: pa.RecordBatch, heads: np.ndarray, similarity: float):
    """The pairs of a bucket that can reach ``similarity``: they share one of their rarest shingles.

    Of n shingles in any fixed order, the first n - ceil(similarity n) + 1 must meet the other set's. With
    the rarest of the bucket first, these are mostly shingles that no other row has.
    """
    n = rows.num_rows
    lists = rows.column(rows.schema.get_field_index("grams"))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), size)
    bucket = np.searchsorted(heads, np.arange(n), "right").astype(np.uint64)
    _, gram, count = np.unique(mix(lists.flatten().to_numpy().view(np.uint64) ^ mix(bucket)[row]), return_inverse=True, return_counts=True)
    often = count[gram]
    order = np.lexsort((gram, often, row))
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    rank = np.arange(len(order)) - first[row]
    prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    keep = order[(rank < prefix[row]) & (often[order] > 1)]
    keep = keep[np.argsort(gram[keep], kind="stable")]
    gram, row = gram[keep], row[keep]
    runs = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    for i, j in pairs_of_runs(runs, len(gram)):
        i, j = row[i], row[j]
        ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        yield i[ok], j[ok]


def rare_parts(hot: DataFrame, similarity: float) -> DataFrame:
    """The rows (key, id, grams) of crowded buckets with a ``sub`` for each of their rarest shingles that others have.

    Two sets of that similarity share one of the first n - ceil(similarity n) + 1 shingles of each, in any
    common order; here by their number in the bucket, so what a crowd has in common brings nobody together.
    """
    each = hot.select("key", "id", F.size("grams").alias("size"), F.explode("grams").alias("sub"))
    often = each.groupBy("key", "sub").count()
    rank = F.row_number().over(Window.partitionBy("key", "id").orderBy("count", "sub"))
    prefix = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    rare = each.join(often, ["key", "sub"]).withColumn("rank", rank).filter((F.col("rank") <= prefix) & (F.col("count") > 1)).select("key", "id", "sub")
    return rare.join(hot.select("key", "id", "grams"), ["key", "id"]).select("key", "id", "grams", "sub")


def star_links(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (lead, id) of that similarity, as (a, b); ``grams``: id, n, grams.

    A leader's set is sent once for every STAR of its rows and stays in memory while these stream by.
    """
    n = grams.select("id", "n")
    sized = pairs.join(n, "id").join(n.select(F.col("id").alias("lead"), F.col("n").alias("m")), "lead")
    sized = sized.filter(F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9).select("lead", "id")
    shares = sized.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("shares"))
    rows = sized.join(shares, "lead").select("lead", "id", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    rows = rows.join(grams.select("id", "grams"), "id").select("lead", "share", F.lit(1).alias("place"), "id", "grams")
    heads = shares.select(F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(grams.select("id", "grams"), "id")
    heads = heads.select(F.col("id").alias("lead"), "share", F.lit(0).alias("place"), "id", "grams")
    dealt = rows.unionByName(heads).repartition(max(2, partitions(pairs.sparkSession)), "lead", "share").sortWithinPartitions("lead", "share", "place")

    def run(batches):
        head = np.zeros(0, np.int64)
        for batch in batches:
            lead, place, id_ = (batch.column(k).to_numpy() for k in (0, 2, 3))
            sets, found = batch.column(4), []
            for k in range(batch.num_rows):
                own = sets[k].values.to_numpy()
                if place[k] == 0:
                    head = own
                elif len(own):
                    common = np.searchsorted(head, own)
                    same = int((head[np.minimum(common, len(head) - 1)] == own).sum())
                    if same / (len(head) + len(own) - same) >= similarity:
                        found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(id_[found]), pa.array(lead[found])], ["a", "b"])
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


def mixed_parts(hot: DataFrame, similarity: float) -> DataFrame:
    """The rows (key, id, label, n, grams) of crowded groups with a ``sub`` for each rare shingle under which rows of two labels meet.

    As in ``rare_parts``, sets of that similarity share one of these; shingles under which all rows are
    linked already bring nobody together.
    """
    each = hot.select("key", "id", "label", "n", F.explode("grams").alias("sub"))
    often = each.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("key", "id").orderBy("often", "sub"))
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    rare = each.join(often, ["key", "sub"]).withColumn("rank", rank).filter((F.col("rank") <= prefix) & (F.col("often") > 1))
    mixed = rare.groupBy("key", "sub").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key", "sub")
    rare = rare.select("key", "id", "sub").join(mixed, ["key", "sub"])
    return rare.join(hot, ["key", "id"]).select("key", "id", "label", "n", "grams", "sub")


def verified_classes(near: DataFrame, grams: DataFrame, similarity: float, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(id, component): the least id that is reached over links of that Jaccard similarity between ids which meet in a bucket of ``near`` (key, id); ids without a link may be missing.

    ``grams``: id, n, grams (sorted, distinct). First each row is compared with its bucket's least id. Ids that
    this links carry one label; only buckets whose other rows have several labels can still hide a link. These
    are joined to groups, each set is sent once, and in a group all pairs of two labels that share one of their
    rarest shingles are compared; a group with over ``crowd`` shingles is split by these shingles first.
    """
    lead = near.groupBy("key").agg(F.min("id").alias("lead"))
    led = scratch.save(near.join(lead, "key").select("key", "id", "lead").filter("id != lead"))
    pairs = scratch.save(led.select("lead", "id").distinct())
    label = scratch.save(connected_components(scratch.save(star_links(pairs, grams, similarity)), scratch).select("id", F.col("component").alias("label")))
    others = led.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    others = scratch.save(others, drop=led)
    mixed = others.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min("label").alias("least")).filter("l < h")
    left = scratch.save(others.join(mixed.select("key", "least"), "key").select("id", "label", "least").distinct(), drop=others)
    first = label.select("id", F.col("label").alias("component"))
    if is_empty(left):
        return first
    groups = connected_components(left.select("label", "least"), scratch).select(F.col("id").alias("label"), F.col("component").alias("key"))
    rows = left.select("id", "label").distinct().join(groups, "label").join(grams, "id").select("key", "id", "label", "n", "grams")
    rows = scratch.save(rows, drop=left)

    def pairs_of_labels(batch: pa.RecordBatch, heads: np.ndarray):
        tag = batch.column(batch.schema.get_field_index("label")).to_numpy()
        for i, j in prefix_pairs(batch, heads, similarity):
            keep = tag[i] != tag[j]
            i, j = np.divmod(np.unique(i[keep].astype(np.int64) * batch.num_rows + j[keep]), max(1, batch.num_rows))
            yield i, j

    more = scratch.save(bucket_links(rows, lambda batch, i, j: jaccard_by_bits(batch, i, j) >= similarity, scratch, block=crowd, propose=pairs_of_labels, split=lambda hot: mixed_parts(hot, similarity), weight="n"))
    if is_empty(more):
        return first
    tags = rows.select("id", "label").distinct()
    ends = more.join(tags.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(tags.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    wider = scratch.save(connected_components(ends.select("x", "y"), scratch).select(F.col("id").alias("label"), F.col("component").alias("wide")))
    every = label.union(tags).distinct()
    return every.join(wider, "label", "left").select("id", F.coalesce("wide", "label").alias("component"))
