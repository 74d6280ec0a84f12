"""Best-two-fit packing of tokenised documents into fixed-length training sequences.

Documents of one length are interchangeable, so the packing itself is worked out on the histogram
of piece lengths (at most ``capacity`` counts, whatever the corpus size): each step makes one bin
pattern and uses it as often as the counts allow. The pieces are then numbered within their length,
bucket by bucket, and look their place up from the pattern table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BUCKET_ROWS = 250_000
LONG_RUN = 20_000
LONG_SPACES = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary of a byte-level BPE ``tokenizers`` file as a tiktoken encoder: the same ids, several times as fast."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(keep))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), tuple(special)


@lru_cache(maxsize=2)
def plain_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text with the end id behind; a special token's string in a text is that token, as in ``tokenizers``."""
    enc, special = encoder(path)
    text = text or ""
    if len(text) > LONG_RUN and LONG_SPACES.search(text):  # tiktoken's stack does not hold such a run
        return np.append(np.array(plain_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32), np.uint32(END_ID))
    ids = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
    return np.append(np.array(ids, np.uint32), np.uint32(END_ID))


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else a shorter first piece and full ones."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, total, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the token ids themselves."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), tokenizer)
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n].astype("<u4")
                    rows.append((doc_id, k, s, n, zlib.crc32(part.tobytes()), *((part.astype(np.int32),) * with_ids)))
            cols = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths in order) and how often each is used; counts[l] pieces have length l.

    A bin is filled greedily, largest fitting piece first. If room is left, its smallest piece gives
    way to the two unpacked ones that fit the widened gap most tightly, if they fill more of it.
    """
    left = counts.astype(np.int64).copy()
    have = [int(x) for x in np.flatnonzero(left)]
    patterns: list[tuple[list[int], int]] = []
    while have:
        bin_, used, gap = [have[-1]], {have[-1]: 1}, capacity - have[-1]
        at = bisect_right(have, gap)
        while gap and at:
            size = have[at - 1]
            free = int(left[size]) - used.get(size, 0)
            if free <= 0:
                at -= 1
                continue
            n = min(free, gap // size)
            bin_ += [size] * n
            used[size] = used.get(size, 0) + n
            gap -= n * size
            at = min(at - (n == free), bisect_right(have, gap))
        if gap and len(bin_) > 1:
            last = bin_[-1]
            free = np.array([x for x in have if x < gap + last and left[x] > used.get(x, 0)], np.int64)
            if len(free):
                other = np.searchsorted(free, gap + last - free, "right") - 1
                twice = np.array([left[x] - used.get(int(x), 0) > 1 for x in free])
                other = np.where((other >= 0) & (free[np.maximum(other, 0)] == free) & ~twice, other - 1, other)
                both = np.where(other >= 0, free + free[np.maximum(other, 0)], 0)
                if both.max() > last:
                    k = int(both.argmax())
                    pair = sorted((int(free[k]), int(free[other[k]])), reverse=True)
                    bin_[-1:] = pair
                    used[last] -= 1
                    for x in pair:
                        used[x] = used.get(x, 0) + 1
        used = {x: n for x, n in used.items() if n}
        times = min(int(left[x]) // n for x, n in used.items())
        patterns.append((bin_, times))
        for x, n in used.items():
            left[x] -= n * times
        have = [x for x in have if left[x] > 0]
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For runs of pieces of one length, numbered from ``rank``: the first one's sequence, and the offset that they share."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in patterns:
        offset = 0
        for size in bin_:
            rows.append((size, taken.get(size, 0), base, offset))
            taken[size] = taken.get(size, 0) + times
            offset += size
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are packed each on its own;
    ties in length are broken by doc_id and piece. A null doc_id stays null. An empty table gives no
    rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenised_pieces(docs, tokenizer, capacity))
    sizes = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity)))

    buckets = max(8, -(-int(counts.sum()) // BUCKET_ROWS))
    order = ["doc_id", "piece", "start"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches):
        t = table.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(t["key"], (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def assemble(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids and token ids in order. doc_id must be unique in ``docs``."""
    ids = tokenised_pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids")
    part = F.struct("offset", "doc_id", "ids")
    rows = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))
