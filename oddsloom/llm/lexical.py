"""Ranked lexical search: every document scored for every item by dense blocked matrix products.

The items are dealt into blocks of bounded text, and a block into tiles of items with a compact
vocabulary of their own. A document tile holds the impacts of the terms that it shares with an item
tile; one BLAS product of the two in float64 gives all scores. Weights and impacts are integers and a
product runs over so few terms that its sums stay below 2^53, so they are exact; wider vocabularies are
summed up in 64-bit integers. A task keeps the ``k`` best documents of each item, ties by doc_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import Texts, pieces

TERM_BYTES = np.zeros(256, bool)
for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM_BYTES[lo:hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 4 << 20  # of item texts whose index is broadcast
TILE_ITEMS, TILE_TERMS = 256, 4096
IMPACT = 1_000_000  # an impact is never above it
HELD = 1 << 19  # candidates that a task gathers before it keeps the best
PARTS = 32  # of an item's candidates, in the first of two rounds


def terms_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every term, A-Z in lower case."""
    low = Texts(t.first, LOWER[t.data], t.offsets)
    s, e = low.runs(TERM_BYTES[low.data])
    return low.hashes(s, e), low.of(s)


@dataclass
class Tile:
    """Some items and the terms that they hold: ``row``, ``column`` are the places of the weights in the dense matrix."""

    items: np.ndarray  # numbers of the items in their block
    slots: np.ndarray  # the block's terms that are columns here
    row: np.ndarray
    column: np.ndarray


@dataclass
class Index:
    """A block of items: distinct texts ``rid``, sorted term hashes, and tiles."""

    rid: np.ndarray
    vocabulary: np.ndarray
    tiles: list[Tile]

    def slots(self, word: np.ndarray) -> np.ndarray:
        """The place of each hash in the vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == word, at, -1)


def build_index(rids: list[int], texts: list[str]) -> Index:
    """The tiles of these texts, in their order; an item with more terms than a tile has is a tile by itself."""
    word, item = [], []
    for t in pieces(pa.array(texts, pa.string())):
        w, owner = terms_of(t)
        word.append(w)
        item.append(owner + t.first)
    word = np.concatenate([*word, np.zeros(0, np.uint64)])
    item = np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)
    vocabulary, slot = np.unique(word, return_inverse=True)
    pair = np.unique(item * max(1, len(vocabulary)) + slot)
    item, slot = np.divmod(pair, max(1, len(vocabulary)))
    first = np.searchsorted(item, np.arange(len(rids) + 1))
    tiles, at = [], 0
    while at < len(rids):
        to, seen = at, set()
        while to < len(rids) and to - at < TILE_ITEMS:
            more = seen | set(slot[first[to] : first[to + 1]].tolist())
            if to > at and len(more) > TILE_TERMS:
                break
            seen, to = more, to + 1
        own = slice(first[at], first[to])
        slots, column = np.unique(slot[own], return_inverse=True)
        if len(slots):
            tiles.append(Tile(np.arange(at, to), slots, item[own] - at, column))
        at = to
    return Index(np.array(rids, np.int64), vocabulary, tiles)


def _counts(docs: DataFrame, index) -> dict[int, int]:
    """How many documents hold each term of the index; -1: documents with a term, -2: all terms."""

    def run(batches):
        x = index.value
        n_terms = len(x.vocabulary)
        df, some, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for t in pieces(batch.column(0)):
                word, owner = terms_of(t)
                slot = x.slots(word)
                hit = slot >= 0
                pair = np.unique(owner[hit].astype(np.int64) * max(1, n_terms) + slot[hit])
                df += np.bincount(pair % max(1, n_terms), minlength=n_terms)[:n_terms] if len(pair) else 0
                some += len(np.unique(owner))
                total += len(word)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], at))), pa.array(np.concatenate(([some, total], df[at])))], ["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    return {r["slot"]: r["n"] for r in rows}


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w.T of two non-negative integer matrices held in float64, exact: no partial sum reaches 2^53."""
    most = int(x.max(initial=0)) * int(w.max(initial=0))
    step = max(1, min(TILE_TERMS, ((1 << 53) - 1) // max(1, most)))
    out = np.zeros((len(x), len(w)), np.int64)
    for lo in range(0, x.shape[1], step):
        out += np.rint(x[:, lo : lo + step] @ w[:, lo : lo + step].T).astype(np.int64)
    return out


class Best:
    """The ``k`` best documents of each item so far: highest score, then least doc_id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.kept.append((item, score, doc, null))
        self.held += len(item)
        if self.held > HELD:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.kept:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        item, score, doc, null = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        at = rank == self.k - 1
        self.least[item[at]] = score[at]
        keep = rank < self.k
        self.kept = [(item[keep], score[keep], doc[keep], null[keep])]
        self.held = 0  # what has been added since
        return self.kept[0]


def _ranked(docs: DataFrame, index, weight, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(rid, doc_id, score): of each task the ``k`` best documents of each item."""

    def run(batches):
        x, w_of = index.value, weight.value
        best = Best(len(x.rid), k)
        wide = max(1, len(x.vocabulary))
        for batch in batches:
            for t in pieces(batch.column(1)):
                own = batch.column(0).slice(t.first, len(t))
                null = own.is_null().to_numpy(zero_copy_only=False)
                ids = own.fill_null(0).to_numpy()
                word, owner = terms_of(t)
                m = np.array([100 - 50 + (50 * int(c) * n_docs) // n_terms if n_terms else 50 for c in np.bincount(owner, minlength=len(t))], np.int64)
                slot = x.slots(word)
                hit = slot >= 0
                pair, tf = np.unique(owner[hit].astype(np.int64) * wide + slot[hit], return_counts=True)
                doc, slot = np.divmod(pair, wide)
                impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 20 * m[doc])
                for tile in x.tiles:
                    column = np.minimum(np.searchsorted(tile.slots, slot), len(tile.slots) - 1)
                    mine = np.flatnonzero(tile.slots[column] == slot)
                    if not len(mine):
                        continue
                    docs_here, row = np.unique(doc[mine], return_inverse=True)
                    used, place = np.unique(column[mine], return_inverse=True)  # only columns with an impact
                    dense = np.zeros((len(docs_here), len(used)))
                    dense[row, place] = impact[mine]
                    to = np.full(len(tile.slots), -1)
                    to[used] = np.arange(len(used))
                    in_use = to[tile.column] >= 0
                    items = np.zeros((len(tile.items), len(used)))
                    items[tile.row[in_use], to[tile.column[in_use]]] = w_of[tile.slots[tile.column[in_use]]]
                    score = products(dense, items)
                    d, i = np.nonzero(score >= best.least[tile.items])
                    best.add(tile.items[i], score[d, i], ids[docs_here[d]], null[docs_here[d]])
        item, score, doc, null = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(x.rid[item]), pa.array(doc, mask=null), pa.array(score)], ["rid", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rid long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each row of ``items`` (item_id, text), scores above 0.

    The score sums weight times impact over an item's distinct terms, in integers. Equal scores go by
    ascending doc_id, null ids last; each row of ``docs`` counts as a document, repeated ones too. Null and
    term-less texts have no terms: such documents are never ranked and such items have no rows. Items with
    one text are searched for once. Empty tables give no rows. Other columns are not read. Terms with one
    62-bit hash count as equal.
    """
    spark = docs.sparkSession
    key = F.xxhash64("text").alias("rid")
    own = items.select("item_id", key, "text").filter(F.col("text").isNotNull())
    texts = own.groupBy("rid").agg(F.min("text").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(2 * size / BLOCK_BYTES))
    found = None
    for b in range(blocks):
        rows = sorted(texts.filter(F.pmod("rid", F.lit(blocks)) == b).collect(), key=lambda r: r["rid"])
        built = build_index([r["rid"] for r in rows], [r["text"] for r in rows])
        index = spark.sparkContext.broadcast(built)
        counts = _counts(docs, index)
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        weight = spark.sparkContext.broadcast(weights(np.array([counts.get(s, 0) for s in range(len(built.vocabulary))], np.int64), n_docs))
        best = _ranked(docs, index, weight, n_docs, n_terms, k)
        found = best if found is None else found.union(best)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    once = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("rid", "part").orderBy(*order))).filter(F.col("rank") <= k)
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).filter(F.col("rank") <= k).select("rid", "rank", "doc_id", "score")
    return own.select("item_id", "rid").join(top, "rid").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT item_id, row_number() OVER () AS item_row, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
total AS (SELECT count(*) AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT row_id, doc_id, 100 - 50 + (50 * len(terms)::BIGINT * N) // L AS m FROM d, total WHERE len(terms) > 0),
s AS (SELECT i.item_id, i.item_row, m.doc_id, m.row_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score FROM i JOIN w ON i.term = w.term JOIN tf ON tf.term = i.term JOIN m ON m.row_id = tf.row_id GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
