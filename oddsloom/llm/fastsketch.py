"""MinHash near-duplicates by fast similarity sketching.

A sketch has a fixed number of bins. In each round every shingle of a set is hashed to one bin, and a bin
that no earlier round has filled takes the least hash of its shingles; a set much larger than the sketch
is done after one or two rounds. Rounds beyond as many as there are bins go to one bin each, so every
coordinate of every set is filled, and two sets agree in a coordinate with the probability of their Jaccard
similarity, concentrated as for independent samples. Bands of coordinates bring sets together, and
the links are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collide import colliding
from .components import connected_components
from .setjoin import verified_classes
from .simhash import row_key, words_of
from .store import Scratch
from .textops import WORD_BASE, Texts, mix, pieces, sequence_hashes, shingles

ROWS, BANDS = 5, 32  # a pair at a similarity of 0.85 shares no band once in 10^8 times
FEW = 250_000  # row keys up to which they are broadcast, to move only the texts that are asked for
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each text (fewer words: the whole sequence), and the text of each; sorted by both."""
    word, owner = words_of(t)
    gram, at = shingles(word, owner, size)
    who = owner[at]
    count = np.bincount(owner, minlength=len(t))
    few = np.flatnonzero((count > 0) & (count < size))
    start = np.searchsorted(owner, few)
    gram, who = np.concatenate((gram, sequence_hashes(word, start, start + count[few]))), np.concatenate((who, few))
    order = np.lexsort((gram.view(np.int64), who))
    gram, who = gram[order], who[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])
    return gram[new], who[new]


def sketches(gram: np.ndarray, who: np.ndarray, count: int, bins: int) -> np.ndarray:
    """The ``bins`` coordinates of each of ``count`` sets; those of empty sets stay EMPTY."""
    out = np.full(count * bins, EMPTY)
    missing = np.full(count, bins)
    for i in range(2 * bins):
        if not len(gram):
            break
        h = mix(gram ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        slot = who * bins + bin_
        free = out[slot] == EMPTY
        slot, value = slot[free], mix(h[free])
        np.minimum.at(out, slot, value)
        missing -= np.bincount(np.unique(slot) // bins, minlength=count)
        left = missing[who] > 0
        gram, who = gram[left], who[left]
    return out.reshape(count, bins)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A key for each band of each sketch."""
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), np.uint64(b + 1))
        for r in range(rows):
            key = mix(key * WORD_BASE + sketch[:, b * rows + r])
        out[:, b] = key
    return out


def sketched(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, rid, n, sid, keys) of every row: the size of its shingle set, a hash of the set, and its band keys (none for an empty set)."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(2)):
                gram, who = shingle_sets(t, size)
                n = np.bincount(who, minlength=len(t))
                sums = np.zeros(len(gram) + 1, np.uint64)
                np.cumsum(mix(gram ^ np.uint64(0xD1B54A32D192ED03)), out=sums[1:])
                end = np.cumsum(n)
                sid = mix((sums[end] - sums[end - n]) ^ mix(n.astype(np.uint64)))
                keys = band_keys(sketches(gram, who, len(t), rows * bands), rows, bands)[n > 0]
                ends = np.concatenate(([0], np.cumsum((n > 0) * bands))).astype(np.int32)
                own = batch.slice(t.first, len(t))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n), pa.array(sid.view(np.int64)), lists], ["doc_id", "rid", "n", "sid", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text").mapInArrow(run, "doc_id long, rid long, n long, sid long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, n, grams): the shingle sets of the rows ``wanted`` (id, doc_id, rid)."""
    asked = wanted.withColumnsRenamed({"doc_id": "doc_id_", "rid": "rid_"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text")
    rids = wanted.select("rid").distinct()
    if rids.limit(FEW + 1).count() <= FEW:
        own = own.join(F.broadcast(rids), "rid", "left_semi")
    texts = own.join(asked, (F.col("rid") == F.col("rid_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))).select("id", "text")

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(1)):
                gram, who = shingle_sets(t, size)
                n = np.bincount(who, minlength=len(t))
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(n), lists], ["id", "n", "grams"])

    return texts.mapInArrow(run, "id long, n long, grams array<long>").dropDuplicates(["id"])


def similar_documents(docs: DataFrame, similarity: float = 0.85, size: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Rows are linked by a Jaccard similarity of ``similarity`` or more of their sets of distinct ``size``-word
    shingles, A-Z in lower case; a text with fewer words has one shingle, its whole sequence. Null and
    word-less texts have an empty set and no links. Rows with one set are one vertex. component_id is the least doc_id that is
    reachable (null only if all are null), kept says that it is the row's own; rows that repeat a kept doc_id
    are kept alike, rows with a null doc_id only where it names the component. An empty table gives no rows; other columns
    are not read. Shingles and sets with one 64-bit hash count as equal.
    """
    scratch = Scratch(docs.sparkSession, "sketches")
    table = scratch.save(sketched(docs, size, rows, bands))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    full = table.filter("n > 0")
    sets = scratch.save(full.groupBy("sid").agg(F.min(first).alias("first"), F.min("keys").alias("keys")))
    near = scratch.save(colliding(sets.select(F.explode("keys").alias("key"), F.col("sid").alias("id"))))
    wanted = sets.join(near.select(F.col("id").alias("sid")).distinct(), "sid").select(F.col("sid").alias("id"), "first.doc_id", "first.rid")
    grams = scratch.save(sets_of(docs, wanted, size))
    groups = verified_classes(near, grams, similarity, scratch)
    named = sets.join(groups, sets.sid == groups.id, "left").select("sid", "first", F.coalesce("component", "sid").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    by_set = scratch.save(named.join(least, "component").select("sid", F.col("least.doc_id").alias("component_id")))
    out = full.join(by_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
