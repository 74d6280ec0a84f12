"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints at most ``distance`` bits apart agree in one of ``(distance + 1) // 2`` segments up to a
single bit. Every distinct fingerprint is therefore indexed under each segment with each one bit left
out; equal keys meet in a join, and the full distance is verified.

``simhash_groups`` finds every pair of 64-bit fingerprints that close. ``drop_near_copies`` looks for whole
documents with a shingle similarity of 0.8 or more, which lie much further apart than a few bits: it has
longer signatures, so that one of several segments is likely to differ by at most one bit. Close signatures
form groups, and in a group every pair of texts that reaches the similarity is found on the full sets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import BLOCK, bucket_links
from .collide import colliding
from .components import connected_components
from .setjoin import verified_classes
from .store import Scratch, is_empty
from .textops import Texts, mix, pieces, sequence_hashes, shingles

BITS = 64
SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# the signatures of whole documents: over word pairs, which an edited word disturbs least
PAIR = 2
WORDS = 3  # of 64 bits
FP = ("f0", "f1", "f2")
SEGMENT_BITS, SEGMENTS = 26, 7
APART = 26  # of 182 bits; pairs at a five-word similarity of 0.8 are some 17 apart, unrelated ones some 87
ROWS_AT_ONCE = 1 << 14
FEW = 250_000  # row keys up to which they are broadcast, to move only the texts that are asked for


def row_key() -> Column:
    """With the doc_id, what tells rows apart: equal rows are one."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid")


def words_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word, A-Z in lower case."""
    low = Texts(t.first, np.frombuffer(t.data.tobytes().translate(LOWER), np.uint8), t.offsets)
    ws, we = low.words()
    return low.hashes(ws, we), low.of(ws)


def fingerprint(text: str | None, size: int) -> int:
    """64 bits: set if set in over half of the hashes of all ``size``-word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1)) if len(words) > 1 else np.zeros(1, np.int64)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=False)] or [digest(joined, SEED)]
    table = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = table.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(key, id) of each fingerprint: every segment with every one of its bits left out."""
    count = (distance + 2) // 2
    borders = [BITS * k // count for k in range(count + 1)]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = []
            for k, (lo, hi) in enumerate(zip(borders, borders[1:], strict=False)):
                part = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) if hi - lo < 64 else fp
                for bit in range(hi - lo):
                    low = part & np.uint64((1 << bit) - 1)
                    high = (part >> np.uint64(bit + 1)) << np.uint64(bit)
                    value = high | low
                    if hi - lo > 56:
                        keys.append((value * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(k * 64 + bit))
                    else:
                        keys.append(value | np.uint64((k * 64 + bit) << (hi - lo - 1)))
            if keys:
                key = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fp.view(np.int64), len(keys)))], ["key", "id"])

    return fps.select("fp").mapInArrow(run, "key long, id long")


def parts_elsewhere(hot: DataFrame, distance: int) -> DataFrame:
    """The rows (key, id) of crowded buckets with a ``sub`` for each of ``distance + 1`` parts of the bits outside the key's segment.

    Fingerprints at most ``distance`` bits apart are equal in one of these parts.
    """
    count = (distance + 2) // 2
    borders = [BITS * k // count for k in range(count + 1)]

    def run(batches):
        for batch in batches:
            key, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            segment = (key >> np.uint64(BITS // count - 1)).astype(np.int64) // 64
            out = []
            for part in range(distance + 1):
                sub = np.zeros(len(fp), np.uint64)
                for k, (lo, hi) in enumerate(zip(borders, borders[1:], strict=False)):
                    bits = [b for b in range(BITS) if not lo <= b < hi]
                    own = bits[len(bits) * part // (distance + 1) : len(bits) * (part + 1) // (distance + 1)]
                    mask = np.uint64(sum(1 << b for b in own))
                    sub = np.where(segment == k, (fp & mask) ^ (np.uint64(part + 1) * np.uint64(0x9E3779B97F4A7C15)), sub)
                out.append(sub)
            if len(fp):
                n = distance + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(key.view(np.int64), n)), pa.array(np.tile(fp.view(np.int64), n)), pa.array(np.concatenate(out).view(np.int64))], ["key", "id", "sub"])

    return hot.select("key", "id").mapInArrow(run, "key long, id long, sub long")


def simhash_groups(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Words are lower-cased in A-Z only. Null and word-less texts have fingerprint zero, which links like
    any other. Copies share a fingerprint and are compared once. Rows that repeat a doc_id stay; a row
    with a null doc_id keeps a null doc_id and never names a component unless all its members are null.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.save(fingerprints(docs, size))
    fps = scratch.save(table.groupBy("fp").agg(F.min("doc_id").alias("least")))

    def near(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = rows.column(rows.schema.get_field_index("id")).to_numpy(zero_copy_only=False).view(np.uint64)
        return np.bitwise_count(fp[i] ^ fp[j]) <= distance

    finer = (lambda hot: parts_elsewhere(hot, distance)) if BITS % ((distance + 2) // 2) == 0 and distance > 1 else None
    links = scratch.save(bucket_links(variants(fps, distance), near, scratch, split=finer))
    groups = connected_components(links, scratch)
    named = fps.join(groups, fps.fp == groups.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    out = table.join(by_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, f0, f1, f2): 192 signature bits of every row, over its distinct word pairs (fewer words: the word)."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(2)):
                word, owner = words_of(t)
                gram, at = shingles(word, owner, PAIR)
                who = owner[at]
                lone = np.flatnonzero(np.bincount(owner, minlength=len(t)) == 1)
                gram, who = np.concatenate((gram, word[np.searchsorted(owner, lone)])), np.concatenate((who, lone))
                order = np.lexsort((gram, who))
                gram, who = gram[order], who[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])
                gram, who = gram[new], who[new]
                total = np.zeros((len(t), 64 * WORDS), np.int32)
                for lo in range(0, len(gram), ROWS_AT_ONCE):
                    g, w = gram[lo : lo + ROWS_AT_ONCE], who[lo : lo + ROWS_AT_ONCE]
                    hashes = np.stack([mix(g ^ np.uint64(SEED + k)) for k in range(WORDS)], axis=1)
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(g), -1), axis=1, bitorder="little")
                    heads = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    total[w[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
                over = total * 2 > np.bincount(who, minlength=len(t))[:, None]
                fp = np.packbits(over, axis=1, bitorder="little").view(np.int64).reshape(len(t), WORDS)
                own = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS))], ["doc_id", "rid", *FP])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text").mapInArrow(run, "doc_id long, rid long, " + ", ".join(f"{x} long" for x in FP))


def segment_variants(sigs: DataFrame) -> DataFrame:
    """(key, id) of each signature: every one of SEGMENTS segments with every one of its bits left out."""

    def run(batches):
        for batch in batches:
            words = [batch.column(k).to_numpy().view(np.uint64) for k in range(1, WORDS + 1)]
            keys = []
            for k in range(SEGMENTS):
                at, shift = divmod(k * SEGMENT_BITS, 64)
                part = words[at] >> np.uint64(shift)
                if shift + SEGMENT_BITS > 64:
                    part = part | (words[at + 1] << np.uint64(64 - shift))
                part = part & np.uint64((1 << SEGMENT_BITS) - 1)
                for bit in range(SEGMENT_BITS):
                    value = ((part >> np.uint64(bit + 1)) << np.uint64(bit)) | (part & np.uint64((1 << bit) - 1))
                    keys.append(value | np.uint64((k * SEGMENT_BITS + bit) << SEGMENT_BITS))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(batch.column(0).to_numpy(), len(keys)))], ["key", "id"])

    return sigs.select("id", *FP).mapInArrow(run, "key long, id long")


def apart(other: str) -> Column:
    """Bits in which a signature differs from that in the columns FP with the prefix ``other``."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(other + x))) for x in FP), F.lit(0))


def by_rings(hot: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the rows (key, id, FP) of crowded buckets to their bucket's least row, and the rows among which others may be left.

    Bits apart are a metric: rows in one ring of APART + 1 bits around the least row are close only to rows of
    the same or a neighbouring ring. So each row goes on under two rings, and a ring whose rows are all linked
    already is done: that of a family around its least row, whatever its size.
    """
    lead = hot.groupBy("key").agg(F.min(F.struct("id", *FP)).alias("lead"))
    rows = hot.join(lead.select("key", F.col("lead.id").alias("to"), *(F.col(f"lead.{x}").alias(f"lead_{x}") for x in FP)), "key")
    rows = scratch.save(rows.select("key", "id", *FP, "to", apart("lead_").alias("bits")))
    star = scratch.save(rows.filter((F.col("bits") <= APART) & (F.col("id") != F.col("to"))).select(F.col("id").alias("a"), F.col("to").alias("b")).distinct())
    label = connected_components(star, scratch).select("id", F.col("component").alias("label"))
    ring = F.floor(F.col("bits") / (APART + 1))
    rows = rows.join(label, "id", "left").select("key", "id", *FP, F.coalesce("label", "id").alias("label"), F.explode(F.array(ring, ring + 1)).alias("ring"))
    mixed = rows.groupBy("key", "ring").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key", "ring")
    return star, rows.join(mixed, ["key", "ring"]).select(F.xxhash64("key", "ring").alias("key"), "id", *FP)


def similar_groups(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(doc_id, rid, grp) of ``rows`` (doc_id, rid, FP) whose group of close signatures has another row."""
    named = rows.withColumn("id", F.xxhash64(*FP))
    sigs = scratch.save(named.groupBy("id").agg(*(F.min(x).alias(x) for x in FP)))
    keys = scratch.save(colliding(segment_variants(sigs)))
    payload = scratch.save(keys.join(sigs, "id").select("key", "id", *FP), drop=keys)

    def close(batch: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.zeros(len(i), np.int64)
        for x in FP:
            fp = batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).view(np.uint64)
            apart += np.bitwise_count(fp[i] ^ fp[j])
        return apart <= APART

    crowded = scratch.save(payload.groupBy("key").count().filter(F.col("count") > block).select("key"))
    star = None
    if not is_empty(crowded):
        star, finer = by_rings(payload.join(crowded, "key", "left_semi"), scratch)
        payload = scratch.save(payload.join(crowded, "key", "left_anti").unionByName(finer), drop=payload)
    links = scratch.save(bucket_links(payload, close, scratch, block=block), drop=payload)
    groups = connected_components(links if star is None else links.union(star), scratch).withColumnRenamed("id", "id_")
    placed = named.join(groups, F.col("id") == F.col("id_"), "left").select("doc_id", "rid", F.coalesce("component", "id").alias("grp"))
    placed = scratch.save(placed)
    many = placed.groupBy("grp").count().filter("count > 1").select("grp")
    return scratch.save(placed.join(many, "grp").select("doc_id", "rid", "grp"), drop=placed)


def gram_sets(docs: DataFrame, rids: DataFrame, size: int) -> DataFrame:
    """(rid, grams): the distinct ``size``-word shingles (fewer words: the whole sequence) of the texts with these hashes."""
    few = rids.limit(FEW + 1).count() <= FEW

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(1)):
                word, owner = words_of(t)
                gram, at = shingles(word, owner, size)
                edge, whole = np.searchsorted(owner[at], np.arange(len(t) + 1)), np.searchsorted(owner, np.arange(len(t) + 1))
                sets = []
                for k in range(len(t)):
                    own = np.unique(gram[edge[k] : edge[k + 1]])
                    if not len(own) and whole[k] < whole[k + 1]:
                        own = sequence_hashes(word, whole[k : k + 1], whole[k + 1 : k + 2])
                    if not len(own):
                        own = np.zeros(1, np.uint64)  # no words: like any other such text
                    sets.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(sets, pa.list_(pa.int64()))], ["rid", "grams"])

    own = docs.select(row_key(), "text").join(F.broadcast(rids) if few else rids, "rid", "left_semi")
    return own.mapInArrow(run, "rid long, grams array<long>").dropDuplicates(["rid"])


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, rid) of the rows of ``docs`` that are near copies of a row that stays.

    Candidates are groups of close signatures. In a group all pairs with an exact Jaccard similarity of
    ``similarity`` or more, over ``size``-word shingles, are found; of each class of texts so linked the row with the
    least (doc_id, rid) stays, null ids last, and the others go.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.save(signatures(docs))
    members = similar_groups(rows, scratch, block)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    texts = scratch.save(members.groupBy("grp", "rid").agg(F.min(order).alias("first")))
    several = texts.groupBy("grp").count().filter("count > 1").select("grp")
    near = scratch.save(texts.join(several, "grp").select(F.col("grp").alias("key"), F.col("rid").alias("id")))
    grams = scratch.save(gram_sets(docs, near.select(F.col("id").alias("rid")).distinct(), size).select(F.col("rid").alias("id"), F.size("grams").cast("long").alias("n"), "grams"))
    classes = verified_classes(near, grams, similarity, scratch)
    named = texts.join(classes, texts.rid == classes.id, "left").select("rid", "first", F.coalesce("component", "rid").alias("class"))
    stays = named.groupBy("class").agg(F.min("first").alias("stays"))
    named = scratch.save(named.join(stays, "class").select("rid", "stays"))
    return members.join(named, "rid").filter(~order.eqNullSafe(F.col("stays"))).select("doc_id", "rid").distinct()


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are no near copies of another row that stays (``near_copies``), with all their columns.

    Rows are told apart by doc_id, null or not, and text; of rows equal in both, the first by their other
    columns as JSON stays. Texts without words are copies of each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kept")
    own, key, mark = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("id", "rid", "key"))  # names that no column of docs has
    gone = scratch.save(near_copies(docs, similarity, size, block)).select(F.col("doc_id").alias(own), F.col("rid").alias(key))
    is_it = (F.col(mark) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    kept = docs.withColumn(mark, row_key()).join(gone, is_it, "left_anti")
    twice = scratch.save(docs.select(F.col("doc_id").cast("long").alias(own), row_key().alias(key)).groupBy(own, key).count().filter("count > 1").select(own, key))
    if is_empty(twice):
        return kept.select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy(mark, "doc_id").orderBy(F.to_json(F.struct(*(docs[c] for c in docs.columns if c != "text")))))
    one = kept.join(twice, is_it, "left_semi").withColumn(own, rank).filter(F.col(own) == 1)
    return kept.join(twice, is_it, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
