"""Substring dedup by MinHash banding of paragraphs.

Passages are pasted in mid-line as well as between lines, so paragraphs are cut where the words
themselves say so: before a word pair whose hash is the least of ``RADIUS`` pairs to either side.
The same passage is then cut alike in every document, up to its ends. Paragraphs meet by band keys
(and equal ones by their content), five-word shingles are verified by exact Jaccard similarity, and
of each component of similar paragraphs one occurrence stays. A removed run of paragraphs then grows
word by word to both sides, along the text around the occurrence that stays, over single edited words
too where five equal words follow: up to the ends of the passage and over gaps between its paragraphs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import bucket_links
from .collide import colliding
from .components import connected_components
from .setjoin import jaccard, prefix_pairs, rare_parts
from .store import Scratch
from .textops import WORD_BASE, Texts, mix, pieces, sequence_hashes, shingles

RADIUS = 7
LEAST_WORDS = 8
SHINGLE = 5
REACH = 32  # words that a run grows by at most, on either side
KEYS = 5  # bands of a paragraph at most
FEW = 250_000  # row keys up to which they are broadcast, to move only the texts that are asked for
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNITS = "doc_id long, rid long, w int, s int, e int, n_words int, uid long"


def row_key() -> Column:
    """With the doc_id, what tells rows apart: equal rows are one."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid")


def tune_bands(similarity: float, recall: float, keys: int = KEYS) -> tuple[int, int]:
    """(rows per band, bands): the strictest banding that finds ``recall`` of pairs at ``similarity`` with at most ``keys`` keys."""
    for rows in (4, 3, 2):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands <= keys:
            return rows, bands
    return 1, int(np.ceil(np.log(1 - recall) / np.log(1 - similarity)))


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end of every word, A-Z in lower case."""
    low = Texts(t.first, LOWER[t.data], t.offsets)
    ws, we = low.words()
    return low.hashes(ws, we), low.of(ws), ws, we


def _cut(t: Texts) -> dict[str, np.ndarray]:
    """Paragraphs of some texts: text, first word, byte span, words, id; and the shingles with the paragraph of each."""
    word, owner, ws, we = _words(t)
    n = len(ws)
    empty = np.zeros(0, np.int64)
    if not n:
        return {"text": empty, "w": empty, "s": empty, "e": empty, "n": empty, "uid": empty, "shingle": np.zeros(0, np.uint64), "unit": empty}
    pair = mix(word + np.roll(word, 1) * WORD_BASE)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    pair[first] = top
    head = pair < top
    for k in range(1, RADIUS + 1):
        same = owner[k:] == owner[:-k]
        head[k:] &= ~same | (pair[k:] < pair[:-k])
        head[:-k] &= ~same | (pair[:-k] <= pair[k:])
    head |= first
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], n)
    uid = sequence_hashes(word, begin, end)
    long_ = end - begin >= LEAST_WORDS
    gram, at = shingles(word, owner, SHINGLE)
    unit = np.searchsorted(begin, at, "right") - 1
    inside = (at + SHINGLE <= end[unit]) & long_[unit]
    new = np.cumsum(long_) - 1
    text = owner[begin][long_]
    place = begin[long_] - np.searchsorted(owner, text)
    return {"text": text, "w": place, "s": ws[begin][long_] - t.offsets[text], "e": we[end - 1][long_] - t.offsets[text], "n": (end - begin)[long_], "uid": uid[long_].view(np.int64), "shingle": gram[inside], "unit": new[unit[inside]]}


def paragraphs(docs: DataFrame) -> DataFrame:
    """All paragraphs of ``LEAST_WORDS`` words or more; w is the first word's number, s and e are byte positions in the text."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(2)):
                c = _cut(t)
                own = batch.slice(t.first, len(t))
                ids = (own.column(k).take(pa.array(c["text"])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c[x].astype(np.int32)) for x in ("w", "s", "e", "n")), pa.array(c["uid"])], [x.split()[0] for x in UNITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text").mapInArrow(run, UNITS)


def band_keys(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(key, id) of every band of every paragraph."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(0)):
                c = _cut(t)
                if not len(c["uid"]):
                    continue
                starts = np.searchsorted(c["unit"], np.arange(len(c["uid"])))
                keys = []
                for b in range(bands):
                    key = np.full(len(c["uid"]), np.uint64(b + 1))
                    for r in range(rows):
                        salt = np.uint64(pow(0x9E3779B97F4A7C15, b * rows + r + 1, 1 << 64))
                        key = mix(key * WORD_BASE + np.minimum.reduceat(mix(c["shingle"] ^ salt), starts))
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(c["uid"], bands))], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def _asked(docs: DataFrame, requests: DataFrame, *what: str) -> DataFrame:
    """(doc_id, rid, text, asked) of the rows of ``docs`` for which there are ``requests`` (doc_id, rid, what); equal rows once."""
    lists = requests.groupBy("doc_id", "rid").agg(F.collect_list(F.struct(*what)).alias("asked")).withColumnsRenamed({"doc_id": "doc_id_", "rid": "rid_"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text")
    rids = requests.select("rid").distinct()
    if rids.limit(FEW + 1).count() <= FEW:
        own = own.join(F.broadcast(rids), "rid", "left_semi")
    return own.join(lists, (F.col("rid") == F.col("rid_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))).select("doc_id", "rid", "text", "asked")


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, grams) of the paragraphs ``wanted`` (id, doc_id, rid), out of their texts."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(0)):
                c = _cut(t)
                ask = batch.column(1).slice(t.first, len(t)).flatten().field(0).to_numpy()
                at = np.flatnonzero(np.isin(c["uid"], ask))
                _, once = np.unique(c["uid"][at], return_index=True)
                at = at[once]
                starts, ends = np.searchsorted(c["unit"], at), np.searchsorted(c["unit"], at, "right")
                grams = [np.unique(c["shingle"][s:e]).view(np.int64) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c["uid"][at]), pa.array(grams, pa.list_(pa.int64()))], ["id", "grams"])

    return _asked(docs, wanted, "id").select("text", "asked").mapInArrow(run, "id long, grams array<long>").dropDuplicates(["id"])


def around(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, rid, w, right, words, places) of the ``edges`` (doc_id, rid, w, right): up to REACH words from word w on, and how far each reaches.

    To the right, places are the ends of the words w, w + 1, ...; else the starts of the words w, w - 1, ...
    """
    out = "doc_id long, rid long, w int, right boolean, words array<long>, places array<int>"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(2)):
                word, owner, ws, we = _words(t)
                first = np.searchsorted(owner, np.arange(len(t) + 1))
                own = batch.slice(t.first, len(t))
                row, at, right, words, places = [], [], [], [], []
                for k, asked in enumerate(own.column(3).to_pylist()):
                    lo, hi, base = int(first[k]), int(first[k + 1]), t.offsets[k]
                    for x in asked:
                        w = lo + x["w"]
                        part = slice(w, min(hi, w + REACH)) if x["right"] else slice(max(lo, w + 1 - REACH), w + 1)
                        step = 1 if x["right"] else -1
                        row.append(k)
                        at.append(x["w"])
                        right.append(x["right"])
                        words.append(word[part][::step].view(np.int64))
                        places.append(((we if x["right"] else ws)[part][::step] - base).astype(np.int32))
                ids = (own.column(k).take(pa.array(row, pa.int64())) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(right, pa.bool_()), pa.array(words, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names)

    return _asked(docs, edges, "w", "right").mapInArrow(run, out).dropDuplicates(names[:4])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of ``a`` go along with ``b`` from their starts on; one word may be replaced, left out or put in before SHINGLE equal ones."""
    i = j = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        same = int(differ[0]) if len(differ) else n
        i, j = i + same, j + same
        if same == n:
            return i
        for x, y in ((1, 1), (1, 0), (0, 1)):
            nearer = a[i + x : i + x + SHINGLE], b[j + y : j + y + SHINGLE]
            if len(nearer[0]) == len(nearer[1]) == SHINGLE and (nearer[0] == nearer[1]).all():
                i, j = i + x, j + y
                break
        else:
            return i


def grown(docs: DataFrame, out: DataFrame, scratch: Scratch) -> DataFrame:
    """``out`` (the paragraphs with the place k of the one that stays) with removed runs grown to both sides."""
    in_row = Window.partitionBy("doc_id", "rid").orderBy("w")
    gone = out.filter("removed").withColumns({"before": F.lag(F.col("w") + F.col("n_words")).over(in_row), "after": F.lead("w").over(in_row)})
    end, k_end = F.col("w") + F.col("n_words"), F.col("k.w") + F.col("k.n_words")
    left = gone.filter((F.col("w") > 0) & (F.coalesce("before", F.lit(-1)) != F.col("w"))).select("doc_id", "rid", F.col("w").alias("unit"), (F.col("w") - 1).alias("w"), F.lit(False).alias("right"), F.col("k.doc_id").alias("k_doc"), F.col("k.rid").alias("k_rid"), (F.col("k.w") - 1).alias("k_w"))
    right = gone.filter(F.coalesce("after", F.lit(-1)) != end).select("doc_id", "rid", F.col("w").alias("unit"), end.alias("w"), F.lit(True).alias("right"), F.col("k.doc_id").alias("k_doc"), F.col("k.rid").alias("k_rid"), k_end.alias("k_w"))
    edges = scratch.save(left.union(right).filter("k_w >= 0"))
    sides = edges.select("doc_id", "rid", "w", "right").union(edges.select("k_doc", "k_rid", "k_w", "right")).distinct()
    views = scratch.save(around(docs, sides))
    theirs = views.select(F.col("doc_id").alias("v_doc"), F.col("rid").alias("k_rid"), F.col("w").alias("k_w"), "right", F.col("words").alias("other"))
    mine = views.select(F.col("doc_id").alias("o_doc"), "rid", "w", "right", "words", "places")
    both = edges.join(mine, (edges.rid == mine.rid) & (edges.w == mine.w) & (edges.right == mine.right) & edges.doc_id.eqNullSafe(mine.o_doc)).select(edges["*"], "words", "places")
    both = both.join(theirs, (both.k_rid == theirs.k_rid) & (both.k_w == theirs.k_w) & (both.right == theirs.right) & both.k_doc.eqNullSafe(theirs.v_doc)).select("doc_id", "rid", "unit", both.right, "words", "places", "other")

    def run(batches):
        for batch in batches:
            words, other, places = (batch.column(batch.schema.get_field_index(k)) for k in ("words", "other", "places"))
            n = [common_words(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(words, other, strict=True)]
            to = [p[k - 1].as_py() if k else None for k, p in zip(n, places, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(to, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "rid", "unit", "right", "to", "more"])

    more = both.mapInArrow(run, "doc_id long, rid long, unit int, right boolean, to int, more int").filter("more > 0")
    wide = more.groupBy(F.col("doc_id").alias("doc_id_"), F.col("rid").alias("rid_"), "unit").agg(F.max(F.when(~F.col("right"), F.col("to"))).alias("to_s"), F.max(F.when(F.col("right"), F.col("to"))).alias("to_e"), F.sum("more").cast("int").alias("more"))
    joined = out.join(scratch.save(wide), (F.col("rid") == F.col("rid_")) & (F.col("w") == F.col("unit")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left")
    return joined.select("doc_id", "rid", F.coalesce("to_s", "s").alias("s"), F.coalesce("to_e", "e").alias("e"), (F.col("n_words") + F.coalesce("more", F.lit(0))).alias("n_words"), "cluster_id", "removed")


def paragraph_clusters(docs: DataFrame, similarity: float, recall: float, scratch: Scratch) -> DataFrame:
    """The paragraphs that occur twice or more, with their cluster and the place k of the occurrence that stays."""
    rows, bands = tune_bands(similarity, recall)
    near = scratch.save(colliding(band_keys(docs, rows, bands)))
    units = scratch.save(paragraphs(docs))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "w", "n_words")
    classes = units.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    ids = near.select("id").distinct()
    repeated = scratch.save(classes.join(ids.withColumnRenamed("id", "uid").withColumn("near", F.lit(True)), "uid", "left").filter((F.col("n") > 1) | F.col("near")))

    wanted = repeated.filter("near").select(F.col("uid").alias("id"), "first.doc_id", "first.rid")
    grams = _shingles_of(docs, wanted)
    keys = scratch.save(near.join(grams, "id").select("key", "id", "grams"), drop=near)
    links = scratch.save(bucket_links(keys, lambda rows, i, j: jaccard(rows, i, j) >= similarity, scratch, propose=lambda rows, heads: prefix_pairs(rows, heads, similarity), split=lambda hot: rare_parts(hot, similarity)), drop=keys)
    groups = connected_components(links, scratch)

    named = repeated.join(groups, repeated.uid == groups.id, "left").select("uid", "n", "first", F.coalesce("component", "uid").alias("cluster_id"))
    whole = named.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.min("first").alias("k")).filter("n > 1")
    by_uid = scratch.save(named.select("uid", "cluster_id").join(whole.select("cluster_id", "k"), "cluster_id"))
    stays = place.eqNullSafe(F.col("k"))
    return scratch.save(units.join(by_uid, "uid").select("doc_id", "rid", "w", "s", "e", "n_words", "uid", "cluster_id", (~stays).alias("removed"), "k"), drop=units)


def repeated_paragraphs(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, rid, s, e (byte span), n_words, cluster_id and removed, for each paragraph that occurs twice or more.

    Paragraphs count as one if linked by a Jaccard similarity of ``similarity`` or more; the occurrence
    with the least (doc_id, rid, s) of each cluster stays (null ids come last), the others are removed, also
    within a document; spans of removed runs are grown as said above and may overlap. Words are compared in
    lower case (A-Z) and white space counts as one separator. Null and empty texts have no paragraphs;
    shorter paragraphs than ``LEAST_WORDS`` words never count. Rows are told apart by doc_id, null ones too,
    and rid, a hash of the text: rows that are equal in both are one, and lose the same spans. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    return grown(docs, paragraph_clusters(docs, similarity, recall, scratch), scratch)


def cut_spans(text: str | None, spans: list | None) -> str | None:
    """``text`` without the byte spans (s, e), which begin and end with words; white space at a cut stays as it stood."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for s, e in sorted(tuple(x) for x in spans):
        out.append(raw[at : max(at, s)])
        at = max(at, e)
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of the text; n_chars, if there, follows the text.

    Documents of which nothing but white space stays are dropped; those that were empty before stay.
    """
    names = docs.columns
    own, key, mark, cut = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("id", "rid", "key", "spans"))  # names that no column of docs has
    gone = repeated_paragraphs(docs, similarity, recall).filter("removed").groupBy(F.col("doc_id").alias(own), F.col("rid").alias(key)).agg(F.collect_set(F.struct("s", "e")).alias(cut))
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches):
        for batch in batches:
            spans = batch.column(len(names))
            hit = [k for k in range(batch.num_rows) if spans[k].is_valid]
            columns = list(batch.columns[: len(names)])
            if hit:
                texts = columns[at].to_pylist()
                size = columns[chars].to_pylist() if chars is not None else []
                keep = np.ones(batch.num_rows, bool)
                for k in hit:
                    texts[k] = cut_spans(texts[k], [(x["s"], x["e"]) for x in spans[k].as_py()])
                    keep[k] = bool(texts[k] and texts[k].encode().split())
                    if size:
                        size[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if size:
                    columns[chars] = pa.array(size, columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    marked = docs.withColumn(mark, row_key())
    return marked.join(gone, (F.col(mark) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").select(*names, cut).mapInArrow(run, schema)
