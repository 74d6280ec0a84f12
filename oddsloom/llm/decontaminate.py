"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

A passage is two neighbouring chunks of words, so any run of a chunk's length lies whole in one; items
are indexed by classes of length, each with chunks as long as its longest item. A test item's score is
the BM25 weight of its terms that occur in the passage, as a share of its own total weight. Postings are
in the order of the items and in blocks with a maximum weight each. Passages whose summed term maxima, or
whose summed maxima in every range of items, stay below the threshold are put aside many at once; the
others are run through block-max WAND: pointers into the postings of the passage's terms, a pivot where
the term maxima first reach the threshold, a look at the block maxima there, and skips past items and
blocks that cannot reach it. All items above the threshold are found. Question and answer of each are
then verified by the overlap of their word shingles.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .textops import WORD_BASE, Texts, keep_rows, mix, pieces

K1, B = 1.2, 0.75
BLOCK = 4
SHINGLE = 5
LEAST_CHUNK = 48
FIRST_CLASS, WIDER = 64, 4  # words of the items of the first class of lengths; how much further each next one goes
SLACK = 1e-9  # of sums of weights, which are added in different orders
INDEX_BYTES = 32 << 20  # text of the items that are indexed and broadcast at once
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and start of every run of letters and digits, A-Z in lower case."""
    low = Texts(t.first, LOWER[t.data], t.offsets)
    ws, we = low.runs(WORD[low.data])
    return low.hashes(ws, we), low.of(ws), ws


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        total += words[k : k + n] * np.uint64(pow(int(WORD_BASE), k, 1 << 64))
    return mix(total)


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's shingles (of five words, or all if fewer) that occur in the passage."""
    if not len(part):
        return 1.0
    size = min(SHINGLE, len(part))
    own = np.unique(_grams(part, size))
    return float(np.isin(own, _grams(passage, size)).mean())


def split_item(text: str, words: np.ndarray, starts: np.ndarray) -> int:
    """The number of question words: the answer is the last sentence or sentences with three words or more."""
    raw = [len(text[: m.end()].encode()) for m in SENTENCE.finditer(text)]
    for at in reversed(raw):
        cut = int(np.searchsorted(starts, at))
        if len(words) - cut >= 3:
            return cut if cut >= SHINGLE else len(words)
    return len(words)


@dataclass
class Index:
    items: np.ndarray  # ids
    words: list[np.ndarray]  # the words of each item
    question: np.ndarray  # how many of them are the question
    slots: np.ndarray  # hash table: slot -> term, or -1
    terms: np.ndarray  # term -> hash
    chunk: int  # words
    top: np.ndarray  # term -> greatest weight
    block_at: np.ndarray  # term -> its range in block_of, block_max
    block_of: np.ndarray
    block_max: np.ndarray
    post_at: np.ndarray  # entry of block_of -> its range in post_item, post_weight
    post_item: np.ndarray
    post_weight: np.ndarray
    made: dict[int, tuple] = field(default_factory=dict)

    def postings(self, term: int) -> tuple[list, list, list, list, float]:
        """Items, weights, blocks, block maxima and the maximum of a term, as lists; kept once made."""
        if term not in self.made:
            lo, hi = int(self.block_at[term]), int(self.block_at[term + 1])
            s, e = int(self.post_at[lo]), int(self.post_at[hi])
            self.made[term] = self.post_item[s:e].tolist(), self.post_weight[s:e].tolist(), self.block_of[lo:hi].tolist(), self.block_max[lo:hi].tolist(), float(self.top[term])
        return self.made[term]

    def look_up(self, word: np.ndarray) -> np.ndarray:
        """The term of each word hash, or -1."""
        out = np.full(len(word), -1, np.int64)
        at = (word >> np.uint64(44)).astype(np.int64) & (len(self.slots) - 1)
        todo = np.arange(len(word))
        while len(todo):
            term = self.slots[at[todo]]
            hit = term >= 0
            todo, term = todo[hit], term[hit]
            same = self.terms[term] == word[todo]
            out[todo[same]] = term[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out


@dataclass
class Totals:
    """What BM25 needs to know of all items, whatever block they are indexed in."""

    items: int  # with words
    mean: float  # words of an item
    longest: int
    terms: np.ndarray  # ascending hashes, those of the block at least
    df: np.ndarray


def build_index(ids: list[int], texts: list[str], totals: Totals | None = None, longest: int = 0) -> Index | None:
    """The index of some items, which are all there are unless ``totals`` says more; items without words are left out.

    ``longest``: words of the longest item, if that is not to come from the totals.
    """
    words, question, kept = [], [], []
    for item, text in zip(ids, texts, strict=True):
        for t in pieces(pa.array([text])):
            hashes, _, starts = tokens(t)
            if len(hashes):
                words.append(hashes)
                question.append(split_item(text, hashes, starts))
                kept.append(item)
    if not kept:
        return None
    size = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    terms, term = np.unique(np.concatenate(words), return_inverse=True)
    pair, tf = np.unique(term * len(words) + owner, return_counts=True)
    term, item = pair // len(words), pair % len(words)
    if totals is None:
        totals = Totals(len(words), size.mean(), int(size.max()), terms, np.bincount(term, minlength=len(terms)))
    df = totals.df[np.searchsorted(totals.terms, terms)]
    idf = np.log1p((totals.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / totals.mean))
    weight /= np.bincount(item, weights=weight)[item]
    # postings are in order of term and item; a block of a term: its items in one block of BLOCK
    block = term * (len(words) // BLOCK + 1) + item // BLOCK
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    n_slots = 1 << max(10, int(np.ceil(np.log2(len(terms) * 4))))
    slots = np.full(n_slots, -1, np.int64)
    for k, h in enumerate(terms):
        at = (int(h) >> 44) & (n_slots - 1)
        while slots[at] >= 0:
            at = (at + 1) & (n_slots - 1)
        slots[at] = k
    top = np.zeros(len(terms))
    np.maximum.at(top, term, weight)
    return Index(np.array(kept), words, np.array(question), slots, terms, max(LEAST_CHUNK, longest or totals.longest), top, np.searchsorted(term[heads], np.arange(len(terms) + 1)), (item // BLOCK)[heads], np.maximum.reduceat(weight, heads), np.append(heads, len(term)), item, weight)


def build_indexes(ids: list[int], texts: list[str], totals: Totals | None = None) -> list[Index]:
    """An index for each class of item lengths, with weights from the totals of all items."""
    count = [int(len(tokens(t)[0])) for text in texts for t in pieces(pa.array([text], pa.large_string()))]
    if totals is None:
        words = [np.unique(tokens(t)[0]) for text in texts for t in pieces(pa.array([text], pa.large_string()))]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_counts=True)
        known = [n for n in count if n]
        totals = Totals(len(known), float(np.mean(known)) if known else 0.0, max(known, default=0), terms, df)
    classes: dict[int, list[int]] = {}
    for k, n in enumerate(count):
        c = 0
        while n > FIRST_CLASS * WIDER**c:
            c += 1
        classes.setdefault(c, []).append(k)
    found = (build_index([ids[k] for k in own], [texts[k] for k in own], totals, max(count[k] for k in own)) for _, own in sorted(classes.items()))
    return [x for x in found if x is not None]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()), which


def wand(x: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item, score) of every item that scores ``threshold`` or more against a passage with these distinct terms."""
    lists = [x.postings(k) for k in terms.tolist()]
    end = len(x.items)
    at = [0] * len(lists)
    here = [own[0][0] if own[0] else end for own in lists]  # the item under each pointer
    out = []

    def advance(k: int, to: int) -> None:
        at[k] = bisect_left(lists[k][0], to, at[k])
        here[k] = lists[k][0][at[k]] if at[k] < len(lists[k][0]) else end

    while True:
        order = sorted((k for k in range(len(lists)) if here[k] < end), key=here.__getitem__)
        total, pivot = 0.0, -1
        for place, k in enumerate(order):
            total += lists[k][4]
            if total >= threshold - SLACK:
                pivot = place
                break
        if pivot < 0:
            return out
        item = here[order[pivot]]
        while pivot + 1 < len(order) and here[order[pivot + 1]] == item:
            pivot += 1
        block, bound = item // BLOCK, 0.0
        for k in order[: pivot + 1]:
            own = lists[k][2]
            b = bisect_left(own, block)
            if b < len(own) and own[b] == block:
                bound += lists[k][3][b]
        if bound < threshold - SLACK:  # no item up to the block's end, or to the next pointer, can reach it
            skip = (block + 1) * BLOCK
            if pivot + 1 < len(order):
                skip = min(skip, here[order[pivot + 1]])
            for k in order[: pivot + 1]:
                advance(k, skip)
        elif here[order[0]] == item:
            score = sum(lists[k][1][at[k]] for k in order[: pivot + 1])
            if score >= threshold:
                out.append((item, score))
            for k in order[: pivot + 1]:
                advance(k, item + 1)
        else:
            for k in order[: pivot + 1]:
                if here[k] < item:
                    advance(k, item)


def search(t: Texts, x: Index, threshold: float, question: float = 0.0, answer: float = 0.0) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of the items found in some texts; the best passage of each.

    Only passages whose two overlaps reach ``question`` and ``answer`` count, so a passage with a higher score
    that fails them hides no other.
    """
    word, owner, _ = tokens(t)
    first = np.searchsorted(owner, np.arange(len(t)))
    place = np.arange(len(word)) - first[owner]
    chunks = -(-np.bincount(owner, minlength=len(t)) // x.chunk)
    base = np.concatenate(([0], np.cumsum(chunks)))
    term = x.look_up(word)
    known = term >= 0
    chunk = base[owner[known]] + place[known] // x.chunk
    key = np.unique(chunk * len(x.terms) + term[known])
    chunk, term = key // len(x.terms), key % len(x.terms)
    n = int(base[-1])
    of = np.repeat(np.arange(len(t)), chunks)
    joined = np.append(of[1:] == of[:-1], False) if n else np.zeros(0, bool)

    def passages(by_chunk: np.ndarray) -> np.ndarray:
        """Sums over each chunk and its successor in the same text."""
        more = np.zeros_like(by_chunk)
        more[:-1] = by_chunk[1:]
        more[~joined] = 0
        return by_chunk + more

    open_ = passages(np.bincount(chunk, weights=x.top[term], minlength=n)) >= threshold - SLACK
    live = open_.copy()
    live[1:] |= open_[:-1] & joined[:-1]
    keep = live[chunk]
    chunk, term = chunk[keep], term[keep]
    blocks = len(x.items) // BLOCK + 1
    found: dict[tuple[int, int], tuple] = {}
    edge = np.searchsorted(chunk, np.arange(n + 1))
    step = max(2, 2_000_000 // blocks)
    for lo in range(0, n, step):  # passages lo .. hi - 1 need chunks lo .. hi
        hi = min(n, lo + step)
        a, b = edge[lo], edge[min(n, hi + 1)]
        at, which = _ranges(x.block_at[term[a:b]], x.block_at[term[a:b] + 1])
        cell = (chunk[a:b][which] - lo) * blocks + x.block_of[at]
        sums = np.bincount(cell, weights=x.block_max[at], minlength=(hi - lo + 1) * blocks).reshape(-1, blocks)
        bound = sums[: hi - lo].copy()
        link = np.flatnonzero(joined[lo:hi])
        bound[link] += sums[link + 1]
        for p in np.flatnonzero((bound >= threshold - SLACK).any(axis=1) & open_[lo:hi]):
            p = int(p) + lo
            own = np.unique(term[edge[p] : edge[p + 1 + joined[p]]])
            for item, score in wand(x, own, threshold):
                text = int(of[p])
                start = first[text] + (p - base[text]) * x.chunk
                passage = word[start : min(start + 2 * x.chunk, first[text + 1] if text + 1 < len(t) else len(word))]
                q = int(x.question[item])
                row = (text, item, score, overlap(x.words[item][:q], passage), overlap(x.words[item][q:], passage))
                if row[3] >= question and row[4] >= answer and row[2:] > found.get((text, item), (0, 0, -1.0))[2:]:
                    found[text, item] = row
    return list(found.values())


def _terms(items: DataFrame) -> DataFrame:
    """(term, head) of the distinct terms of every item; head: the item's number of words at its first term, else null."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(0)):
                word, owner, _ = tokens(t)
                if not len(word):
                    continue
                order = np.lexsort((word, owner))
                word, owner = word[order], owner[order]
                first = np.append(True, owner[1:] != owner[:-1])
                new = first | np.append(True, word[1:] != word[:-1])
                head = np.bincount(owner)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(word[new].view(np.int64)), pa.array(head[new], mask=~first[new])], ["term", "head"])

    return items.select("text").mapInArrow(run, "term long, head long")


def indexes(items: DataFrame) -> Iterator[tuple[list[Index], bool]]:
    """Indexes of all items (item_id, text) in blocks of at most about INDEX_BYTES of text; and if there is one block only.

    The weights come from all items, so they do not depend on the blocks. One block at a time is on the driver.
    """
    items = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // INDEX_BYTES))
    if blocks > 1:
        scratch = Scratch(items.sparkSession, "benchmark")
        items = scratch.save(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
        terms = scratch.save(_terms(items).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count("head").alias("n"), F.sum("head").alias("words"), F.max("head").alias("longest")))
        n, words, longest = terms.agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    for k in range(blocks):
        own, totals = items, None
        if blocks > 1:
            own = items.filter(F.col("block") == k)
            known = terms.join(_terms(own).select("term").distinct(), "term", "left_semi").select("term", "df").toArrow()
            hashes, df = (known.column(c).to_numpy() for c in ("term", "df"))
            order = np.argsort(hashes.view(np.uint64))
            totals = Totals(n, words / n, longest, hashes.view(np.uint64)[order], df[order]) if n else None
        rows = own.select("item_id", "text").orderBy("item_id", "text").collect()
        if found := build_indexes([r["item_id"] for r in rows], [r["text"] for r in rows], totals):
            yield found, blocks == 1


@dataclass
class Limits:
    score: float = 0.6
    question: float = 0.6
    answer: float = 0.6


def leaks_of(t: Texts, found: list[Index], limits: Limits) -> list[tuple]:
    """(text, item id, score, question overlap, answer overlap) of the items found in some texts."""
    return [(r[0], x.items[r[1]], *r[2:]) for x in found for r in search(t, x, limits.score, limits.question, limits.answer)]


def find_leaks(docs: DataFrame, items: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every test item found in a document.

    Null and empty texts contain nothing; items without words are never found, and one in which no answer
    is told apart is held to its whole text as the question. Repeated documents give repeated rows; items
    that repeat both id and text count once. A null item_id stays null. If the items exceed INDEX_BYTES they are indexed in
    blocks, each held against all documents and let go before the next. Other columns are not read.
    """
    limits = limits or Limits()
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    scratch = Scratch(spark, "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for x, lone in indexes(items):
        shared = spark.sparkContext.broadcast(x)

        def run(batches, shared=shared):
            for batch in batches:
                for t in pieces(batch.column(1)):
                    found = leaks_of(t, shared.value, limits)
                    if found:
                        ids = batch.column(0).slice(t.first, len(t)).take(pa.array([r[0] for r in found]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in found], pa.int64()), *(pa.array([r[k] for r in found]) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(run, schema)
        if not lone:
            found = scratch.save(found)
            shared.destroy()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` whose text contains no test item of ``items``, with all columns."""
    limits = limits or Limits()
    scratch = Scratch(docs.sparkSession, "leaks")
    gone = None
    for x, lone in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(x)

        def clean(t: Texts, shared=shared) -> np.ndarray:
            out = np.ones(len(t), bool)
            out[[r[0] for r in leaks_of(t, shared.value, limits)]] = False
            return out

        if lone:
            return keep_rows(docs, clean)
        # of several blocks each leaves the digests of the texts that go
        found = scratch.save(keep_rows(docs.select("text"), lambda t, clean=clean: ~clean(t)).select(F.sha2("text", 256).alias("digest")).distinct())
        shared.destroy()
        gone = found if gone is None else gone.union(found)
    if gone is None:
        return docs
    own = f"digest_{uuid.uuid4().hex[:8]}"  # a name that no column of docs has
    return docs.withColumn(own, F.sha2("text", 256)).join(gone.distinct().withColumnRenamed("digest", own), own, "left_anti").select(*docs.columns)
