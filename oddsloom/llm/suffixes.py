"""Exact substring dedup with suffix arrays built by linear grouping.

Every 200-byte window picks the least-hashed ``GRAM``-byte string in it as its anchor, so equal windows
pick equal anchors. An anchor with the windows that picked it is a context; its bytes hold them all.
Contexts that occur twice are repeated whole. Where an anchor has several different contexts, these
are brought together, cut into 8-byte cells counted from the anchor, and their suffix array over the
cells tells which windows occur in another context too. A crowd of contexts is first parted by the bytes
around the anchor: of the 152 bytes that a window has besides it, two contexts that share the window share
STEP * i or more to the left and 152 - STEP * (i + 1) or more to the right for some i, so they meet under
the bytes of that i, and a phrase with many surroundings brings nobody together.

The suffix array is built by grouping: suffixes are grouped by their Lyndon prefixes, in descending
order of the groups, with previous-smaller pointers; the order within the groups then follows from
the groups alone, without renaming and recursion.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, is_empty, partitions
from .textops import Texts, mix, pieces

WINDOW = 200
GRAM = 48
PLACE_BITS = 40
CELL = 8
CELLS = WINDOW // CELL - 1  # whole cells inside any window that is cut by the cell grid
BATCH_CELLS = 200_000
BLOCK = 4096  # contexts that are compared at once; an anchor with more is a crowd
STEP = (WINDOW - GRAM) // 8
CONTEXT = "h long, ctx long, rid long, s int, e int, a int"


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is its only least one."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    symbols = sorted(by_symbol)
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members = [by_symbol[c] for c in symbols]
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))  # the next group down and up
    upper = list(range(1, len(members))) + [-1]
    left = list(range(-1, n - 1))  # neighbours among the suffixes of groups not yet reached
    right = list(range(1, n + 1))
    smaller = [-1] * n
    current = len(members) - 1
    while current >= 0:
        own = members[current]
        if size[current] != len(own):
            own = [i for i in own if group[i] == current]
        if len(own) > 1:
            own.sort()
        raised: dict[tuple[int, int], list[int]] = {}  # (group, times) -> suffixes whose prefix grows by this group so often
        last, times = -1, 0
        for i in own:
            p, r = left[i], right[i]
            smaller[i] = p
            if p >= 0:
                right[p] = r
            if r < n:
                left[r] = p
            if p == last:
                times += 1
            else:
                if last >= 0:
                    raised.setdefault((group[last], times), []).append(last)
                last, times = p, 1
        if last >= 0:
            raised.setdefault((group[last], times), []).append(last)
        for g, times in sorted(raised, reverse=True) if len(raised) > 1 else raised:
            moved = raised[g, times]
            if len(moved) == size[g]:
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[g] -= len(moved)
            above = upper[g]
            lower.append(g)
            upper.append(above)
            upper[g] = new
            if above >= 0:
                lower[above] = new
            for j in moved:
                group[j] = new
        members[current] = own
        current = lower[current]
    # groups in ascending order give the first place of each
    g = 0
    while lower[g] >= 0:
        g = lower[g]
    start, at = [0] * len(members), 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = upper[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def anchors(t: Texts) -> dict[str, np.ndarray]:
    """The contexts of some texts: anchor hash, content hash, text, first and last window start, anchor position."""
    n = len(t.data)
    none = {k: np.zeros(0, np.int64) for k in ("h", "ctx", "text", "s", "e", "a")}
    width = WINDOW - GRAM + 1
    if n < WINDOW:
        return none
    sums = t.rolling()
    at = np.arange(n - GRAM + 1)
    gram = t.rolled(at, at + GRAM, sums)
    # the leftmost least of ``width`` grams (by 24 hash bits), from prefix and suffix minima of blocks
    m = len(gram)
    key = ((gram >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    padded = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:m]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    least = np.minimum(behind[: n - WINDOW + 1], ahead[width - 1 :])
    owner = np.repeat(np.arange(len(t)), np.diff(t.offsets))
    start = np.flatnonzero(owner[: len(least)] == owner[WINDOW - 1 :])  # windows inside one text
    if not len(start):
        return none
    anchor = (least[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(head)
    s, e, a = start[heads], start[np.append(heads[1:], len(start)) - 1], anchor[heads]
    text = owner[s]
    base = t.offsets[text]
    raw, digest = t.data.tobytes(), xxhash.xxh64_intdigest
    content = mix(np.array([digest(raw[i:j]) for i, j in zip(s.tolist(), (e + WINDOW).tolist(), strict=True)], np.uint64) + (a - s).astype(np.uint64))
    return {"h": gram[a].view(np.int64), "ctx": content.view(np.int64), "text": text, "s": s - base, "e": e - base, "a": a - base}


def _row_id():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def contexts(docs: DataFrame) -> DataFrame:
    """All contexts: anchor hash, content hash, row, first and last window start and the anchor's position."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(1)):
                c = anchors(t)
                rid = batch.column(0).slice(t.first, len(t)).take(pa.array(c["text"]))
                yield pa.RecordBatch.from_arrays([pa.array(c["h"]), pa.array(c["ctx"]), rid, *(pa.array(c[k].astype(np.int32)) for k in ("s", "e", "a"))], ["h", "ctx", "rid", "s", "e", "a"])

    return docs.select(_row_id().alias("rid"), "text").mapInArrow(run, CONTEXT)


def repeated_windows(bodies: list[bytes], anchor: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Flags over the joined ``bodies``: the window of WINDOW bytes that starts here also starts elsewhere in its ``group``."""
    size = np.array([len(b) for b in bodies])
    base = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(bodies) + bytes(2 * WINDOW), np.uint8)
    phase = anchor % CELL
    count = (size - phase) // CELL
    # cell values, then their ranks; 1 ends a body and 0 the text
    body = np.repeat(np.arange(len(bodies)), count)
    index = np.arange(len(body)) - np.repeat(np.cumsum(count) - count, count)
    place = base[body] + phase[body] + CELL * index
    value = np.zeros(len(place), np.uint64)
    for k in range(CELL):
        value = (value << np.uint64(8)) | data[place + k].astype(np.uint64)
    _, rank = np.unique(value, return_inverse=True)
    _, rank = np.unique(rank * (int(group.max(initial=0)) + 1) + group[body], return_inverse=True)  # groups have no cell in common
    slot = np.arange(len(body)) + body  # one more for each body's end
    text = np.ones(len(body) + len(bodies) + 1, np.int64)
    text[slot] = rank + 2
    text[-1] = 0
    order = np.array(suffix_array(text.tolist()), np.int64)
    cell_of = np.full(len(text), -1, np.int64)
    cell_of[slot] = np.arange(len(body))
    order = cell_of[order]
    order = order[order >= 0]
    order = order[index[order] + CELLS <= count[body[order]]]
    flags = np.zeros(len(data), bool)
    if len(order) < 2:
        return flags[: base[-1]]
    # neighbours in the suffix array that agree in all whole cells of a window form a run
    same = np.ones(len(order) - 1, bool)
    for k in range(CELLS):
        left = np.flatnonzero(same)
        same[left] = rank[order[left] + k] == rank[order[left + 1] + k]
    run = np.concatenate(([0], np.cumsum(~same)))
    lone = np.bincount(run)[run] < 2
    order, run = order[~lone], run[~lone]
    where, own = place[order], body[order]
    for r in range(CELL):  # the window starts r bytes before its first whole cell
        j = where - r
        ok = np.flatnonzero((j >= base[own]) & (j + WINDOW <= base[own + 1]))
        rest = np.zeros(len(ok), np.uint64)
        for k in range(CELL):
            off = k if k < r else CELL * CELLS + k
            rest = (rest << np.uint64(8)) | data[j[ok] + off].astype(np.uint64)
        sort = np.lexsort((rest, run[ok]))
        eq = (run[ok][sort][1:] == run[ok][sort][:-1]) & (rest[sort][1:] == rest[sort][:-1])
        twice = np.zeros(len(ok), bool)
        twice[sort[1:][eq]] = True
        twice[sort[:-1][eq]] = True
        flags[j[ok][twice]] = True
    return flags[: base[-1]]


def _mixed_spans(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, s, t) byte spans repeated between different contexts of an anchor; ``distinct`` (h, ctx, n, rid, s, e, a)."""
    spark = docs.sparkSession
    many = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    wanted = scratch.save(distinct.join(many, "h").select("h", "ctx", "n", "m", "rid", "s", "e", "a"), drop=distinct)
    scratch.free()
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "ctx", "n", "m", "s", "e", "a")).alias("asked"))
    texts = docs.select(_row_id().alias("rid"), "text")  # equal rows give equal bodies, which count once below
    block = BLOCK

    def parts(x: dict, raw: bytes) -> list[int | None]:
        """The keys of a context: its anchor's alone, or in a crowd one for each part of the bytes around it."""
        if x["m"] <= block:
            return [None]
        lo, at, hi = x["s"], x["a"], x["e"] + WINDOW
        cuts = [(at - left, at + WINDOW - STEP - left) for left in range(0, WINDOW - GRAM, STEP)]
        return [xxhash.xxh64_intdigest(raw[i:j], k) - (1 << 63) for k, (i, j) in enumerate(cuts) if lo <= i and j <= hi]

    def bodies(batches):
        for batch in batches:
            asked, texts = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for k in range(batch.num_rows):
                raw = texts[k].as_py().encode()
                rid = batch.column(2)[k].as_py()
                for x in asked[k].as_py():
                    body = raw[x["s"] : x["e"] + WINDOW]
                    out += [(x["h"], x["ctx"], x["n"], sub, rid, x["s"], x["a"] - x["s"], body) for sub in parts(x, raw)]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "ctx", "n", "sub", "rid", "s", "a", "body"])

    found = scratch.save(lists.join(texts, "rid").select("asked", "text", "rid").mapInArrow(bodies, "h long, ctx long, n long, sub long, rid long, s int, a int, body binary"), drop=wanted)
    rest = ["n", "rid", "s", "a", "body", "ctx"]
    dealt = found.filter("sub IS NULL").select("h", F.lit(0).alias("lo"), F.lit(0).alias("hi"), *rest)
    crowd = found.filter("sub IS NOT NULL").withColumn("h", F.xxhash64("h", "sub"))
    if not is_empty(crowd):
        # parts with one context have nothing to compare; one that is a crowd even so is dealt out as pairs of blocks
        sizes = scratch.save(crowd.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("ctx"), blocks).cast("int")
        crowd = crowd.join(sizes, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.unionByName(crowd.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *rest))
    keys = ["h", "lo", "hi"]
    dealt = dealt.repartition(max(2, partitions(spark)), *keys).sortWithinPartitions(*keys, "ctx")

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[5] for r in rows]))
        out, at = [], 0
        for n, rid, s, _, body, _ in rows:
            hit = np.flatnonzero(flags[at : at + len(body)]) if n == 1 else []
            at += len(body)
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)], strict=True):
                    out.append((rid, s + int(a), s + int(b) + WINDOW))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["rid", "s", "t"])

    def run(batches):
        rows: list[tuple] = []
        last, seen, cells, group = None, None, 0, 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(9)]
            for h, lo, hi, n, rid, s, a, body, ctx in zip(*cols, strict=True):
                if (h, lo, hi) != last:
                    if cells > BATCH_CELLS:
                        yield spans(rows)
                        rows, cells, group = [], 0, 0
                    last, seen, group = (h, lo, hi), None, group + 1
                if ctx == seen:
                    continue
                seen = ctx
                rows.append((n, rid, s, a, body, group))
                cells += len(body) // CELL
        if rows:
            yield spans(rows)

    return dealt.mapInArrow(run, "rid long, s int, t int")


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, the bytes removed, and the maximal removed runs."""
    kept, at, runs, stop = [], 0, 0, -1
    for s, e in sorted(spans):
        if s > stop:
            runs += 1
            kept.append(raw[at:s])
        stop = at = max(stop, e)
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw) - len(out), runs


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A byte is removed if a 200-byte string that also starts anywhere else, in the same or another row,
    covers it. Null texts are empty; shorter texts lose nothing. Repeated rows count as other rows.
    Rows are told apart by doc_id and text, so repeated or null doc_ids do no harm. An empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = docs.select("doc_id", "text")
    all_ = scratch.save(contexts(docs))
    distinct = scratch.save(all_.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "s", "e", "a")).alias("x")).select("h", "ctx", "n", "x.*"))
    twice = distinct.filter("n > 1").select("h", "ctx")
    whole = all_.join(twice, ["h", "ctx"]).select("rid", "s", (F.col("e") + WINDOW).alias("t"))
    scratch.free()
    whole = scratch.save(whole, drop=all_)
    scratch.free()
    mixed = scratch.save(_mixed_spans(docs, distinct, scratch))
    scratch.free()
    spans = scratch.save(whole.unionByName(mixed).groupBy("rid").agg(F.collect_set(F.struct("s", "t")).alias("spans")), drop=whole)

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                kept, gone, runs = remove_spans(raw, [(x["s"], x["t"]) for x in spans.as_py() or ()])
                rows.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.withColumn("rid", _row_id()).join(spans, "rid", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
