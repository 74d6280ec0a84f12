"""Hashed text features for the trained models: byte trigrams and letter words, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Texts, mix

TRIGRAM_BITS = 12
WORD_BITS = 20
HEADS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are features too
MANY = 10_000  # values of a sample's grouping column up to which its shares are broadcast
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS_ONLY = np.where(LETTERS, LOWER, 32).astype(np.uint8)


def trigrams(t: Texts, table: np.ndarray = LOWER, bits: int = TRIGRAM_BITS) -> np.ndarray:
    """Counts of hashed byte trigrams, one row per text; trigrams of blanks alone are left out."""
    n = len(t)
    if len(t.data) < 3:
        return np.zeros((n, 1 << bits), np.float32)
    b = table[t.data].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(t.offsets))
    keep = (owner[:-2] == owner[2:]) & (code != 0x202020)
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    cell = (owner[:-2] << bits) + slot
    return np.bincount(cell[keep], minlength=n << bits).astype(np.float32).reshape(n, 1 << bits)


def word_slots(t: Texts, bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every distinct hashed letter word and word beginning of HEADS bytes of each text, in order."""
    low = Texts(t.first, LOWER[t.data], t.offsets)
    ws, we = low.runs(LETTERS[low.data])
    prefix, owner = low.prefix(), low.of(ws)
    word = low.hashes(ws, we, prefix)
    _, once = np.unique(word ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)  # each word of a text once
    ws, we, owner = ws[once], we[once], owner[once]
    keys = [(word[once] >> np.uint64(64 - bits)).astype(np.int64) | (owner << bits)]
    for n in HEADS:
        k = np.flatnonzero(we - ws > n)
        head = mix(low.hashes(ws[k], ws[k] + n, prefix) + np.uint64(n))
        keys.append((head >> np.uint64(64 - bits)).astype(np.int64) | (owner[k] << bits))
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


def no_letters(t: Texts) -> np.ndarray:
    """Texts without any letter of any script."""
    plain = LETTERS.copy()
    plain[128:] = False
    none = t.per_text(plain[t.data]) == 0
    for k in np.flatnonzero(none & (np.diff(t.offsets) > 0)):
        text = t.data[t.offsets[k] : t.offsets[k + 1]].tobytes().decode("utf-8", "replace")
        none[k] = not any(c.isalpha() for c in text)
    return none


def bounded_sample(rows: DataFrame, keys: list[str], cap: int, by: str | None = None) -> DataFrame:
    """About ``cap`` rows (of each value of ``by``), chosen by the hash of ``keys``; all of them if there are no more."""
    part = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1_000_000))
    if by is None:
        n = rows.count()
        return rows if n <= cap else rows.filter(part < int(1_000_000 * cap / n))
    share = rows.groupBy(by).count().select(by, (F.lit(1_000_000.0) * cap / F.col("count")).alias("share_"))
    few = share.limit(MANY + 1).collect()
    if len(few) <= MANY:  # a row for each value: counted, so broadcast
        share = F.broadcast(rows.sparkSession.createDataFrame(few, share.schema))
    return rows.join(share, by).filter(part < F.col("share_")).drop("share_")


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def sparse_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A dense matrix as list columns of slots and values."""
    r, c = np.nonzero(counts)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(counts))))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts[r, c].astype(np.float32)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Full-batch Adam over one flat parameter vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
