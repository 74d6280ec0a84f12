"""Vectorised text kernels over Arrow string columns: numpy on the raw UTF-8 bytes, no per-word Python.

A column is walked in slices of bounded bytes (``pieces``), so memory does not depend on the batch
size that Spark happens to choose; one text always stays whole.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 19, 2048
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PRIMES = np.uint64(2147483647), np.uint64(2147483629)
BASES = 1350490027, 1904325301  # of the two exact polynomial hashes, modulo PRIMES
CARRY = 1 << 24  # bytes whose sum of terms stays below 2^63
_tables: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, modulus: int, n: int) -> np.ndarray:
    """base^i modulo ``modulus`` (2^64: by overflow) for i < n; tables up to four slices are kept."""
    row = _tables.get((base, modulus))
    if row is None or len(row) < n:
        size = max(n, SLICE_BYTES + 2)
        row = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, modulus))
            row[done : done + more] = row[:more] * step
            if modulus < 1 << 64:
                row[done : done + more] %= np.uint64(modulus)
            done += more
        if size <= 4 * SLICE_BYTES:
            _tables[base, modulus] = row
    return row[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    whole = 1 << 64
    return _table(int(BASE), whole, n), _table(pow(int(BASE), -1, whole), whole, n)


def _residue(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - x // p * p


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


@dataclass
class Texts:
    """Some texts, as bytes in one array; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text to which each byte position belongs."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True bytes that stay in one text."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before = np.concatenate(([False], inside[:-1]))
        before[cuts] = False
        after = np.concatenate((inside[1:], [False]))
        after[cuts - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``[^\\x20\\x09-\\x0D]+``."""
        return self.runs(~SPACES[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The \\n-split lines: text, start, end. A text has one more than it has newlines."""
        ends = np.flatnonzero(self.data == 10)
        at = self.of(ends)
        which = np.concatenate((at, np.arange(len(self))))
        stop = np.concatenate((ends, self.offsets[1:]))
        order = np.lexsort((stop, which))
        which, stop = which[order], stop[order]
        begin = np.empty_like(stop)
        begin[1:] = stop[:-1] + 1
        head = np.concatenate(([True], which[1:] != which[:-1])) if len(which) else np.zeros(0, bool)
        begin[head] = self.offsets[which[head]]
        return which, begin, stop

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the polynomial hashes of the bytes modulo PRIMES; differences count modulo the prime."""
        n, out = len(self.data), []
        byte = self.data.astype(np.uint64) + np.uint64(1)
        for base, p in zip(BASES, PRIMES, strict=True):
            sums = np.zeros(n + 1, np.uint64)
            for lo in range(0, n, CARRY):
                hi = min(n, lo + CARRY)
                np.cumsum(byte[lo:hi] * _table(base, int(p), n)[lo:hi], out=sums[lo + 1 : hi + 1])
                if lo:
                    sums[lo + 1 : hi + 1] += sums[lo] % p
            out.append(sums)
        return out[0], out[1]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """64-bit hashes of the byte ranges, equal for equal contents wherever they stand.

        Two polynomials modulo primes: unlike one modulo 2^64, they have no contents that always collide.
        """
        prefix = self.prefix() if prefix is None else prefix
        both = []
        for sums, base, p in zip(prefix, BASES, PRIMES, strict=True):
            down = _table(pow(base, -1, int(p)), int(p), len(self.data) + 1)
            range_ = _residue(_residue(sums[ends], p) + p - _residue(sums[starts], p), p)
            both.append(_residue(range_ * down[starts], p))
        return mix((both[0] << np.uint64(32)) | both[1])

    def rolling(self) -> np.ndarray:
        """Prefix sums of a polynomial modulo 2^64: cheap, for picking places, where a collision does no harm."""
        up, _ = powers(len(self.data) + 1)
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * up[:-1]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def rolled(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
        _, down = powers(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts])


@functools.cache
def _trim():
    """What hands free memory of the C heap back to the machine, where there is such a thing."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """Return what this worker no longer uses: it lives on for later stages, beside other workers of its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """Walk a string column (null: empty) in slices of at most ``limit`` bytes and ``rows`` texts; a longer text is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + rows)
        own = offsets[at : to + 1]
        yield Texts(at, data[own[0] : own[-1]], own - own[0])
        at = to
    give_back()


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive word hashes of one owner, and the index of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * np.uint64(pow(int(WORD_BASE), k, 1 << 64))
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[at]), at


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges of word hashes, equal for equal sequences wherever they stand."""
    both = []
    for base, p in zip(BASES, PRIMES, strict=True):
        up, down = _table(base, int(p), len(words) + 1), _table(pow(base, -1, int(p)), int(p), len(words) + 1)
        terms = _residue(_residue(words, p) * up[:-1], p)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        both.append(_residue(_residue(sums[ends] - sums[starts], p) * down[starts], p))
    return mix(((both[0] << np.uint64(32)) | both[1]) + (ends - starts).astype(np.uint64))


def crc32_of_ids(ids: pa.Array) -> np.ndarray:
    """crc32 of each id written as decimal text; -1 for a null id."""
    import zlib

    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) for x in ids.to_pylist()], np.int64)


def keep_rows(docs, keep):
    """The rows of ``docs`` whose text passes: ``keep(texts)`` gives a flag for each text of a slice. All columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            flags = [keep(t) for t in pieces(batch.column(at))]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return docs.mapInArrow(run, docs.schema)
