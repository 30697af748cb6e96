"""Vectorised word, line and shingle views over Arrow string columns.

A column is walked in blocks of whole texts. Inside a block every step is a numpy
pass over the UTF-8 bytes, so a Python worker never loops over words. Words are
maximal runs of bytes outside [\\x20\\x09-\\x0D].
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 20
#: Words longer than this are hashed by digest, so no table grows with the text.
LONG_SPAN = 1 << 22

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _tables.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _tables[key] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Block:
    """Whole texts: rows lo..hi of a column, their bytes, and word spans."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.rows = hi - lo

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a per-byte array."""
        out = np.zeros(self.rows, np.int64)
        full = np.flatnonzero(np.diff(self.offsets))
        if len(full):
            out[full] = np.add.reduceat(flags, self.offsets[:-1][full], dtype=np.int64)
        return out

    def find_words(self) -> None:
        """Sets ink, starts, ends, word_bounds (per text, into starts) and word_row."""
        self.ink = ink = ~SPACE[self.data]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        tails = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        first[heads] = ink[heads]
        last[tails] = ink[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_bounds = np.searchsorted(self.starts, self.offsets)
        self.word_row = np.repeat(np.arange(self.rows), np.diff(self.word_bounds))

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of n words within one text."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(count, np.uint64)
        for k in range(n):
            total += hashes[k : k + count] * np.uint64((_ODD * (2 * k + 1) ^ (k << 40)) & (2**64 - 1) | 1)
        inside = np.flatnonzero(self.word_row[:count] == self.word_row[n - 1 :])
        return mix(total[inside]), inside


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending spans that don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > LONG_SPAN:
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > LONG_SPAN)
        j = i + int(long[0]) if len(long) else j
        a, b = starts[i], ends[j - 1]
        value = data[a:b].astype(np.uint64)
        value += np.uint64(1)
        value *= _powers(_ODD, b - a)
        upto = np.empty(b - a + 1, np.uint64)
        upto[0] = 0
        np.cumsum(value, out=upto[1:])
        found = upto[ends[i:j] - a] - upto[starts[i:j] - a]
        found *= _powers(_INVERSE, b - a)[starts[i:j] - a]
        out[i:j] = found
        i = j
    return mix(out)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts in runs of about limit bytes; a longer text is a block of its own."""
    data, offsets = strings(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def duplicated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
