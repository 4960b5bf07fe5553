"""Byte kernels over Arrow string batches: words, hashes and n-grams without Python strings.

A rolling polynomial over the UTF-8 bytes, modulo 2^64, gives the hash of any byte range from two
entries of a prefix sum, so words, word n-grams and byte n-grams all cost a few vector operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one kernel call works on; a longer text makes a call of its own.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 8)
        inverse = pow(_P, -1, 1 << 64)
        both = []
        for base in (_P, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        if size > 2 * SLICE_BYTES:
            return both[0], both[1]
        _POWERS = both[0], both[1]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some texts as bytes: data, and offsets of which text i has offsets[i]:offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end (exclusive) of every word `[^\\x20\\x09-\\x0D]+`, and the text it is in."""
        data, offsets = self.data, self.offsets
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sums is None:
            power, inverse = _powers(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
            self._sums = total, inverse
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        total, inverse = self.sums()
        return mix((total[ends] - total[starts]) * inverse[starts])


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cuts a string column into runs of rows lo:hi of at most `most` bytes, whole texts each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def trimming(batches: Iterator) -> Iterator:
    """The batches; after each, memory that is free goes back to the system, as idle workers live on between stages."""
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        trim = None
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def ngrams(words: Texts, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each text of `words`, lo <= n <= hi: the bucket and the text of each."""
    size = np.diff(words.offsets)
    found, owner = [], []
    for n in range(lo, hi + 1):
        many = np.maximum(size - n + 1, 0)
        who = np.repeat(np.arange(len(size)), many)
        first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + words.offsets[:-1][who]
        found.append((words.hashes(first, first + n) >> np.uint64(20)) % np.uint64(buckets))
        owner.append(who)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def character_ngrams(words: Texts, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text's characters (code points), lo <= n <= hi: the bucket and the text of each."""
    begin = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    first = np.searchsorted(begin, words.offsets)
    size = np.diff(first)
    found, owner = [], []
    for n in range(lo, hi + 1):
        many = np.maximum(size - n + 1, 0)
        who = np.repeat(np.arange(len(size)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[:-1][who]
        found.append((words.hashes(begin[at], begin[at + n]) >> np.uint64(20)) % np.uint64(buckets))
        owner.append(who)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def bracketed(t: Texts, starts: np.ndarray, ends: np.ndarray) -> Texts:
    """The byte ranges as texts of their own, each between `<` and `>`."""
    size = ends - starts + 2
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = np.full(offsets[-1], ord("<"), np.uint8)
    inner = size - 2
    at = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    data[np.repeat(offsets[:-1] + 1, inner) + at] = t.data[np.repeat(starts, inner) + at]
    data[offsets[1:] - 1] = ord(">")
    return Texts(data, offsets)
