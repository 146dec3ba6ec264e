"""Words of many texts at once, as numpy arrays over their UTF-8 bytes: boundaries and 64-bit hashes.

A word is a run of `[^\\x20\\x09-\\x0D]` after lower-casing A-Z; as UTF-8 keeps ASCII bytes to themselves, bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weftline.llm.common import utf8

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20_240_117)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEGMENT = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * _SEGMENT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words of a string column: `start`, `stop` (bytes of `raw`), `hash`, and `first`, where each row's words begin (one more than rows)."""

    def __init__(self, column: pa.Array, hashes: bool = True):
        self.raw, self.offsets = utf8(column)
        n = len(self.raw)
        inside = np.empty(n + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(_SPACE[self.raw], out=inside[1:-1].view(np.bool_))
        edge = inside[1:] != inside[:-1]
        cuts = self.offsets[1:-1]  # a row's end is a word's end, whatever comes next
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        found = np.flatnonzero(edge)
        start, stop = found[0::2], found[1::2]
        if len(cuts):
            start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
        self.start, self.stop = start, stop
        self.first = np.searchsorted(start, self.offsets, side="left")
        if hashes:
            self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.stop, a + _SEGMENT, side="right")))
            b = self.stop[j - 1]
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_TABLE[self.raw[a:b]] * _powers(_P, b - a), out=sums[1:])
            left = self.start[i:j] - a
            out[i:j] = (sums[self.stop[i:j] - a] - sums[left]) * _powers(_INV, b - a)[left]
            i = j
        return mixed(out)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return LOWER[self.raw[self.start[i] : self.stop[i]]].tobytes()


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words row by row (a shorter row gives one run of all its words), and where each row's begin."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    h = words.hash
    total = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        total += mixed_by(h[k : len(h) - size + 1 + k], k) if len(total) else 0
    out = np.empty(first[-1], np.uint64)
    long = counts >= size
    if long.any():
        at = np.repeat(words.first[:-1][long], n[long]) + _ranges(n[long])
        out[np.repeat(long, n)] = total[at]
    for row in np.flatnonzero((counts > 0) & ~long):
        a, b = words.first[row], words.first[row + 1]
        out[first[row]] = sum(int(mixed_by(h[a + k : a + k + 1], k)[0]) for k in range(b - a)) + (0x5851F42D4C957F2D * int(size - (b - a))) & 0xFFFFFFFFFFFFFFFF
    return mixed(out), first


_BY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mixed_by(h: np.ndarray, k: int) -> np.ndarray:
    """Scramble that depends on the word's place in the run."""
    x = h * np.uint64(_BY[k % len(_BY)])
    return x ^ (x >> np.uint64(31))


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `most` bytes of column `text` each (a longer text stays whole), so working arrays stay small."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at, rows = 0, batch.num_rows
        while at < rows:
            stop = min(rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()
