"""Words and hashes of many texts at once, in numpy over the bytes of an Arrow string column.

A block is a run of whole texts, of about one megabyte. All positions are byte positions in the
block; ``Block.points`` turns them into code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from textveil.llm.common import nulls_to_empty, pieces

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Longer ranges are hashed by xxhash: sums of powers of one odd base repeat themselves from some thousand bytes on.
_SUMMED_BYTES = 255


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i up to n at least."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, BLOCK_BYTES) + 1, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base]


class Block:
    """Whole texts of rows ``first`` to ``first + n`` of a batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes where ``inside`` holds, within a text: starts, ends, and the first run of each text."""
        before = np.empty(len(inside), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < len(inside)]] = False
        after = np.empty(len(inside), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = self.offsets[1:] - 1
        after[last[(last >= 0) & (self.offsets[1:] > self.offsets[:-1])]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than space and U+0009 to U+000D."""
        return self.spans(~SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges in order of their starts; ``lower`` folds A-Z. Sums run over a megabyte at a time, however long a text is."""
        size = ends - starts
        out = np.empty(len(starts), dtype=np.uint64)
        short = np.flatnonzero(size <= _SUMMED_BYTES)
        i = 0
        while i < len(short):
            base = starts[short[i]]
            j = i + int(np.searchsorted(starts[short[i:]], base + BLOCK_BYTES))
            own = short[i:j]
            begin, end = starts[own] - base, ends[own] - base
            data = self.data[base : base + int(end.max())]
            n = len(data)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[LOWER[data] if lower else data] * _power_table(_BASE, n)[:n], out=sums[1:])
            raw = (sums[end] - sums[begin]) * _power_table(pow(_BASE, -1, 1 << 64), n)[begin]
            out[own] = mix(raw ^ (size[own].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            i = j
        for i in np.flatnonzero(size > _SUMMED_BYTES).tolist():
            data = self.data[starts[i] : ends[i]]
            out[i] = xxhash.xxh3_64_intdigest((LOWER[data] if lower else data).tobytes())
        return out

    def points(self) -> np.ndarray:
        """Code points of the block that begin before each byte position: the buffer of a text column is below two gigabytes."""
        out = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow string column; a null is an empty text."""
    column = nulls_to_empty(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for a, b in pieces(np.diff(ends), most):
        yield Block(a, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each run, from the first run of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of k runs in sequence within a text: where they begin, and the hash."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        value = value * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(room >= k)
    return at, mix(value[at] ^ np.uint64(k))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are found twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's runs: integers, as differences of sums of fractions would depend on the texts before."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
