"""Vectorised word splitting and rolling word hashes over Arrow string batches.

A small helper for ``mapInArrow`` functions: it only cuts texts into words and
hashes words and word k-grams; joins and grouping are left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: blank and \t-\r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything that is no digit, ASCII letter (lower-cased first) or non-ASCII character.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, 1 << 20)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _tables[base] = (out[0], out[1])
    up, down = _tables[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data``; text d has words first[d]:first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(_BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _powers(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((hashes + np.uint64(salt)) * up[:-1], out=sums[1:])
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, mix((sums[at + k] - sums[at]) * down[at])

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and word number inside the text for word indices."""
        text = np.searchsorted(self.first, at, side="right") - 1
        return text, at - self.first[text]


def split_words(column: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    """Words of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0]) if len(offsets) else 0
    data = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    if size:
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < size)]
        starts[1:] &= ~inside[:-1]
        starts[cuts] = inside[cuts]
        ends[:-1] &= ~inside[1:]
        ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (one row at least), so memory stays bounded."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > at and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
