"""Words and hashes of whole texts, column-wise: numpy on the bytes of an Arrow column, no loop over rows or words.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 bytes of other characters never equal one of these six, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD1B54A32D192ED03)  # of a second, independent hash
CHUNK = 2 << 20  # bytes of text looked at together; one longer text is a chunk of its own


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes in all."""
    _, offsets = bytes_of(batch.column(name))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: byte ranges, and the range of words of each text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = bytes_of(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~SPACE[self.data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1]
        before[first[first < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:]
        after[last[last > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, base: np.uint64 = BASE) -> np.ndarray:
        """64 bits for each word: a polynomial over its bytes, mixed."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        place = np.arange(len(self.data)) - np.repeat(
            np.concatenate([[0], self.starts]), np.diff(np.concatenate([[0], self.starts, [len(self.data)]]))
        )
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * powers(int(max(lengths.max(), place.max() + 1 if len(place) else 1)), base)[place]
        terms[~self.inside] = 0
        return mix64(np.add.reduceat(terms, self.starts))

    def windows(self, hashes: np.ndarray, size: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
        """Rolling polynomial hash of every ``size`` consecutive words of one text, and the first word of each."""
        total = len(hashes) - size + 1
        if total <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = np.zeros(total, np.uint64)
        for j in range(size):
            rolled *= base
            rolled += hashes[j : j + total]
        room = np.repeat(self.bounds[1:], self.counts)[:total] - np.arange(total)
        at = np.flatnonzero(room >= size)
        return mix64(rolled[at]), at
