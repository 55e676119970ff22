"""Words of many texts as numpy arrays, straight from Arrow's buffers.

A word is a run of bytes other than blank and 0x09-0x0D. Work goes over slices of a batch, so
memory follows ``SLICE_BYTES`` or, where one text is longer, that text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@dataclass
class Words:
    """Words in order of rows. ``first[i]:first[i + 1]`` are the words of row ``i``."""

    data: np.ndarray  # the bytes of all rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits per word, of its bytes and length."""
        size = len(self.data)
        padded = np.zeros(size + 8, dtype=np.uint8)
        padded[:size] = self.data
        blocks = np.ndarray((size + 1,), dtype="<u8", buffer=padded, strides=(1,))
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64) + U((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
        at, left, who = self.starts, lengths, slice(None)
        while len(at):
            block = blocks[at] & _MASKS[np.minimum(left, 8)]
            out[who] = mix(out[who] ^ block)
            more = np.flatnonzero(left > 8)
            who = more if isinstance(who, slice) else who[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words inside one row, and the index of its first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = self.row_of()
        at = np.flatnonzero(rows[:n] == rows[width - 1 :])
        return self.runs(hashes, at, width), at

    @staticmethod
    def runs(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each index in ``at``: a polynomial of their hashes."""
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = out * U(0x9E3779B97F4A7C15) + hashes[at + k]
        return mix(out)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column, nulls as empty texts."""
    wide = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, Words]]:
    """The number of the first row and the words, for one run of rows after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at, raw = _buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, rows)
        yield row, _split(raw[at[row] : at[end]], at[row : end + 1] - at[row], lower)
        row = end


def _split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # a row's first byte starts a word even if the row before ends in one
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first_byte = np.flatnonzero(starts)
    return Words(data, first_byte, np.flatnonzero(ends) + 1, np.searchsorted(first_byte, offsets))
