"""Vectorised text work on Arrow batches: bytes, words, word hashes and shingles of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Work is done in slices of about so many bytes, so that temporary arrays stay in cache and memory stays bounded.
SLICE_BYTES = 1 << 19

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def class_table(members: bytes | list[int]) -> np.ndarray:
    """A 256-entry table that is True at the given byte values."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes other than the blanks 0x20 and 0x09-0x0D.
NON_BLANK = ~class_table([0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes; a longer row is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + budget, "right")) - 1)
        yield low, high
        low = high


class _Powers:
    """Powers of an odd step modulo 2^64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * SLICE_BYTES)
            inverse = pow(_STEP, -1, 2**64)
            self.up, self.down = (np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (_STEP, inverse))
        return self.up, self.down


_powers = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of rows [low, high): runs of bytes that ``member`` holds, A-Z lower-cased.

    start, end: byte positions in ``data``; first: index of each row's first word, with a closing entry; hash: 64 bits.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, member: np.ndarray = NON_BLANK) -> None:
        base, stop = int(offsets[low]), int(offsets[high])
        self.base, self.data = base, _LOWER[data[base:stop]]
        bounds = offsets[low : high + 1] - base
        inside = np.zeros(stop - base + 2, bool)
        inside[1:-1] = member[self.data]
        cut = np.zeros(stop - base + 1, bool)
        cut[bounds] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.bounds = bounds
        self.first = np.searchsorted(self.start, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _powers.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingles as 64-bit hashes; a row with fewer words has its whole sequence as one, a row without words none."""
    total = len(hashes)
    rolled = np.zeros(max(total - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = mixed(rolled + hashes[k : k + len(rolled)] + _U(k + 1))
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= n:
            out.append(np.unique(rolled[low : high - n + 1]))
        elif high > low:
            h = np.zeros(1, np.uint64)
            for k in range(low, high):
                h = mixed(h + hashes[k : k + 1] + _U(k - low + 1))
            out.append(mixed(h + _U(1 << 40)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
