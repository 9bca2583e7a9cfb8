"""Words, lines and their hashes straight from the bytes of an Arrow text column.

All separators that matter here are single ASCII bytes, which never occur inside
a longer UTF-8 sequence, so the work is done on bytes, a whole batch at a time.
Hashes are 64 bits of a keyed polynomial, mixed; equal hashes stand for equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.random.default_rng(71).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_KEYS = byte_keys(17)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SLICE, 1 << int(n).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        if size > _SLICE:
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = _KEYS) -> np.ndarray:
    """One hash for each byte run ``data[start:end]``; starts and ends ascend.  Memory follows one slice, not the text."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SLICE, "right")))
        part = data[low : int(ends[j - 1])]
        up, down = _power_rows(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(keys[part] * up[: len(part)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


class Texts:
    """The bytes of consecutive rows and where each row begins; a missing text is an empty one."""

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.bounds = at - at[0]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def per_row(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending byte positions fall into each row."""
        return np.diff(np.searchsorted(positions, self.bounds))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of marked bytes; no run crosses a row's end."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = self.bounds[:-1][np.diff(self.bounds) > 0]
        first[edges] = inside[edges]
        closing = self.bounds[1:][np.diff(self.bounds) > 0] - 1
        last[closing] = inside[closing]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of characters other than blank, tab and line breaks."""
        return self.runs(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of every line; a row has one line more than line feeds."""
        breaks = np.flatnonzero(self.data == 10)
        rows = np.searchsorted(self.bounds, breaks, "right") - 1
        count = self.per_row(breaks) + 1
        row = np.repeat(np.arange(len(self)), count)
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(self) else np.zeros(0, np.int64)
        starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        slot = np.arange(len(breaks)) + rows  # each earlier row has one line without a line feed
        ends[slot] = breaks
        starts[slot + 1] = breaks + 1
        starts[first] = self.bounds[:-1]
        ends[first + count - 1] = self.bounds[1:]
        return row, starts, ends

    def code_points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Characters in each byte run."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=sums[1:])
        return sums[ends] - sums[starts]


def slices(batch: pa.RecordBatch, column: str, limit: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, one row at least.

    Work arrays take many times a piece's bytes, and workers wait for their next task
    without giving memory back by themselves: pieces are small, and what the batch took is released.
    """
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    upto, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def window_hashes(words: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive words of a row, and the first word's place of each."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words[:n] * _ODD[0]
    for j in range(1, width):
        total += words[j : j + n] * _ODD[j]
    last = np.repeat(np.cumsum(per_row), per_row)  # one past the row's last word, for each word
    place = np.flatnonzero(np.arange(n) + width <= last[:n])
    return mix(total[place]), place


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its windows of ``width`` words.

    A text of fewer words, one at least, has one shingle: all its words.  A text without words has none.
    """
    texts = Texts(column)
    starts, ends = texts.words()
    hashes = run_hashes(texts.data, starts, ends)
    per_row = texts.per_row(starts)
    windows, place = window_hashes(hashes, per_row, width)
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    cut = np.searchsorted(place, bounds)
    for i, n in enumerate(per_row):
        if n >= width:
            yield np.unique(windows[cut[i] : cut[i + 1]])
        elif n:
            own = hashes[bounds[i] : bounds[i + 1]]
            yield mix(np.sum(own * _ODD[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
