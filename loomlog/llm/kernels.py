"""Vectorised text kernels that run inside Spark's Arrow tasks.

Texts arrive as Arrow string arrays; everything below works on their UTF-8
buffers, a few megabytes at a time, so a task's memory does not depend on how
many rows it reads (one row alone may be larger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of any slice of a sequence, by a prefix sum modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power(len(values))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n items from each position, where as many follow."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[n:] - self.sums[:count]) * self.down[:count])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of the texts, whole rows, about limit bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (one more entry than rows). space: which bytes are in no word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~space[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offs] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    roll = Rolling(_TABLE[LOWER[buf] if lower else buf])
    return roll.slices(starts, ends)


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over x[i : i + w] for each i with w items from there, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors(roll: Rolling, offs: np.ndarray, length: int, k: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window of ``near`` units, and which of them are least in one
    of ``length`` units, which is near or more.

    Which k-gram of a window is least depends on the window's content alone, so
    equal windows share an anchor at the same distance from their start.
    """
    total = int(offs[-1])
    if total < near:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    full = roll.windows(k)
    x = (full >> np.uint64(32)).astype(np.uint32)
    np.maximum(x, np.uint32(1), out=x)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(total)
    fits = left[: len(x)] >= k
    x[~fits] = np.iinfo(np.uint32).max

    def least_in(window):
        w = window - k + 1
        if len(x) < w:
            return np.zeros(len(x), bool)
        least = _slide(x, w, np.minimum)
        least[left[: len(least)] < window] = 0
        padded = np.zeros(len(x) + w - 1, dtype=np.uint32)
        padded[w - 1 : w - 1 + len(least)] = least
        return (_slide(padded, w, np.maximum) == x) & fits

    here = least_in(near)
    at = np.flatnonzero(here)
    return at, full[at], (here if near == length else least_in(length))[at]


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose rows are values[bounds[i]:bounds[i+1]]."""
    raw = np.ascontiguousarray(values)
    offsets = (bounds * raw.itemsize).astype(np.int64)
    kind = pa.large_binary()
    out = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return out.cast(pa.binary())


def unpack(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    if raw.ctypes.data % np.dtype(dtype).itemsize:
        raw = raw.copy()
    return raw.view(dtype), (offs - offs[0]) // np.dtype(dtype).itemsize


def long_column(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def repeated_values(x: np.ndarray) -> np.ndarray:
    """Which items of x occur more than once."""
    out = np.zeros(len(x), dtype=bool)
    if len(x) < 2:
        return out
    order = np.argsort(x)
    s = x[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(x), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    out[order[hit]] = True
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the intervals."""
    delta = np.zeros(n + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo..hi], both ends included, for each pair of bounds."""
    if not len(lo):
        return x[:0]
    bounds = np.empty(2 * len(lo), np.int64)
    bounds[::2], bounds[1::2] = lo, hi + 1
    return np.minimum.reduceat(np.append(x, x[-1:]), bounds)[::2]


def common_prefixes(group: np.ndarray, rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """How many first items each sorted row shares with the row before it; 0 for the first of a group."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        same = np.minimum(same, np.minimum(lens[1:], lens[:-1]))
        out[1:] = np.where(group[1:] == group[:-1], same, 0)
    return out
