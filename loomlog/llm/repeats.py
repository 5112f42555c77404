"""Long repeats across a whole corpus, shared by the two exact substring operators.

A window is a run of ``length`` units (words or bytes) of one document. It is
repeated when its content also starts anywhere else. Shuffling every suffix of
100 TB is out of reach, so the work goes in three exact steps:

1. *Prefixes are counted.* Each window has an anchor, its least k-gram, found from its
   content alone; equal windows therefore share anchor and offset. Only the suffixes at
   anchors are shuffled, under their first k units, packed into arrays by hash range.
   Prefixes that occur once in the corpus are leaves: no repeated window holds them.
2. *Groups.* The suffixes under a prefix that recurs are brought together in sorted
   order, each with the units before it, and a kernel reads the repeats off them. A group
   has fewer than ``group_limit`` members, so it fits memory.
3. *Longer prefixes.* Where a prefix has more suffixes, those at every window around it
   get their own prefix, as long as a window, and are counted like those of step 1. What
   shares so long a prefix is repeated, so its group needs no kernel and may have any
   size; what several rows of a task share is sent once.

Nothing is dropped on the way: every window is judged by step 2 or step 3, and an
anchor's occurrences all take the same step. Prefixes are named by 64-bit hashes; in step
2 the units themselves are compared. Rows equal in id and text are told the same once, so
their cost is in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packed

SCATTERED = packed.schema(3)
REPLY = "k long, p binary"
REPLY_ARROW = pa.schema([("k", pa.int64()), ("p", pa.binary())])
SEND_ROWS = 400_000
# In place of a position (32 bits, as no text is longer): a prefix that is known to be frequent.
_FREQUENT = (1 << 32) - 1


def scatter(parts: Iterator[tuple[np.ndarray, ...]], ranges: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Pack (hash, key, position) by hash. What occurs limit times in a buffer is known to be frequent: it is sent once,
    with key 0 and _FREQUENT as position, and its own positions go out under hash 0, dealt by key."""

    def send(held):
        h, k, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = packed.groups(h)
        h, k, p = np.maximum(h[order], np.uint64(1)), k[order], p[order].astype(np.uint32)
        counts = np.diff(first)
        often = np.repeat(counts >= limit, counts)
        route = h
        if often.any():
            one = np.zeros(len(h), dtype=bool)
            one[first[:-1]] = True
            marker = often & one
            told = (K.mix(k[often].view(np.uint64)), np.zeros(int(often.sum()), np.uint64), k[often], p[often])
            keep = ~often | one
            k, p = np.where(marker, 0, k)[keep], np.where(marker, np.uint32(_FREQUENT), p)[keep]
            h = h[keep]
            route, h, k, p = (np.concatenate(x) for x in zip((h, h, k, p), told, strict=True))
        yield packed.pack(route, ranges, h, k, p)

    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= SEND_ROWS:
            yield from send(held)
            held, n = [], 0
    if held:
        yield from send(held)


def recurring(scattered: DataFrame, limit: int, partitions: int) -> DataFrame:
    """(k, ps): per key the packed positions whose hash occurs again anywhere, each once; ~position if limit times or more.

    The answers go back packed by ranges of keys.
    """

    def judge(rows):
        h, k, p = (np.concatenate(x) for x in zip(*rows, strict=True))
        told, p = h == 0, p.astype(np.int64)
        known = (k[told], ~p[told])
        order, first = packed.groups(h[~told])
        h, k, p = h[~told][order], k[~told][order], p[~told][order]
        if not len(h):
            return known
        marker = p == _FREQUENT
        total = np.repeat(np.add.reduceat(np.where(marker, limit, 1), first[:-1]), np.diff(first))
        out = (total > 1) & ~marker
        return np.concatenate([known[0], k[out]]), np.concatenate([known[1], np.where(total[out] >= limit, ~p[out], p[out])])

    def finish(kept):
        k, p = (np.concatenate(x) for x in zip(*kept, strict=True))
        if len(k):
            yield packed.pack(k, partitions, k, p)

    def regroup(rows):
        k, p = (np.concatenate(x) for x in zip(*rows, strict=True))
        k, p = _each_once(k, p)
        _, bounds = packed.groups(k)
        yield pa.record_batch([pa.array(k[bounds[:-1]]), K.packed(p, bounds)], schema=REPLY_ARROW)

    told = packed.by_range(scattered, [np.uint64, np.int64, np.uint32], judge, packed.schema(2), partitions, finish)
    return packed.by_range(told, [np.int64, np.int64], regroup, REPLY, partitions).select("k", F.array("p").alias("ps"))


def _each_once(k: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of several columns in order, each once."""
    order = np.lexsort((*reversed(more), k))
    out = [x[order] for x in (k, *more)]
    new = np.ones(len(k), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in out], axis=0)
    return tuple(x[new] for x in out)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key k; rows equal in both share a key and are told the same."""
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("k"))


def positions_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flatten a list<binary> column of packed int64s: values and the row of each."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, bounds = K.unpack(lists.flatten(), np.int64)
    per_item = np.diff(bounds)
    items = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row_of_item = np.repeat(np.arange(len(lists)), items)
    return flat, np.repeat(row_of_item, per_item)


CONTEXT = "a long, l binary, r binary, k long, p long"
CONTEXT_ARROW = pa.schema([("a", pa.int64()), ("l", pa.binary()), ("r", pa.binary()), ("k", pa.int64()), ("p", pa.int64())])


def _spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, back: bool) -> pa.Array:
    """values[lo:hi] of each row, reversed if back, as binary rows."""
    n = hi - lo
    bounds = np.concatenate([[0], np.cumsum(n)])
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    at = np.repeat(hi - 1, n) - step if back else np.repeat(lo, n) + step
    return K.packed(values[at], bounds)


def _hits(batches, units: Callable, frequent: bool):
    """Of rows (doc_id, text, k, ps), a few megabytes at a time: row keys, symbols, rolling hash, row offsets, and row and
    position of those anchors of one kind that windows of the full length have, in order. Positions are coded as by repeat_intervals."""
    for batch in batches:
        keys = K.long_column(batch.column("k"))
        pos, row = positions_of(batch.column("ps"))
        own = (pos < 0) == frequent
        pos = np.where(pos < 0, ~pos, pos)
        own &= (pos & 1).astype(bool)
        pos, row = pos[own] >> 1, row[own]
        order = np.lexsort((pos, row))
        pos, row = pos[order], row[order]
        for at, buf, offs in K.chunks(batch.column("text")):
            lo, hi = np.searchsorted(row, [at, at + len(offs) - 1])
            if lo < hi:
                symbols, codes, uoffs = units(buf, offs)
                d = row[lo:hi] - at
                yield keys[at : at + len(offs) - 1], symbols, K.Rolling(codes), uoffs, d, uoffs[d] + pos[lo:hi]


#: Anchors whose surroundings leave a task as one batch.
CONTEXT_ROWS = 10_000


def context_rows(units: Callable, length: int, k: int) -> Callable:
    """Step 2: each anchor with the text before and after it that a window may hold."""

    def run(batches):
        for keys, symbols, roll, uoffs, d, w in _hits(batches, units, False):
            for at in range(0, len(d), CONTEXT_ROWS):
                di, wi = d[at : at + CONTEXT_ROWS], w[at : at + CONTEXT_ROWS]
                begin, end = uoffs[di], uoffs[di + 1]
                left, right = np.maximum(begin, wi - (length - k)), np.minimum(end, wi + length)
                yield pa.record_batch([pa.array(roll.slices(wi, wi + k).view(np.int64)), _spans(symbols, left, wi, True), _spans(symbols, wi, right, False), pa.array(keys[di]), pa.array(wi - begin)], schema=CONTEXT_ARROW)

    return run


def window_rows(units: Callable, length: int, k: int, ranges: int) -> Callable:
    """Step 3: every window that holds a frequent anchor."""

    def run(batches):
        def parts():
            for keys, symbols, roll, uoffs, d, w in _hits(batches, units, True):
                left, right = np.maximum(uoffs[d], w - (length - k)), np.minimum(w, uoffs[d + 1] - length)
                ok = right >= left
                s = np.flatnonzero(K.covered(left[ok], right[ok] + 1, len(symbols)))
                if len(s):
                    doc = np.searchsorted(uoffs, s, side="right") - 1
                    yield roll.slices(s, s + length), keys[doc], s - uoffs[doc]

        # two of a window are enough, so what a task repeats itself isn't asked
        yield from scatter(parts(), ranges, 2)

    return run


def group_rows(kernel: Callable, dtype, length: int, k: int, batch_rows: int = 4000) -> Callable:
    """Contexts sorted by anchor and right text -> (k, packed intervals). Whole groups, batch_rows or one group at a time."""
    a_max, b_max = length - k, length

    def judge(rows):
        a = np.concatenate([x[0] for x in rows])
        keys, p = np.concatenate([x[3] for x in rows]), np.concatenate([x[4] for x in rows])

        def matrix(i, width):
            out, lens, at = np.zeros((len(a), width), dtype), np.zeros(len(a), np.int64), 0
            for x in rows:
                v, b = x[i]
                n = np.diff(b)
                r = np.repeat(np.arange(len(n)), n)
                out[at + r, np.arange(b[-1] - b[0]) - np.repeat(b[:-1] - b[0], n)] = v[b[0] : b[-1]]
                lens[at : at + len(n)] = n
                at += len(n)
            return out, lens

        left, llen = matrix(1, a_max)
        right, rlen = matrix(2, b_max)
        row, lo, hi = _runs(kernel(a, left, llen, right, rlen, length, k))
        if len(row):
            ks, begin, end = _each_once(keys[row], p[row] - hi, p[row] - lo + length)
            _, bounds = packed.groups(ks)
            yield pa.record_batch([pa.array(ks[bounds[:-1]]), K.packed(np.column_stack([begin, end]).ravel(), bounds * 2)], schema=REPLY_ARROW)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            a = K.long_column(batch.column("a"))
            x = [a, K.unpack(batch.column("l"), dtype), K.unpack(batch.column("r"), dtype), K.long_column(batch.column("k")), K.long_column(batch.column("p"))]
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            if held and held[-1][0][-1] != a[0] and n >= batch_rows:
                yield from judge(held)
                held, n = [], 0
            at = 0
            while at < len(a):
                ahead = cut[cut >= at + max(1, batch_rows - n)]
                to = int(ahead[0]) if len(ahead) else len(a)
                held.append((x[0][at:to], *((v, b[at : to + 1]) for v, b in x[1:3]), x[3][at:to], x[4][at:to]))
                n += to - at
                at = to
                if at < len(a):
                    yield from judge(held)
                    held, n = [], 0
        if held:
            yield from judge(held)

    return run


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of marks in a row."""
    n, m = marks.shape
    edge = np.zeros((n, m + 2), dtype=np.int8)
    edge[:, 1:-1] = marks
    d = np.diff(edge, axis=1)
    row, lo = np.nonzero(d == 1)
    _, hi = np.nonzero(d == -1)
    return row, lo, hi - 1


def shared_prefixes(docs: DataFrame, units: Callable, length: int, k: int, group_limit: int, near: int | None = None) -> DataFrame:
    """Step 1. keyed() rows -> (k, ps): the anchors of each key whose k-gram occurs again anywhere.

    Anchors are the least k-grams of windows of near units (length unless given); those of windows of the full length are
    among them. A position p is coded 2 * p, plus 1 for these; frequent ones are inverted.
    """
    ranges, near = packed.ranges_of(docs), near or length

    def find(batches):
        def parts():
            for batch in batches:
                keys = K.long_column(batch.column("k"))
                for at, buf, offs in K.chunks(batch.column("text")):
                    _, codes, uoffs = units(buf, offs)
                    p, h, whole = K.anchors(K.Rolling(codes), uoffs, length, k, near)
                    doc = np.searchsorted(uoffs, p, side="right") - 1
                    yield h, keys[doc + at], 2 * (p - uoffs[doc]) + whole

        yield from scatter(parts(), ranges, group_limit)

    return recurring(docs.select("text", "k").mapInArrow(find, SCATTERED), group_limit, packed.partitions_of(docs))


def repeat_intervals(docs: DataFrame, hits: DataFrame, units: Callable, dtype, kernel: Callable, length: int, k: int) -> DataFrame:
    """keyed() rows and their shared_prefixes -> (k, ps): packed (start, end) intervals, in units, that repeated windows cover."""
    ranges, n = packed.ranges_of(docs), packed.partitions_of(docs)
    found = docs.join(hits, "k").select("doc_id", "text", "k", "ps")
    groups = found.mapInArrow(context_rows(units, length, k), CONTEXT).repartition(n, "a").sortWithinPartitions("a", "r").mapInArrow(group_rows(kernel, dtype, length, k), REPLY)

    def spans(batches):
        for batch in batches:
            pos, row = positions_of(batch.column("ps"))
            pos = np.where(pos < 0, ~pos, pos)
            keys = K.long_column(batch.column("k"))[row]
            out = np.empty((len(pos), 2), np.int64)
            out[:, 0], out[:, 1] = pos, pos + length
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
            yield pa.record_batch([pa.array(keys[bounds[:-1]]), K.packed(out.ravel(), bounds * 2)], schema=REPLY_ARROW)

    windows = recurring(found.mapInArrow(window_rows(units, length, k, ranges), SCATTERED), 2, n)
    frequent = windows.mapInArrow(spans, REPLY)
    return groups.unionByName(frequent).groupBy("k").agg(F.collect_list("p").alias("ps"))
