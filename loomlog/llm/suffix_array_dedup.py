"""Suffix-array dedup by external induced sorting.

Texts are UTF-8 bytes. As in induced sorting, only a content-chosen subset of suffixes
(the anchors of ``repeats``) is sorted outright: Spark's external sort, which spills to
disk, is the queue that delivers their tuples (first GRAM bytes, bytes from there, bytes
before) in order. Neighbours' common-prefix values follow in one pass. All other suffixes
are induced from these (``induce``): those that begin one byte earlier come in the order
of that byte and, among equal bytes, of the suffixes they were induced from; the common
prefix of two new neighbours is one more than the least between the two they came from.
Tuples whose common prefix has ended leave; the rest are carried on, byte by byte, as far
back as a window can begin. A task reads its shard as a stream and holds ``batch_rows``
tuples, or those of one group, at a time, so a shard may be of any size; groups above the
limit go on under prefixes as long as a window (see ``repeats``).

A passage shorter than ``length`` isn't removed, but told: ``n_shared`` counts the anchors
of windows of ``NEAR`` bytes whose GRAM bytes occur again anywhere. Whatever repeats over
NEAR bytes or more holds one.

Defined cases: a null or empty text has no bytes; matches end at a document's edges;
rows equal in id and text are separate documents; a null id is kept; other columns are
ignored; an empty table gives an empty result. Very long texts are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats

LENGTH = 400
NEAR = 280
GRAM = 184
GROUP_LIMIT = 400


def byte_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return buf, K.byte_codes(buf), offs


def induce(a, left, llen, right, rlen, need: int, gram: int) -> np.ndarray:
    """Marks (suffix, bytes before it) of the suffixes that share need bytes with another, from suffixes sorted by (a, right).

    A queue of tuples (suffix, group, common prefix with the tuple before) is carried back byte by byte, always in the
    order of the suffixes that begin there.
    """
    n, most = left.shape
    out = np.zeros((n, most + 1), dtype=bool)
    suffix = np.arange(n)
    group = np.cumsum(np.append(0, a[1:] != a[:-1])[:n])
    lcp = K.common_prefixes(a, right, rlen)
    for back in range(most + 1):
        if back:
            held = np.flatnonzero(llen[suffix] >= back)
            order = np.argsort(group[held] * 256 + left[suffix[held], back - 1], kind="stable")
            came = held[order]
            byte = left[suffix[came], back - 1]
            kin = np.flatnonzero((group[came[1:]] == group[came[:-1]]) & (byte[1:] == byte[:-1]))
            now = np.zeros(len(came), np.int64)
            now[kin + 1] = 1 + K.range_min(lcp, came[kin] + 1, came[kin + 1])
            suffix, group, lcp = suffix[came], group[came], now
        longest = np.maximum(lcp, np.append(lcp[1:], 0)[: len(lcp)])
        out[suffix[longest >= need], back] = True
        # whoever differs from both neighbours before the anchor's end does so from now on
        stay = np.flatnonzero(longest >= back + gram)
        if len(stay) < 2:
            break
        if len(stay) < len(suffix):
            now = np.zeros(len(stay), np.int64)
            now[1:] = K.range_min(lcp, stay[:-1] + 1, stay[1:])
            suffix, group, lcp = suffix[stay], group[stay], now
    return out


CLEAN = "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary, kept_sha256 string"
_CLEAN_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_shared", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            pos, row = repeats.positions_of(batch.column("ps"))
            spans, row = pos.reshape(-1, 2), row[::2]
            order = np.argsort(row, kind="stable")
            spans, row = spans[order], row[order]
            shared = np.bincount(repeats.positions_of(batch.column("hs"))[1], minlength=batch.num_rows)
            for at, buf, offs in K.chunks(batch.column("text")):
                n = len(offs) - 1
                lo, hi = np.searchsorted(row, [at, at + n])
                base = offs[row[lo:hi] - at]
                gone = K.covered(base + spans[lo:hi, 0], base + spans[lo:hi, 1], len(buf))
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                first = offs[:-1][np.diff(offs) > 0]
                head[first] = gone[first]
                runs = np.concatenate([[0], np.cumsum(head)])[offs]
                left = np.concatenate([[0], np.cumsum(~gone)])[offs]
                raw = buf[~gone].tobytes()
                texts = [raw[left[i] : left[i + 1]] for i in range(n)]
                yield pa.record_batch([ids.slice(at, n), pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(left)), pa.array(np.diff(runs)), pa.array(shared[at : at + n]), pa.array(texts if with_text else [None] * n, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], schema=_CLEAN_ARROW)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, n_shared, kept bytes and their sha256."""
    docs = repeats.keyed(documents)
    gram, near = (GRAM, NEAR) if length >= NEAR else (min(64, length), length)
    hits = repeats.shared_prefixes(docs, byte_units, length, gram, group_limit, near)
    spans = repeats.repeat_intervals(docs, hits, byte_units, np.uint8, induce, length, gram)
    rows = docs.join(spans, "k", "left").join(hits.withColumnRenamed("ps", "hs"), "k", "left")
    return rows.select("doc_id", "text", "k", "ps", "hs").mapInArrow(_cut(with_text), CLEAN)
