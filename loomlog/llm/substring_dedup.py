"""Substring dedup by prefix-partitioned suffix trees.

The corpus is one sequence of words per document. Its suffixes are split by prefixes of
variable length into groups that fit memory (``repeats``): those at content-chosen words
under their first ``GRAM`` words, and those around a prefix that is too frequent under a
whole window. Each group's suffix tree is built by itself (``internal_nodes``): its leaves
are the group's sorted suffixes, its internal nodes the runs of suffixes with a common
prefix. A node whose depth, together with the words that its leaves share before their
prefix, reaches ``length`` is a repeat of that length; leaves under such nodes are marked,
and marked windows that follow one another join to maximal repeats.

Defined cases: a null or empty text has no words and loses none; rows equal in id and
text are separate documents that repeat each other; a null id is kept; other columns
are ignored; an empty table gives an empty result. Very long texts are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats

LENGTH = 35
GRAM = 8
GROUP_LIMIT = 4_096


def word_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = K.words(buf, offs)
    h = K.word_hashes(buf, starts, ends)
    return (h >> np.uint64(32)).astype(np.uint32), h, bounds


def internal_nodes(lcp: np.ndarray, least: int) -> np.ndarray:
    """The internal nodes at least so deep of the trees over sorted suffixes: first leaf, last leaf, depth, depth of the parent.

    lcp[i] is the common prefix of leaves i - 1 and i. Nodes whose parent is less deep than least have least - 1 there.
    """
    out, open_nodes = [], []
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while open_nodes and open_nodes[-1][0] > depth:
            d, first = open_nodes.pop()
            above = max(depth, open_nodes[-1][0] if open_nodes else 0, least - 1)
            out.append((first, i - 1, d, above))
        if depth >= least and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, first))
    return np.array(out, np.int64).reshape(-1, 4)


def tree_leaves(a, left, llen, right, rlen, need: int, gram: int) -> np.ndarray:
    """Marks (suffix, words before it) of the windows that lie under a node of depth need, in the trees of sorted suffixes.

    A node of depth d stands for all prefixes down to its parent's depth. Its leaves are taken in the order of the words before
    them: two neighbours that share need - d such words, or more, are under a node of depth need if the suffixes are begun
    that much earlier.
    """
    n, most = left.shape
    nodes = internal_nodes(K.common_prefixes(a, right, rlen), gram)
    marks = np.zeros((n, most + 2), np.int32)
    if not len(nodes):
        return marks[:, :-1] > 0
    before = np.lexsort((*left.T[::-1], a))
    shared = K.common_prefixes(a[before], left[before], llen[before])
    place = np.empty(n, np.int64)
    place[before] = np.arange(n)
    first, last, depth, above = nodes.T
    sizes = last - first + 1
    node = np.repeat(np.arange(len(nodes)), sizes)
    leaf = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[node]
    order = np.argsort(node * n + place[leaf])
    node, leaf = node[order], leaf[order]
    kin = np.flatnonzero(node[1:] == node[:-1])
    most_shared = np.full(len(leaf), -1)
    with_next = K.range_min(shared, place[leaf[kin]] + 1, place[leaf[kin + 1]])
    most_shared[kin] = with_next
    most_shared[kin + 1] = np.maximum(most_shared[kin + 1], with_next)
    begin, end = np.maximum(need - depth[node], 0), np.minimum(need - above[node] - 1, most_shared)
    ok = begin <= end
    np.add.at(marks, (leaf[ok], begin[ok]), 1)
    np.add.at(marks, (leaf[ok], end[ok] + 1), -1)
    return np.cumsum(marks, axis=1)[:, :-1] > 0


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``keyed`` documents -> (k, ps): packed (first word, end word) of the repeats, which may overlap."""
    gram = min(GRAM, length)
    hits = repeats.shared_prefixes(docs, word_units, length, gram, group_limit)
    return repeats.repeat_intervals(docs, hits, word_units, np.uint32, tree_leaves, length, gram)


CLEAN = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
_CLEAN_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            pos, row = repeats.positions_of(batch.column("ps"))
            spans, row = pos.reshape(-1, 2), row[::2]
            order = np.argsort(row, kind="stable")
            spans, row = spans[order], row[order]
            for at, buf, offs in K.chunks(batch.column("text")):
                starts, ends, bounds = K.words(buf, offs)
                n = len(offs) - 1
                lo, hi = np.searchsorted(row, [at, at + n])
                base = bounds[row[lo:hi] - at]
                gone = K.covered(base + spans[lo:hi, 0], base + spans[lo:hi, 1], len(starts))
                kept = ~gone
                doc = np.repeat(np.arange(n), np.diff(bounds))
                data = np.full(len(buf) + n, 32, np.uint8)
                data[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offs))] = buf
                data[ends + doc] = 32
                delta = np.zeros(len(data) + 1, np.int8)
                delta[(starts + doc)[kept]] += 1
                delta[(ends + doc + 1)[kept]] -= 1
                body = data[np.cumsum(delta[:-1], dtype=np.int8) > 0]
                count = np.concatenate([[0], np.cumsum(kept)])[bounds]
                size = np.concatenate([[0], np.cumsum(np.where(kept, ends - starts + 1, 0))])[bounds]
                raw = body.tobytes()
                texts = [raw[size[i] : max(size[i], size[i + 1] - 1)] for i in range(n)]
                yield pa.record_batch([ids.slice(at, n), pa.array(np.diff(bounds)), pa.array(np.diff(bounds) - np.diff(count)), pa.array([t.decode() for t in texts] if with_text else [None] * n, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], schema=_CLEAN_ARROW)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by one space) and its sha256."""
    docs = repeats.keyed(documents)
    return docs.join(repeated_spans(docs, length, group_limit), "k", "left").select("doc_id", "text", "k", "ps").mapInArrow(_cut(with_text), CLEAN)
