"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is a linear function of text features. It is learned from preference
pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on the
difference of their features, so only differences matter and no offset is learned. All
pairs count: a pair's weight depends on its two scores only, so labelled rows are added up
by their place on the line of scores, and sums of places meet instead of rows. The
cut between good and bad is a quantile of the training scores, the share of rows
labelled 0, and a score's distance from the cut gives its place between 0 and 1.

Training reads all labelled ids, one row of each; every document is scored, over its whole
text. Features are text statistics alone.

Defined cases: null and empty texts have features 0 and the score of such a text; null
labels or ids don't train; a document labelled twice trains with its lower label; of rows
with one id, the one with the least features trains; with labels of one kind only, every
score says that kind; without labels or rows, all scores are 0.5; a null id isn't held
out; equal rows have equal scores; other columns are kept by ``keep``, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tables import cut, unused

STEPS = 60
#: Width of a place on the line of scores, and the places on either side of 0.
PLACE, PLACES = 1 / 16, 320
RIDGE = 1e-3
NAMES = ("log_length", "upper", "marks", "exclaim", "bars", "digits", "same_word", "same_two", "word_length", "breaks", "blanks", "other_bytes", "stops", "same_line")

_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^_~=+<>{}[]\\", b"!?", b"|\t", b"0123456789", b"\n", b" ", bytes(range(128, 256)), b".,;:"), 1):
    _CLASS[list(_set)] = _i


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES per text."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(doc * 10 + _CLASS[buf], minlength=n * 10).reshape(n, 10).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)
    starts, ends, bounds = K.words(buf, offs)
    h = K.word_hashes(buf, starts, ends)
    of = np.repeat(np.arange(n), np.diff(bounds))
    total = np.maximum(np.diff(bounds), 1).astype(float)

    def again(gap):
        same = np.zeros(len(h), dtype=bool)
        same[gap:] = (h[gap:] == h[:-gap]) & (of[gap:] == of[:-gap])
        return np.bincount(of[same], minlength=n) / total

    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    edge[1:] |= np.append(buf, 0)[:-1] == 10
    lines = np.flatnonzero(edge[: len(buf)])
    stop = np.append(lines[1:], len(buf))
    hl = K.Rolling(K.byte_codes(buf)).slices(lines, stop)
    line_doc = np.searchsorted(offs, lines, side="right") - 1
    key = K.mix(hl + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    twice = K.repeated_values(key) & (stop - lines > 20)
    same_line = np.bincount(line_doc[twice], weights=(stop - lines)[twice], minlength=n) / size
    share = lambda i: np.log1p(50 * counts[:, i] / size)
    word_length = np.bincount(of, weights=ends - starts, minlength=n) / total
    return np.column_stack([np.log1p(np.diff(offs)), share(1), share(2), share(3), share(4), share(5), np.log1p(20 * again(1)), np.log1p(20 * again(2)), np.log1p(word_length), share(6), share(7), share(8), share(9), np.log1p(20 * same_line)])


@dataclass
class Ranker:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    cut: float = 0.0
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip((x @ self.weights - self.cut) * self.scale, -40, 40)))


def bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of a batch of training rows."""
    return batch.column("y").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> DataFrame:
    """(y, x) of every labelled id outside the held-out third, written once."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (bucket(F.col("doc_id")) != held_out))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.where(F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            ids = K.long_column(batch.column("doc_id"))
            for at, buf, offs in K.chunks(batch.column("text")):
                x, m = features(buf, offs), len(offs) - 1
                flat = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([pa.array(ids[at : at + m]), flat], names=["doc_id", "x"])

    # features before the join: it moves these numbers, no texts
    made = rows.mapInArrow(run, "doc_id long, x array<double>").join(usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")), "doc_id")
    return cut(made.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("m")).select("m.y", "m.x"))


def _sums(rows: DataFrame, key, values) -> tuple[np.ndarray, np.ndarray]:
    """Values added up by key over all rows. key and values: of labels and features, a number and a list of numbers for each row;
    tasks add up their own rows first, so as many rows reach the driver as there are keys."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, x = _arrays(batch)
            k, v = key(y, x), values(y, x)
            order = np.argsort(k, kind="stable")
            at = np.flatnonzero(np.diff(k[order], prepend=-1)) if len(k) else np.zeros(0, int)
            for i, add in zip(k[order][at].tolist(), np.add.reduceat(v[order], at) if len(at) else (), strict=True):
                total[i] = total[i] + add if i in total else add
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["k", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, t in zip(batch.column("k").to_pylist(), batch.column("v").to_numpy(zero_copy_only=False), strict=True):
                total[i] = total[i] + t if i in total else t
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["k", "v"])

    found = rows.mapInArrow(run, "k long, v array<double>").repartition(8, "k").sortWithinPartitions("k", "v").mapInArrow(add, "k long, v array<double>").toArrow()
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    k = found.column("k").to_numpy()
    order = np.argsort(k)
    v = np.array(found.column("v").combine_chunks().flatten()).reshape(len(k), -1)
    return k[order], v[order]


_I, _J = np.triu_indices(len(NAMES))


def _pairs(k: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(number, slope, curve) of the logistic loss over all pairs of a good and a bad row, from the sums by label and place. Rows of
    one place count as scoring its mean; their features count as they are."""
    n, d = v[:, 0], len(w)
    x = v[:, 1 : 1 + d]
    square = np.empty((len(k), d, d))
    square[:, _I, _J] = square[:, _J, _I] = v[:, 1 + d :]
    s = x @ w / n
    g, b = np.flatnonzero(k % 2 == 1), np.flatnonzero(k % 2 == 0)
    p = 1.0 / (1.0 + np.exp(-np.clip(s[g][:, None] - s[b][None, :], -30, 30)))
    miss, bend = 1 - p, p * (1 - p)
    # sums over pairs of what depends on the two places only, times sums of features within them
    slope = (miss @ n[b]) @ x[g] - (n[g] @ miss) @ x[b]
    cross = x[g].T @ bend @ x[b]
    curve = np.tensordot(bend @ n[b], square[g], 1) + np.tensordot(n[g] @ bend, square[b], 1) - cross - cross.T
    return n[g].sum() * n[b].sum(), slope, curve


def fit(rows: DataFrame) -> Ranker:
    """Newton steps on the logistic loss of all preference pairs, and the cut among the scores of all rows."""
    k, v = _sums(rows, lambda y, x: y.astype(np.int64), lambda y, x: np.column_stack([np.ones(len(y)), x, x * x]))
    d = len(NAMES)
    n = {int(i): float(c) for i, c in zip(k, v[:, 0], strict=True)}
    if not n.get(0) or not n.get(1):
        return Ranker(cut=1.0 if n.get(0) else 0.0)
    total = sum(n.values())
    middle = v[:, 1 : 1 + d].sum(axis=0) / total
    spread = np.maximum(np.sqrt(np.maximum(v[:, 1 + d :].sum(axis=0) / total - middle**2, 0)), 1e-9)
    w = np.zeros(d)
    for _ in range(STEPS):
        now = w.copy()
        scaled = lambda x: (x - middle) / spread
        place = lambda y, x: (np.clip(np.floor(scaled(x) @ now / PLACE), -PLACES, PLACES).astype(np.int64) + PLACES) * 2 + y  # noqa: E731, B023
        sums = lambda y, x: np.column_stack([np.ones(len(y)), scaled(x), scaled(x)[:, _I] * scaled(x)[:, _J]])
        pairs, slope, curve = _pairs(*_sums(rows, place, sums), now)
        step = np.linalg.solve(curve / pairs + RIDGE * np.eye(d), slope / pairs - RIDGE * w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    w = w / spread
    at = int(n[0])  # as many scores lie under the cut as labels are 0
    return Ranker(w, (_nth(rows, w, at - 1) + _nth(rows, w, min(at, int(total) - 1))) / 2, 1.0)


def _nth(rows: DataFrame, w: np.ndarray, n: int) -> float:
    """The n-th score from below, from 0: counts by a thousand parts of a range, then of the part that holds it, until that has one score."""
    low, high, below = -np.inf, np.inf, 0
    for _ in range(20):
        inside = lambda s: (s >= low) & (s <= high)  # noqa: E731, B023

        def ends(batches, inside=inside):
            for batch in batches:
                s = _arrays(batch)[1] @ w
                s = s[inside(s)]
                if len(s):
                    yield pa.record_batch([pa.array([s.min()]), pa.array([s.max()])], names=["low", "high"])

        x = rows.mapInArrow(ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).head()
        low, high = x.low, x.high
        if low == high:
            break
        edges = np.linspace(low, high, 1_001)
        part = lambda y, x: np.where(inside(x @ w), np.clip(np.searchsorted(edges, x @ w, side="right") - 1, 0, 999), 1_000)  # noqa: E731, B023
        k, v = _sums(rows, part, lambda y, x: np.ones((len(y), 1)))
        k, counts = k[k < 1_000], v[k < 1_000, 0]
        upto = below + np.cumsum(counts)
        i = int(np.searchsorted(upto, n, side="right"))
        below = int(upto[i] - counts[i])
        low, high = edges[k[i]], edges[k[i] + 1] if k[i] == 999 else np.nextafter(edges[k[i] + 1], -np.inf)
    return float(low)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> Ranker:
    """The ranker learned from all labels outside the held-out third."""
    return fit(training_rows(docs, labels, held_out))


def scores(docs: DataFrame, ranker: Ranker, *keep: str, name: str = "score") -> DataFrame:
    """The columns to keep (doc_id unless named), and the score under the given name, of every row."""
    kept = docs.select(*(keep or ("doc_id",)))
    names = [*kept.columns, name]

    def run(batches):
        for batch in batches:
            for at, buf, offs in K.chunks(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, len(offs) - 1).columns[:-1]
                yield pa.record_batch([*part, pa.array(ranker.score(features(buf, offs)))], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select(*(keep or ("doc_id",)), F.col("text").alias(unused(docs, "whole_text"))).mapInArrow(run, schema)


def keep(docs: DataFrame, ranker: Ranker, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least so high, all columns kept."""
    name = unused(docs, "score")
    return scores(docs, ranker, *docs.columns, name=name).where(F.col(name) >= least).select(*docs.columns)
