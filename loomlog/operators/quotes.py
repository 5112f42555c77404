"""Verbatim quotations: the longest run that a user turn shares with an assistant turn before it.

Of the short pieces of a text only those are kept that are least, by hash, in some stretch of ``least`` characters. Which
they are depends on the stretch alone, so two texts that share such a run keep a piece of it at the same place in the
run. Turns meet where kept pieces are equal; only then are their texts brought together, and each meeting is extended in
both directions along its diagonal. Every run of ``least`` characters or more is found, and found whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from .normalise import SESSION

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kept_pieces(text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places from 0, hashes) of the pieces of half that length that are least in some stretch of ``least`` characters."""
    k = max(1, least // 2)
    x = points(text).astype(np.uint64)
    n = len(x) - k + 1
    if len(x) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = (x + np.uint64(1)) * _MIX[0]
    x ^= x >> np.uint64(33)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _MIX[1] + x[j : j + n]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    # the least of each stretch, then the pieces that are one of these
    lowest = np.lib.stride_tricks.sliding_window_view(h, least - k + 1).min(axis=1)
    wide = np.full(n + least - k, np.uint64(0))
    wide[least - k : least - k + len(lowest)] = lowest
    best = np.lib.stride_tricks.sliding_window_view(wide, least - k + 1)[:n].max(axis=1)
    at = np.flatnonzero(best == h) if len(lowest) else np.zeros(0, np.int64)
    return at, h[at].view(np.int64)


def _pieces(turns: DataFrame, least: int) -> DataFrame:
    """(agent, session_id, id, rank, at, h): kept pieces of turns; at counts from 1."""

    def run(batches):
        for batch in batches:
            found = [kept_pieces(t, least) for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
            if len(row):
                took = pa.array(row)
                at, h = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.record_batch([*(batch.column(c).take(took) for c in (*SESSION, "id", "rank")), pa.array(at + 1), pa.array(h)], names=[*SESSION, "id", "rank", "at", "h"])

    return turns.select(*SESSION, "id", "rank", "text").mapInArrow(run, "agent string, session_id string, id long, rank long, at long, h long")


def runs(a: np.ndarray, b: np.ndarray, meetings: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(length, start in a, start in b), from 1, of the longest equal run around each (diagonal a - b, place in a)."""
    by: dict[int, list[int]] = {}
    for diagonal, at in meetings:
        by.setdefault(diagonal, []).append(at - 1)
    for diagonal, places in by.items():
        lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
        differ = np.flatnonzero(a[lo:hi] != b[lo - diagonal : hi - diagonal]) + lo
        ends = np.unique(np.searchsorted(differ, places))
        for i in ends.tolist():
            start = int(differ[i - 1]) + 1 if i else lo
            end = int(differ[i]) if i < len(differ) else hi
            yield end - start, start + 1, start - diagonal + 1


def _longest(pairs: DataFrame, least: int) -> DataFrame:
    """The longest run of each pair (a_text, text, meetings), the first of equals; pairs without a long one give no row."""
    keep = [*SESSION, "a_id", "b_id"]

    def run(batches):
        for batch in batches:
            best = []
            for a, b, m in zip(*(batch.column(c).to_pylist() for c in ("a_text", "text", "meetings")), strict=True):
                found = [(-n, x, y) for n, x, y in runs(points(a), points(b), [(p["diagonal"], p["at"]) for p in m]) if n >= least]
                best.append(min(found) if found else None)
            rows = [i for i, x in enumerate(best) if x]
            took = pa.array(rows, pa.int64())
            made = [pa.array([c(best[i]) for i in rows], pa.int64()) for c in (lambda x: -x[0], lambda x: x[1], lambda x: x[2])]
            yield pa.record_batch([*(batch.column(c).take(took) for c in keep), *made], names=[*keep, "length", "a_start", "b_start"])

    return pairs.mapInArrow(run, "agent string, session_id string, a_id long, b_id long, length long, a_start long, b_start long")


def quotes(messages: DataFrame, least: int = 40, back: int = 60) -> DataFrame:
    """Per user turn that quotes: the source turn (the nearest of equals), the run, its place, and the rest as comment.

    Only the `back` nearest assistant turns before a user turn are read.
    """
    w = Window.partitionBy(*SESSION).orderBy("message_index")
    said = messages.where(~blank(F.col("text")) & F.col("role").isin("user", "assistant")).withColumn("rank", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = said.select(*SESSION, F.col("message_index").cast("long").alias("id"), "role", "rank", "text").where(F.length("text") >= least)
    found = _pieces(said.where("role = 'assistant'"), least), _pieces(said.where("role = 'user'"), least)
    a, b = (df.select(*SESSION, "h", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "rank", "at")]) for side, df in zip("ab", found, strict=True))
    met = a.join(b, [*SESSION, "h"]).where((F.col("a_rank") <= F.col("b_rank")) & (F.col("a_rank") > F.col("b_rank") - back))
    pairs = met.groupBy(*SESSION, "a_id", "b_id").agg(F.collect_set(F.struct((F.col("a_at") - F.col("b_at")).alias("diagonal"), F.col("a_at").alias("at"))).alias("meetings"))
    text = said.where("role = 'user'").select(*SESSION, F.col("id").alias("b_id"), "text")
    source = said.where("role = 'assistant'").select(*SESSION, F.col("id").alias("a_id"), F.col("text").alias("a_text"))
    longest = _longest(pairs.join(source, [*SESSION, "a_id"]).join(text, [*SESSION, "b_id"]), least)
    best = F.min_by(F.struct("length", "a_id", "b_start"), F.struct(-F.col("length"), -F.col("a_id"), "a_start", "b_start"))
    top = longest.groupBy(*SESSION, "b_id").agg(best.alias("x")).select(*SESSION, "b_id", "x.*")
    out = top.join(text, [*SESSION, "b_id"])
    quote = F.substring("text", F.col("b_start").cast("int"), F.col("length").cast("int"))
    rest = F.trim(F.concat(F.substring("text", F.lit(1), F.col("b_start").cast("int") - 1), F.lit(" "), F.substring("text", (F.col("b_start") + F.col("length")).cast("int"), F.length("text"))))
    return out.select(*SESSION, F.col("b_id").alias("message_index"), F.col("a_id").alias("source_index"), quote.alias("quote"), F.col("length"), rest.alias("comment"))


def quote_totals(found: DataFrame, kind: str) -> DataFrame:
    """(kind, quotes, sessions, length) of quotations by a label column of their sources."""
    return found.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("quotes"), F.count_distinct(*SESSION).alias("sessions"), F.sum("length").alias("length"))
