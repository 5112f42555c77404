"""An index of the trigrams of lower-cased texts, for substring facets that would otherwise read every text.

Each row says that a trigram occurs in a session. A text that holds a needle holds all of its trigrams, so only sessions
with all of them can match; their raw texts are then searched as without an index, so the index never changes a result.
The table is bucketed by trigram: a needle reads a few buckets. New sessions are added as a batch of their own; sessions
whose texts have grown may be added again.

Defined cases: needles of fewer than three characters can't be looked up, and leave all sessions; blank and null texts
have no trigrams; case is that of ``lower`` on both sides; a session that isn't in the index is searched always if
``known`` is given, so an index that lags behind loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalise import SESSION

GRAM = 3
#: A session's trigrams are dealt to so many parts by hash.
PARTS = 16


def _packed(codes: np.ndarray) -> np.ndarray:
    """Code points of a text as its trigrams, each one number: 21 bits a character."""
    c = codes.astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _text(gram: int) -> str:
    return "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def index(rows: DataFrame, columns: Sequence[str] = ("text", "body")) -> DataFrame:
    """(gram, agent, session_id) of the given texts of each session, each once.

    Trigrams are numbers, sorted once for each row, and move as lists: a few rows for each text instead of one for each trigram. A
    session's lists meet in order of their key, each part of its trigrams by itself, so no session is gathered in memory or in one task.
    """
    names = [f"_{i}" for i in range(len(columns))]
    given = rows.select(*SESSION, *[F.make_valid_utf8(F.lower(F.col(c))).alias(n) for c, n in zip(columns, names, strict=True)])
    kinds = ", ".join(f"{c} {t}" for c, t in given.select(*SESSION).dtypes)

    def pack(batches):
        for batch in batches:
            of, part, lists = [], [], []
            for i, texts in enumerate(zip(*[batch.column(n).to_pylist() for n in names], strict=True)):
                found = [_packed(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in texts if t and len(t) >= GRAM]
                if found:
                    grams = np.unique(np.concatenate(found))
                    p = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64)
                    grams = grams[np.argsort(p, kind="stable")]
                    ends = np.cumsum(np.bincount(p, minlength=PARTS))
                    for j, x in enumerate(np.split(grams, ends[:-1])):
                        if len(x):
                            of.append(i)
                            part.append(j)
                            lists.append(x)
            if lists:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.record_batch([*[batch.column(c).take(pa.array(of)) for c in SESSION], pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=[*SESSION, "part", "grams"])

    def unpack(batches):
        last, have = None, np.zeros(0, np.int64)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*SESSION, "part")], strict=True))
            lists = batch.column("grams")
            ends, grams = lists.offsets.to_numpy(), lists.values.to_numpy()
            of, found = [], []
            for i, key in enumerate(keys):
                x = grams[ends[i] : ends[i + 1]]
                if key == last:
                    # what this key's rows before haven't told
                    x = np.setdiff1d(x, have, assume_unique=True)
                    have = np.union1d(have, x)
                else:
                    last, have = key, x
                of.append(np.full(len(x), i))
                found.append(x)
            if sum(map(len, found)):
                every, place = np.unique(np.concatenate(found), return_inverse=True)
                words, back = pa.array([_text(g) for g in every.tolist()], pa.string()).take(pa.array(place.ravel())), pa.array(np.concatenate(of))
                for at in range(0, len(words), 100_000):
                    yield pa.record_batch([words.slice(at, 100_000), *[batch.column(c).take(back.slice(at, 100_000)) for c in SESSION]], names=["gram", *SESSION])

    packed = given.mapInArrow(pack, f"{kinds}, part int, grams array<long>")
    return packed.repartition(*SESSION, "part").sortWithinPartitions(*SESSION, "part").mapInArrow(unpack, f"gram string, {kinds}")


def save(grams: DataFrame, table: str, buckets: int = 64) -> None:
    """Create the table or add to it."""
    grams.write.bucketBy(buckets, "gram").sortBy("gram").mode("append").saveAsTable(table)


def candidates(grams: DataFrame, needle: str) -> DataFrame | None:
    """(agent, session_id) of the sessions that hold every trigram of the needle; None where it is too short to tell."""
    low = needle.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    hit = grams.where(F.col("gram").isin(*wanted)).groupBy(*SESSION).agg(F.count_distinct("gram").alias("n"))
    return hit.where(F.col("n") == len(wanted)).select(*SESSION)


def narrowed(rows: DataFrame, grams: DataFrame, needle: str, known: DataFrame | None = None) -> DataFrame:
    """Rows of sessions that may hold the needle. known: the sessions that the index covers; others stay."""
    found = candidates(grams, needle)
    if found is None:
        return rows
    near = rows.join(found, list(SESSION), "left_semi")
    return near if known is None else near.unionByName(rows.join(known.select(*SESSION), list(SESSION), "left_anti"))
