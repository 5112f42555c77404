"""Exchanges of numbers packed into arrays: one row per sender and range, not one per number.

A route (64 bits, evenly spread) says which range a number belongs to; all numbers of a
range meet in one task, whose memory is bounded by choosing enough ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K


#: Bytes of a table (as Spark estimates them) for each partition that numbers are dealt to.
PARTITION_BYTES = 128 << 20
#: So many numbers are held back until they leave a task as one batch.
HELD = 1 << 20


def partitions_of(df: DataFrame) -> int:
    """Shuffle partitions as set, or more if the files that df reads are too large for so few."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    # a leaf of unknown size says 2**63 - 1
    known = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // PARTITION_BYTES)


def ranges_of(df: DataFrame, each: int = 4) -> int:
    """So many ranges for each partition: a range is what one step of a task holds in memory."""
    return each * partitions_of(df)


def schema(n: int) -> str:
    return ", ".join(["r int", *(f"a{i} binary" for i in range(n))])


def pack(route: np.ndarray, ranges: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each range that has numbers. Within a range the order stays."""
    r = (route.view(np.uint64) >> np.uint64(40)).astype(np.int64) * ranges >> 24
    order = np.argsort(r, kind="stable")
    r = r[order]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])), len(r)) if len(r) else np.zeros(1, np.int64)
    names = ["r", *(f"a{i}" for i in range(len(arrays)))]
    return pa.record_batch([pa.array(r[bounds[:-1]].astype(np.int32)), *(K.packed(a[order], bounds) for a in arrays)], names=names)


def by_range(df: DataFrame, dtypes: list, judge: Callable[[list[tuple[np.ndarray, ...]]], Iterator[pa.RecordBatch]], out: str, n: int, finish: Callable | None = None) -> DataFrame:
    """judge(rows of one range) for each range, dealt to n partitions. With finish, judge's results are held until they are HELD
    numbers, and finish(results) makes batches of them: what leaves a task is then again a row or a few per range."""

    def run(batches):
        at, rows, kept, held = None, [], [], 0

        def flush():
            nonlocal kept, held
            if rows and finish is None:
                yield from judge(rows)
            elif rows:
                kept.append(judge(rows))
                held += len(kept[-1][0])
                if held >= HELD:
                    yield from finish(kept)
                    kept, held = [], 0

        for batch in batches:
            rs = K.long_column(batch.column("r"))
            cols = [K.unpack(batch.column(f"a{i}"), t) for i, t in enumerate(dtypes)]
            for i, r in enumerate(rs):
                if r != at:
                    yield from flush()
                    at, rows = r, []
                rows.append(tuple(v[b[i] : b[i + 1]].copy() for v, b in cols))
        yield from flush()
        if finish is not None and kept:
            yield from finish(kept)

    return df.repartition(n, "r").sortWithinPartitions("r").mapInArrow(run, out)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys (stable), and the bounds of equal ones."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k)) if len(k) else np.zeros(1, np.int64)
