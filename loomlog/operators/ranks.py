"""Positions and running sums over a whole table or over groups of any size, without one task for all rows.

Rows are dealt by ranges of their order and sorted there, so a row's place within its range is known at once. What the
ranges before hold is added afterwards: one row for each range and group that it touches, not one for each row. A group
that holds most of the table is spread over many ranges.

Defined cases: rows equal in ``by`` and ``order`` stand in some fixed order; a null value adds nothing; null groups are a
group of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, unused


def running(df: DataFrame, order: Sequence[Column | str] = (), by: Sequence[str] = (), rank: str = "rank", sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """df with ``rank``, the row's number in its group (from 0), and for each of ``sums`` (new name: column) the sum up to and with the row.

    Without ``order`` rows keep the place in which they are read.
    """
    sums = sums or {}
    at, part, n = unused(df, "_at"), unused(df, "_part"), unused(df, "_n")
    keys = [F.col(c) for c in by]
    if order:
        wanted = [*keys, *(F.col(c) if isinstance(c, str) else c for c in order)]
        count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(count, *wanted).sortWithinPartitions(*wanted)
    placed = cut(df.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    counted = placed.groupBy(part, *by).agg(F.count(F.lit(1)).alias(n), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{n}{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select(F.col(part).alias(f"{part}_"), *[F.col(c).alias(f"{part}_{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"{n}{i}").over(before), F.lit(0)).alias(f"{n}{i}_") for i in ("", *range(len(sums)))])
    here = Window.partitionBy(part, *by).orderBy(at)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn(n, F.row_number().over(here) - 1).withColumns({f"{n}{i}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for i, c in enumerate(sums.values())})
    same = F.col(part) == F.col(f"{part}_")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{part}_{i}"))
    out = local.join(earlier, same)
    return out.select(*[c for c in df.columns], (F.col(n) + F.col(f"{n}_")).alias(rank), *[(F.col(f"{n}{i}") + F.col(f"{n}{i}_")).alias(name) for i, name in enumerate(sums)])


#: Up to so many rows a page is taken in order by itself; one further down goes by ranks.
SHALLOW = 10_000


def slice_of(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows offset to offset + limit (0: to the end) in the given order, in that order.

    A page near the beginning is gathered from the best rows of each task. Further down rows are numbered by range, so that no
    task or driver holds all rows before the page.
    """
    if limit and offset + limit <= SHALLOW:
        return rows.orderBy(*order).offset(offset).limit(limit)
    at = unused(rows, "_rank")
    place = F.col(at)
    ranked = running(rows, order, rank=at).where(place >= offset)
    return (ranked.where(place < offset + limit) if limit else ranked).orderBy(at).drop(at)
