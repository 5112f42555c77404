"""Mergeable rollups: counts and sketches by day and label, kept as a table, from which metrics over any span are merged.

``aggregate`` counts distinct things exactly, for which each row is expanded once for each metric. A rollup instead keeps a
small sketch of each set, so many distinct counts cost one pass without expansion, and new days are added without
reading the old ones. Sketches estimate: see ``error``. Where a number must be exact, ask for exact sets: then the
rollup keeps one row for each distinct value instead.

Defined cases: null and blank values are in no set; rows without time are of day null; labels that are null or empty are
(unknown), as in ``aggregate``; an empty table gives no rows; a day that is added twice counts its rows twice, so
replace days, don't add them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import group_key

#: Two to the power of this are the buckets of a sketch: 4 KB or so each, at most.
PRECISION = 12


def error(precision: int = PRECISION) -> float:
    """The standard error of an estimate, relative to the number; two of three estimates are within it."""
    return 1.04 / 2 ** (precision / 2)


def _value(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def rollup(rows: DataFrame, labels: Sequence[str], distinct: Sequence[str], sums: Sequence[str] = (), time: str = "ts", precision: int = PRECISION) -> DataFrame:
    """One row for each day and labels: rows, sum_<column> and set_<column>, a sketch of the column's distinct values."""
    keys = [F.to_date(time).alias("day"), *[group_key(F.col(c)).alias(c) for c in labels]]
    sketched = [F.hll_sketch_agg(_value(c), F.lit(precision)).alias(f"set_{c}") for c in distinct]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *sketched)


def merged(rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of a rollup by some of its columns (none: one row over all): rows, sums, and the estimated number of distinct values
    under the column's name."""
    sums = [c for c in rolled.columns if c.startswith("sum_")]
    sets = [c for c in rolled.columns if c.startswith("set_")]
    # sketches of one rollup have one precision; a union of others is allowed
    out = [F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums], *[F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True))).alias(c.removeprefix("set_")) for c in sets]]
    return rolled.groupBy(*by).agg(*out) if by else rolled.groupBy().agg(*out)


def exact_rollup(rows: DataFrame, labels: Sequence[str], distinct: Sequence[str], time: str = "ts") -> DataFrame:
    """(day, labels, metric, value, rows): each distinct value of each column once for each day and labels; metric null counts the rows."""
    keys = [F.to_date(time).alias("day"), *[group_key(F.col(c)).alias(c) for c in labels]]
    none = F.lit(None).cast("string")
    each = F.array(F.struct(none.alias("metric"), none.alias("value")), *[F.struct(F.lit(c).alias("metric"), _value(c).alias("value")) for c in distinct])
    named = [*(f"`{c}`" for c in labels)]
    long = rows.select(*keys, F.explode(each).alias("x")).where("x.metric is null or x.value is not null")
    return long.groupBy("day", *named, "x.metric", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def merged_exact(rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n): the exact numbers of distinct values, and of rows under the metric ``rows``."""
    once = rolled.groupBy(*by, "metric", "value").agg(F.sum("rows").alias("rows"))
    n = F.when(F.col("metric").isNull(), F.sum("rows")).otherwise(F.count("value"))
    return once.groupBy(*by, "metric").agg(n.alias("n")).withColumn("metric", F.coalesce("metric", F.lit("rows")))
