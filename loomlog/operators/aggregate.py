"""Grouped metrics over any rows, with totals over the whole input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"
NO_SUBAGENTS = "no sub-session among the rows: the split by kind has one side only"
TOKEN_FIELDS = ("input", "output", "reasoning", "cache_read", "cache_write", "total")


def _strip(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def metric(name: str, columns: Sequence[str]) -> list[Column]:
    """Aggregate columns of a named metric over rows with the given columns."""
    has = lambda c: c in columns
    if name == "count":
        return [F.count(F.lit(1)).alias("count")]
    if name == "sessions":
        ids = F.count_distinct("session_id") if has("session_id") else F.lit(0)
        known = F.count("session_id") if has("session_id") else F.lit(0)
        rest = F.sum(F.coalesce("sessions", F.lit(0))) if has("sessions") else F.count(F.lit(1))
        return [F.when(known > 0, ids).otherwise(rest).alias("sessions")]
    if name == "edits":
        return [(F.sum(F.coalesce("edits", F.lit(1))) if has("edits") else F.count(F.lit(1))).alias("edits")]
    if name == "intents":
        return [F.count_distinct(_strip(F.col("intent"))).alias("intents") if has("intent") else F.lit(0).cast("bigint").alias("intents")]
    if name == "agents":
        return [F.sort_array(F.collect_set(_strip(F.col("agent")))).alias("agents")]
    if name == "messages":
        names = [c for c in ("messages", "message_count") if has(c)]
        return [F.coalesce(F.sum(F.coalesce(*names)) if names else F.lit(0), F.lit(0)).cast("bigint").alias("messages")]
    if name == "files":
        return [F.count_distinct(F.nullif("file", F.lit(""))).alias("files")]
    if name == "tokens":
        measured = F.col("tokens.total").isNotNull()
        sums = [F.sum(F.when(measured, F.col(f"tokens.{f}"))).alias(f"tokens_{f}") for f in TOKEN_FIELDS]
        source = F.col("token_source") if has("token_source") else F.when(measured, "exact")
        kinds = [F.count_if(measured & (source == k)).alias(f"tokens_{k}") for k in ("exact", "estimated")]
        return [*sums, *kinds, F.count_if(~measured | source.isNull()).alias("tokens_unknown")]
    raise ValueError(f"unknown metric {name!r}")


RANKS = {"edits": ("edits", "sessions", "count"), "stats": ("sessions", "edits")}


def group_key(key: Column, is_list: bool = False) -> Column:
    """A label: empty and null become (unknown); each item of a list is a label, an empty list none."""
    return F.explode(key) if is_list else F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit(UNKNOWN))


def _measure(rows: DataFrame, keys: list[str], metrics: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """The metrics of rows by keys. A list column of intents is counted from a row per intent, never gathered in one row."""
    listed = "intents" in metrics and "intents" in rows.columns
    own = [m for m in metrics if m != "intents" or not listed]
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    out = grouped.agg(*[c for m in own for c in metric(m, rows.columns)], *more, F.count(F.lit(1)).alias("_n"))
    if listed:
        one = [F.col("intent")] if "intent" in rows.columns else []
        each = rows.select(*keys, F.explode(F.concat(F.array(*one).cast("array<string>"), F.coalesce("intents", F.array().cast("array<string>")))).alias("intent"))
        told = (each.groupBy(*keys) if keys else each.groupBy()).agg(F.count_distinct(_strip(F.col("intent"))).alias("intents"))
        joined = out.join(told, keys, "left") if keys else out.crossJoin(told)  # without keys: one row each
        out = joined.withColumn("intents", F.coalesce("intents", F.lit(0)))
    return out.drop("_n")


def aggregate(rows: DataFrame, group_by: str | Column, metrics: Sequence[str] = ("count",), rank_by: str = "edits", top: int = 0) -> DataFrame:
    """One row per label with the metrics and its rank. Columns of the ranking that were not asked for are skipped."""
    if rank_by not in RANKS:
        raise ValueError(f"rank_by must be one of {', '.join(RANKS)}")
    key = F.col(group_by) if isinstance(group_by, str) else group_by
    listed = isinstance(group_by, str) and dict(rows.dtypes)[group_by].startswith("array")
    labelled = rows.withColumn("group", group_key(key, listed))
    out = _measure(labelled, ["group"], metrics)
    order = [F.desc(c) for c in RANKS[rank_by] if c in out.columns] + [F.asc("group")]
    out = out.orderBy(*order)
    return out.limit(top) if top else out


def totals(rows: DataFrame, metrics: Sequence[str] = ("count",), kind_split: bool = False) -> DataFrame:
    """The metrics over all rows, each counted once however many labels it has."""
    more = [F.coalesce(F.bool_or(F.col("kind") == "subagent"), F.lit(False)).alias("has_subagents")] if kind_split else []
    out = _measure(rows, [], metrics, more)
    return out.withColumn("note", F.when(~F.col("has_subagents"), F.lit(NO_SUBAGENTS))) if kind_split else out


def file_totals(edits: DataFrame, path: str = "/") -> DataFrame:
    """One row over all edits of the files that file_frequency() reads: files, edits, sessions, intents, agents."""
    rows = edits if path == "/" else edits.where(F.contains("file", F.lit(path)))
    return rows.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("edits"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(_strip(F.col("intent"))).alias("intents"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"))


def component_totals(rows: DataFrame, column: str = "components") -> DataFrame:
    """(component, tokens): sums of a map column of token buckets; absent ones stay absent."""
    return rows.select(F.explode(column).alias("component", "tokens")).groupBy("component").agg(F.sum("tokens").alias("tokens"))


def file_frequency(edits: DataFrame, path: str = "/", top: int = 8) -> DataFrame:
    """Files by edits, sessions, path: edits, distinct sessions and intents, agents. Totals don't depend on top."""
    rows = edits if path == "/" else edits.where(F.contains("file", F.lit(path)))
    out = rows.groupBy("file").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(_strip(F.col("intent"))).alias("intents"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"))
    out = out.orderBy(F.desc("edits"), F.desc("sessions"), F.asc("file"))
    return out.limit(top) if top else out
