"""Token accounting: exact where sources tell, estimated from characters where not, always labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_estimate
from ..schema import TOKENS
from .aggregate import TOKEN_FIELDS
from .normalise import SESSION, tool_kind


def one_per_call(rows: DataFrame, key: str = "call_key", order: str = "message_index") -> DataFrame:
    """The first row of each call; rows without a key all stay. Decide this before paging."""
    w = Window.partitionBy(*SESSION, F.coalesce(F.col(key), F.concat(F.lit("row "), F.col(order).cast("string")))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_totals(messages: DataFrame) -> DataFrame:
    """(agent, session_id, tokens): sums over calls, each counted once; a total of 0 is unknown."""
    once = one_per_call(messages.where("tokens is not null"))
    sums = once.groupBy(*SESSION).agg(*[F.sum(f"tokens.{f}").alias(f) for f in TOKEN_FIELDS])
    made = F.struct(*[F.col(f) for f in TOKEN_FIELDS[:-1]], F.nullif("total", F.lit(0)).alias("total")).cast(TOKENS)
    return sums.select(*SESSION, made.alias("tokens")).where("tokens.total is not null")


def last_counters(rows: DataFrame, counter: str, order: str) -> DataFrame:
    """(agent, session_id, total): the last value of a cumulative counter."""
    return rows.groupBy(*SESSION).agg(F.max_by(counter, F.when(F.col(counter).isNotNull(), F.col(order))).alias("total")).where("total is not null")


def buckets(messages: DataFrame) -> DataFrame:
    """(agent, session_id, bucket, chars, pieces): characters by user_turn, assistant_turn, thinking and tool kind."""
    own = messages.select(*SESSION, F.explode(F.array(
        F.struct(F.when(F.col("role") == "user", "user_turn").when(F.col("role") == "assistant", "assistant_turn").alias("bucket"), F.col("text").alias("x")),
        F.struct(F.lit("thinking").alias("bucket"), F.col("thinking").alias("x")),
    )).alias("b"))
    calls = messages.select(*SESSION, F.explode("tool_use").alias("t")).select(*SESSION, tool_kind(F.col("t.name")).alias("bucket"), F.col("t.input").alias("x"), F.col("t.tool_use_id").alias("tool_use_id"))
    told = messages.select(*SESSION, F.explode("tool_result").alias("r")).select(*SESSION, F.col("r.tool_use_id").alias("tool_use_id"), F.col("r.content").alias("x"))
    kinds = calls.where("tool_use_id is not null").groupBy(*SESSION, "tool_use_id").agg(F.min("bucket").alias("bucket"))
    told = told.join(kinds, [*SESSION, "tool_use_id"], "left").select(*SESSION, F.coalesce("bucket", F.lit("other")).alias("bucket"), "x")
    rows = own.select(*SESSION, "b.bucket", "b.x").unionByName(calls.select(*SESSION, "bucket", "x")).unionByName(told)
    rows = rows.where("bucket is not null and x <> ''")
    return rows.groupBy(*SESSION, "bucket").agg(F.sum(F.length("x")).alias("chars"), F.count(F.lit(1)).alias("pieces"))


def component_tokens(messages: DataFrame) -> DataFrame:
    """(agent, session_id, bucket, tokens): a quarter of a bucket's characters as if joined by line breaks."""
    return buckets(messages).select(*SESSION, "bucket", tokens_estimate(F.col("chars") + F.col("pieces") - 1).alias("tokens"))


def session_tokens(messages: DataFrame, sessions: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """(agent, session_id, tokens, token_source, estimator): exact, else estimated, else null, for every session."""
    exact = exact_totals(messages)
    if counters is not None:
        exact = exact.unionByName(counters)
    guess = component_tokens(messages).groupBy(*SESSION).agg(F.sum("tokens").alias("guess"))
    out = sessions.select(*SESSION).join(exact, list(SESSION), "left").join(guess, list(SESSION), "left")
    none = F.lit(None).cast("bigint")
    made = F.when(F.col("guess") > 0, F.struct(*[none.alias(f) for f in TOKEN_FIELDS[:-1]], F.col("guess").alias("total")))
    source = F.when(F.col("tokens").isNotNull(), "exact").when(F.col("guess") > 0, "estimated")
    return out.select(*SESSION, F.coalesce("tokens", made).alias("tokens"), source.alias("token_source"), F.when(source == "estimated", "chars/4").alias("estimator"))


def tree_tokens(tokens: DataFrame, sessions: DataFrame) -> DataFrame:
    """(agent, session_id, own, children, total): a session's tokens with those of its direct children; null where nothing is known."""
    t = tokens.select(*SESSION, F.col("tokens.total").alias("own"))
    kids = sessions.where("parent_uuid is not null").select("agent", "session_id", "parent_uuid").join(t, list(SESSION))
    kids = kids.groupBy("agent", F.col("parent_uuid").alias("session_id")).agg(F.sum("own").alias("children"))
    out = t.join(kids, list(SESSION), "left")
    return out.withColumn("total", F.when(F.col("own").isNotNull() | F.col("children").isNotNull(), F.coalesce("own", F.lit(0)) + F.coalesce("children", F.lit(0))))


def tree_components(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(agent, session_id, bucket, tokens) of sessions with their children; a parent with children drops its own task bucket."""
    own = component_tokens(messages)
    edges = sessions.where("parent_uuid is not null").select("agent", "session_id", "parent_uuid")
    parents = edges.select("agent", F.col("parent_uuid").alias("session_id")).distinct().withColumn("has", F.lit(True))
    mine = own.join(parents, list(SESSION), "left").where("has is null or bucket <> 'task'").drop("has")
    theirs = own.join(edges, list(SESSION)).select("agent", F.col("parent_uuid").alias("session_id"), "bucket", "tokens")
    return mine.unionByName(theirs).groupBy(*SESSION, "bucket").agg(F.sum("tokens").alias("tokens"))
