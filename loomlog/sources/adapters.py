"""Plain tables seen as session logs, and the store that all sources are written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MESSAGES, conform
from . import antigravity, claude, codex, opencode, pi

INGEST = {"claude": claude.ingest, "codex": codex.ingest, "opencode": opencode.ingest, "antigravity": antigravity.ingest, "pi": pi.ingest}

#: Event type -> tool of the call that an event stands for; other types are user turns.
EVENT_TOOLS = {"click": "read_file", "purchase": "Edit", "error": "Bash"}


def log_from_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as messages."""
    return conform(conversations.select(F.lit("claude").alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("message_index"), "role", "text"), MESSAGES)


def log_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) as messages: a user's events are a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    tool = F.create_map(*[F.lit(x) for pair in EVENT_TOOLS.items() for x in pair])[kind]
    path = F.concat(F.lit("src/m"), F.get_json_object("props", "$.k").cast("int") % 7, F.lit(".py"))
    given = F.to_json(F.struct(path.alias("file_path"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    call = F.struct(F.lit(0).alias("ord"), tool.alias("name"), given.alias("input"), F.col("event_id").cast("string").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))
    none = F.lit(None).cast("bigint")
    value = F.floor("value").cast("bigint")
    use = F.struct(none.alias("input"), none.alias("output"), none.alias("reasoning"), none.alias("cache_read"), none.alias("cache_write"), value.alias("total"))
    out = events.select(
        F.lit("claude").alias("agent"), F.col("user_id").cast("string").alias("session_id"), (F.row_number().over(w) - 1).cast("bigint").alias("message_index"),
        F.when(tool.isNull(), "user").otherwise("assistant").alias("role"), F.when(tool.isNull(), F.concat_ws(" ", "event_type", "props")).otherwise("").alias("text"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(tool.isNotNull(), F.array(call)).alias("tool_use"), F.when(tool.isNotNull(), use).alias("tokens"),
    )
    return conform(out, MESSAGES)


def ingest_all(spark: SparkSession, roots: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of all agents in one shape; roots: agent -> path."""
    sessions = messages = None
    for agent, root in roots.items():
        s, m = INGEST[agent](spark, root)
        sessions = s if sessions is None else sessions.unionByName(s)
        messages = m if messages is None else messages.unionByName(m)
    return sessions, messages


def save(df: DataFrame, name: str, buckets: int = 64, order: str = "message_index") -> None:
    """A table by agent, bucketed by session: windows and joins over sessions then need no exchange."""
    sort = ["session_id", *([order] if order in df.columns else [])]
    df.write.partitionBy("agent").bucketBy(buckets, "session_id").sortBy(*sort).mode("overwrite").saveAsTable(name)
