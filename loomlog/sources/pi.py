"""Session files with a header, a name, and message entries of typed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, timestamp, title_text
from ..schema import MESSAGES, SESSIONS, conform
from . import common as C


def records(spark: SparkSession, path: str) -> DataFrame:
    return records_of(C.read_lines(spark, path))


def records_of(lines: DataFrame) -> DataFrame:
    """Lines (file, at, value) as records."""
    rows = C.from_lines(lines).withColumn("type", C.string(F.col("v"), "$.type"))
    ids = rows.groupBy("file").agg(C.first_in_order(F.when(F.col("type") == "session", C.string(F.col("v"), "$.id")), F.col("line_no")).alias("session_id"))
    return rows.join(ids.where("session_id is not null"), "file")


def messages(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    rows = rows.where("type = 'message'").withColumn("said", C.string(v, "$.message.role")).where("said in ('user', 'assistant', 'toolResult')")
    blocks = C.array(v, "$.message.content")
    kind = lambda p: C.string(p, "$.type")
    text = F.coalesce(C.string(v, "$.message.content"), C.strings(F.transform(F.filter(blocks, lambda p: kind(p) == "text"), lambda p: F.nullif(C.string(p, "$.text"), F.lit("")))), F.lit(""))
    tool = F.col("said") == "toolResult"
    result = F.struct(F.lit(0).alias("ord"), text.alias("content"), C.flag(v, "$.message.isError").alias("is_error"), C.string(v, "$.message.toolCallId").alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent"))
    use = "$.message.usage."
    usage = C.tokens(input=C.integer(v, use + "input"), output=C.integer(v, use + "output"), cache_read=C.integer(v, use + "cacheRead"), cache_write=C.integer(v, use + "cacheWrite"), total=C.integer(v, use + "totalTokens"))
    w = Window.partitionBy("session_id").orderBy("line_no")
    out = rows.select(
        F.lit("pi").alias("agent"), "session_id", (F.row_number().over(w) - 1).alias("message_index"), F.when(tool, "tool").otherwise(F.col("said")).alias("role"),
        F.when(tool, F.lit("")).otherwise(text).alias("text"), F.coalesce(timestamp(C.string(v, "$.timestamp")), C.millis(v, "$.message.timestamp")).alias("ts"),
        F.nullif(C.strings(F.transform(F.filter(blocks, lambda p: kind(p) == "thinking"), lambda p: F.nullif(C.string(p, "$.thinking"), F.lit("")))), F.lit("")).alias("thinking"),
        F.when(F.col("said") == "assistant", C.model_name(v, "$.message.model")).alias("model"),
        F.transform(F.filter(blocks, lambda p: kind(p) == "toolCall"), lambda p, i: F.struct(i.alias("ord"), C.string(p, "$.name").alias("name"), F.coalesce(C.as_text(p, "$.arguments"), F.lit("")).alias("input"), C.string(p, "$.id").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))).alias("tool_use"),
        F.when(tool, F.array(result)).alias("tool_result"), F.when(F.col("said") == "assistant", usage).alias("tokens"),
    )
    return conform(out, MESSAGES)


def sessions(rows: DataFrame) -> DataFrame:
    v, n = F.col("v"), F.col("line_no")
    content = C.string(v, "$.message.content")
    blocks = C.strings(F.transform(F.filter(C.array(v, "$.message.content"), lambda p: C.string(p, "$.type") == "text"), lambda p: C.string(p, "$.text")))
    said = F.coalesce(content, blocks)
    first = F.when((C.string(v, "$.message.role") == "user") & ~blank(said) & ~said.startswith("<"), said)
    when = F.coalesce(timestamp(C.string(v, "$.timestamp")), C.millis(v, "$.message.timestamp"))
    head = lambda p: C.first_in_order(F.when(F.col("type") == "session", C.string(v, p)), n)
    name = F.when(F.col("type") == "session_info", F.nullif(F.trim(C.string(v, "$.name")), F.lit("")))
    s = rows.groupBy("session_id", F.col("file").alias("path")).agg(
        F.coalesce(F.max_by(name, F.when(name.isNotNull(), n)), C.first_in_order(first, n), head("$.cwd"), F.lit("Untitled")).alias("title"), F.max(when).alias("date"),
        F.count_if((F.col("type") == "message") & C.string(v, "$.message.role").isin("user", "assistant")).alias("message_count"), head("$.cwd").alias("project_dir"), head("$.parentSession").alias("parent"),
        C.distinct_in_order(F.when(C.string(v, "$.message.role") == "assistant", C.model_name(v, "$.message.model")), "line_no").alias("models"),
    )
    newest = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("date"), "path")
    s = s.withColumn("n", F.row_number().over(newest)).where("n = 1")
    return conform(s.withColumn("agent", F.lit("pi")).withColumn("parent_uuid", C.stem(F.col("parent"))).withColumn("title", title_text(F.col("title"))), SESSIONS)


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, path)
    return sessions(rows), messages(rows)
