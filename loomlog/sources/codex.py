"""Rollout files: typed records whose payloads are messages, calls, outputs, reasoning and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import timestamp, title_text
from ..operators.normalise import carry_forward
from ..schema import MESSAGES, SESSIONS, conform
from . import common as C


def records(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their session id; of files with one id, the newest is read."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "rollout-*.jsonl").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")
    times = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed")).distinct()
    return records_of(lines, times)


def records_of(lines: DataFrame, times: DataFrame) -> DataFrame:
    """Lines (file, at, value) of files last changed at times (file, changed) as records."""
    rows = C.from_lines(lines)
    v = F.col("v")
    rows = rows.withColumn("type", C.string(v, "$.type")).withColumn("ptype", C.string(v, "$.payload.type"))
    ids = rows.groupBy("file").agg(C.first_in_order(F.when(F.col("type") == "session_meta", C.string(v, "$.payload.id")), F.col("line_no")).alias("session_id"))
    ids = ids.withColumn("session_id", F.coalesce("session_id", C.stem(F.col("file")))).join(times, "file")
    newest = Window.partitionBy("session_id").orderBy(F.desc("changed"), F.desc("file"))
    ids = ids.withColumn("n", F.row_number().over(newest)).where("n = 1").select("file", "session_id")
    return rows.join(ids, "file")


def _text(v: Column) -> Column:
    parts = F.filter(C.array(v, "$.payload.content"), lambda p: F.coalesce(C.string(p, "$.type"), F.lit("")).isin("input_text", "output_text", "text", ""))
    return C.strings(F.transform(parts, lambda p: F.nullif(C.string(p, "$.text"), F.lit(""))))


def noise(text: Column) -> Column:
    """Wrapper texts that are no conversation."""
    t = F.ltrim(text)
    out = F.lit(False)
    for p in D.SYSTEM_NOISE:
        out = out | t.startswith(p)
    return out


def dedup_user_texts(rows: DataFrame, order: str = "line_no", prefix: int = 256) -> DataFrame:
    """The first user text of each 256-character prefix in a session; other rows and empty texts all stay."""
    exempt = (F.col("role") != "user") | (F.col("text") == "")
    w = Window.partitionBy("session_id", F.when(exempt, F.col(order).cast("string")).otherwise(F.concat(F.lit("u"), F.left("text", F.lit(prefix))))).orderBy(order)
    return rows.withColumn("again", F.row_number().over(w)).where("again = 1").drop("again")


def carried_model(rows: DataFrame) -> DataFrame:
    """model: that of the latest turn context before each record."""
    told = F.when(F.col("type") == "turn_context", F.nullif(F.trim(C.string(F.col("v"), "$.payload.model")), F.lit("")))
    return carry_forward(rows, told, "model", "line_no", ("session_id",))


def messages(rows: DataFrame) -> DataFrame:
    v, p = F.col("v"), F.col("ptype")
    rows = carried_model(rows)
    item = F.col("type") == "response_item"
    told = item & (p == "message") & C.string(v, "$.payload.role").isin("user", "assistant")
    call = item & p.isin("function_call", "local_shell_call")
    search, think = item & (p == "web_search_call"), item & (p == "reasoning")
    output = item & p.isin("function_call_output", "local_shell_call_output")
    echo = (F.col("type") == "event_msg") & (p == "user_message") & (F.length(C.string(v, "$.payload.message")) > 10) & ~noise(C.string(v, "$.payload.message"))
    thought = F.nullif(C.strings(F.transform(C.array(v, "$.payload.summary"), lambda s: F.nullif(C.string(s, "$.text"), F.lit("")))), F.lit(""))
    rows = rows.withColumn("role", F.when(told, C.string(v, "$.payload.role")).when(call | search | (think & thought.isNotNull()), F.lit("assistant")).when(output, F.lit("tool")).when(echo, F.lit("user"))).where("role is not null")
    rows = rows.withColumn("text", F.when(told, _text(v)).when(echo, C.string(v, "$.payload.message")).otherwise(F.lit("")))
    rows = dedup_user_texts(rows)
    none = F.lit(None).cast("string")
    made = F.struct(F.lit(0).alias("ord"), F.when(search, F.lit("web_search")).otherwise(F.coalesce(F.nullif(C.string(v, "$.payload.name"), F.lit("")), p)).alias("name"), F.when(search, F.coalesce(F.to_json(F.try_variant_get(v, "$.payload.action", "variant")), F.lit(""))).otherwise(F.coalesce(C.as_text(v, "$.payload.arguments"), F.lit(""))).alias("input"), C.string(v, "$.payload.call_id").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))
    result = F.struct(F.lit(0).alias("ord"), F.coalesce(C.as_text(v, "$.payload.output"), F.lit("")).alias("content"), F.lit(None).cast("boolean").alias("is_error"), C.string(v, "$.payload.call_id").alias("tool_use_id"))
    images = F.transform(F.filter(C.array(v, "$.payload.content"), lambda x: C.string(x, "$.type") == "input_image"), lambda x: F.struct(F.lit("image").alias("kind"), none.alias("target"), F.lit("structured").alias("origin")))
    w = Window.partitionBy("session_id").orderBy("line_no")
    out = rows.select(
        F.lit("codex").alias("agent"), "session_id", (F.row_number().over(w) - 1).alias("message_index"), "role", "text",
        timestamp(C.string(v, "$.timestamp")).alias("ts"), F.when(think, thought).alias("thinking"),
        F.when(F.col("role") == "assistant", F.col("model")).alias("model"),
        F.when(call | search, F.array(made)).alias("tool_use"), F.when(output, F.array(result)).alias("tool_result"),
        F.when(told & (F.col("role") == "user"), images).alias("user_refs"),
    )
    out = out.withColumn("tool_result", F.transform("tool_result", lambda r: F.struct(r["ord"].alias("ord"), r["content"].alias("content"), r["is_error"].alias("is_error"), r["tool_use_id"].alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent"))))
    return conform(link_answers(out), MESSAGES)


def link_answers(rows: DataFrame) -> DataFrame:
    """qa of answered request_user_input calls: answers are keyed by the question's id; several are joined."""
    asked = rows.select("session_id", F.explode("tool_use").alias("t")).where("t.name = 'request_user_input'")
    asked = asked.select("session_id", F.col("t.tool_use_id").alias("id"), C.array(F.try_parse_json(F.col("t.input")), "$.questions").alias("questions"))
    told = rows.select("session_id", "message_index", F.explode("tool_result").alias("r")).select("session_id", "message_index", F.col("r.tool_use_id").alias("id"), F.col("r.content").alias("content"))
    both = told.join(asked, ["session_id", "id"]).select("session_id", "message_index", "content", F.explode("questions").alias("q")).withColumn("key", C.string(F.col("q"), "$.id"))
    # one path per question, so the answers are parsed to a map by key
    both = both.withColumn("given", F.from_json("content", "answers map<string,struct<answers:array<string>>>"))
    answer = F.coalesce(F.array_join(F.try_element_at(F.col("given.answers"), F.col("key"))["answers"], " | "), F.lit(""))
    qa = F.collect_list(C.asked(F.col("q"), answer))
    return rows.join(both.where(C.string(F.col("q"), "$.question").isNotNull()).groupBy("session_id", "message_index").agg(qa.alias("qa")), ["session_id", "message_index"], "left")


def last_counter(rows: DataFrame) -> DataFrame:
    """(session_id, tokens): a cumulative counter's last value."""
    base = "$.payload.info.total_token_usage."
    v = F.col("v")
    use = C.tokens(input=C.integer(v, base + "input_tokens"), output=C.integer(v, base + "output_tokens"), reasoning=C.integer(v, base + "reasoning_output_tokens"), cache_read=C.integer(v, base + "cached_input_tokens"), total=C.integer(v, base + "total_tokens"))
    told = rows.where("ptype = 'token_count'").withColumn("tokens", use)
    return told.groupBy("session_id").agg(F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("line_no"))).alias("tokens")).where("tokens is not null")


def sessions(rows: DataFrame) -> DataFrame:
    v, n = F.col("v"), F.col("line_no")
    meta = lambda path: C.first_in_order(F.when(F.col("type") == "session_meta", C.string(v, path)), n)
    first_user = F.when((F.col("ptype") == "message") & (C.string(v, "$.payload.role") == "user") & ~_text(v).startswith("<") & (F.trim(_text(v)) != ""), _text(v))
    echo = F.when(F.col("ptype") == "user_message", C.string(v, "$.payload.message"))
    is_message = (F.col("ptype") == "message") & C.string(v, "$.payload.role").isin("user", "assistant") & ~noise(_text(v))
    out = rows.groupBy("session_id", F.col("file").alias("path")).agg(
        F.coalesce(C.first_in_order(first_user, n), C.first_in_order(echo, n), meta("$.payload.cwd"), F.lit("Untitled")).alias("title"),
        F.max_by(timestamp(C.string(v, "$.timestamp")), F.when(timestamp(C.string(v, "$.timestamp")).isNotNull(), n)).alias("date"),
        F.count_if(is_message).alias("message_count"),
        meta("$.payload.cwd").alias("project_dir"), meta("$.payload.originator").alias("launch_surface"),
        F.coalesce(meta("$.payload.parent_thread_id"), meta("$.payload.source.subagent.thread_spawn.parent_thread_id")).alias("parent_uuid"),
        C.first_in_order(F.when(F.col("type") == "session_meta", C.integer(v, "$.payload.source.subagent.thread_spawn.depth")), n).cast("int").alias("spawn_depth"),
        C.distinct_in_order(F.when(F.col("type") == "turn_context", F.nullif(F.trim(C.string(v, "$.payload.model")), F.lit(""))), "line_no").alias("models"),
    )
    return conform(out.withColumn("agent", F.lit("codex")).withColumn("kind", F.when(F.col("parent_uuid").isNotNull(), "subagent")).withColumn("title", title_text(F.col("title"))), SESSIONS)


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, path)
    return sessions(rows), messages(rows)
