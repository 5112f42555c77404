"""Transcripts kept as one JSON-lines file per session, sub-sessions in files of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import blank, bound, json_path, said, timestamp, title_text
from ..schema import MESSAGES, SESSIONS, conform
from . import common as C


def _string(opened: Column, name: str) -> Column:
    return C.string(C.field(opened, name), "$")


def _integer(opened: Column, name: str) -> Column:
    return C.integer(C.field(opened, name), "$")


def _result_text(content: Column) -> Column:
    pieces = F.transform(C.array(content, "$"), lambda p: said(C.string(p, "$.text")))
    return F.coalesce(C.string(content, "$"), C.strings(pieces), F.lit(""))


def _is_error(part: Column, content: Column, record_result: Column) -> Column:
    first = F.get(F.filter(C.array(content, "$"), lambda p: C.string(p, "$.type") == "text"), F.lit(0))
    start = F.coalesce(C.string(content, "$"), C.string(first, "$.text"), F.lit(""))
    derived = start.startswith("<tool_use_error>") | F.coalesce(record_result.startswith("Error:"), F.lit(False))
    return F.coalesce(C.flag(C.field(part, "is_error"), "$"), derived)


def _subagent(told: Column) -> Column:
    """What a spawned session cost, as its parent was told; null without any figure."""
    made = F.struct(
        _string(told, "agentType").alias("agent_type"),
        C.model_name(C.field(told, "resolvedModel"), "$").alias("model"),
        _string(told, "status").alias("status"),
        _integer(told, "totalDurationMs").alias("duration_ms"),
        _integer(told, "totalToolUseCount").alias("tool_uses"),
        _integer(told, "totalTokens").alias("total_tokens"),
    )
    known = lambda m: m["agent_type"].isNotNull() | m["model"].isNotNull() | m["duration_ms"].isNotNull() | m["tool_uses"].isNotNull() | m["total_tokens"].isNotNull()
    return F.when(told.isNotNull(), bound(made, lambda m: F.when(known(m), m)))


def records(spark: SparkSession, path: str) -> DataFrame:
    return records_of(C.read_lines(spark, path))


def records_of(lines: DataFrame) -> DataFrame:
    """Lines (file, at, value) as records."""
    return C.from_lines(lines).withColumn("session_id", C.stem(F.col("file"))).withColumn("type", C.string(F.col("v"), "$.type"))


def messages(rows: DataFrame) -> DataFrame:
    """records() -> messages, with questions and answers linked."""
    top, message, told = F.col("top"), F.col("message"), F.col("told")
    w = Window.partitionBy("session_id").orderBy("line_no")
    # numbered first, so that records move as they are; what several columns read is a column of its own, looked up once
    rows = rows.where("type in ('user', 'assistant')").select("session_id", "type", "v", (F.row_number().over(w) - 1).alias("message_index"))
    rows = rows.withColumn("top", C.fields(F.col("v"))).withColumn("message", C.fields(C.field(top, "message"))).withColumn("told", C.fields(C.field(top, "toolUseResult")))
    rows = rows.withColumn("listed", json_path(C.field(message, "content"), "$", "array<variant>")).withColumn("usage", C.fields(C.field(message, "usage")))
    rows = rows.withColumn("plain", F.when(F.col("listed").isNull(), _string(message, "content")))
    rows = rows.withColumn("told_text", F.when(told.isNull(), _string(top, "toolUseResult"))).withColumn("cost", _subagent(told))
    rows = rows.withColumn("parts", F.transform("listed", lambda p: bound(C.fields(p), lambda x: F.struct(_string(x, "type").alias("kind"), x.alias("p")))))
    of_kind = lambda kind: F.filter(F.coalesce("parts", F.array().cast("array<struct<kind:string,p:map<string,variant>>>")), lambda x: x["kind"] == kind)
    texts = lambda kind: C.strings(F.transform(of_kind(kind), lambda x: said(_string(x["p"], kind))))
    rows = rows.withColumn("results", of_kind("tool_result"))
    usage = C.tokens(**{name: _integer(F.col("usage"), key) for name, key in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_write", "cache_creation_input_tokens"))})
    ids = F.struct(_string(message, "id").alias("id"), _string(top, "requestId").alias("request"))
    key = bound(ids, lambda k: F.when(k["id"].isNotNull() | k["request"].isNotNull(), F.concat_ws("|", F.coalesce(k["id"], F.lit("")), F.coalesce(k["request"], F.lit("")))))

    def use(x, i):
        p = x["p"]
        return F.struct(i.alias("ord"), _string(p, "name").alias("name"), C.as_text(C.field(p, "input"), "$").alias("input"), said(_string(p, "id")).alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))

    def result(x, i):
        p = x["p"]
        content = C.field(p, "content")
        return F.struct(i.alias("ord"), _result_text(content).alias("content"), _is_error(p, content, F.col("told_text")).alias("is_error"), said(_string(p, "tool_use_id")).alias("tool_use_id"), F.when(F.size("results") == 1, F.col("cost")).alias("subagent"))

    out = rows.select(
        F.lit("claude").alias("agent"),
        "session_id",
        "message_index",
        F.col("type").alias("role"),
        F.coalesce("plain", texts("text"), F.lit("")).alias("text"),
        bound(_string(top, "timestamp"), timestamp).alias("ts"),
        said(texts("thinking")).alias("thinking"),
        F.when(F.col("type") == "assistant", C.model_name(C.field(message, "model"), "$")).alias("model"),
        F.transform(of_kind("tool_use"), use).alias("tool_use"),
        F.transform("results", result).alias("tool_result"),
        F.when(F.col("type") == "user", F.transform(of_kind("image"), lambda x: F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit("structured").alias("origin")))).alias("user_refs"),
        F.when((F.col("type") == "assistant") & F.col("usage").isNotNull(), usage).alias("tokens"),
        F.when(F.col("type") == "assistant", key).alias("call_key"),
    )
    return conform(link_answers(out), MESSAGES)


ANSWER = r'"((?:[^"\\]|\\.)*)"\s*=\s*"((?:[^"\\]|\\.)*)"'


def link_answers(rows: DataFrame) -> DataFrame:
    """qa: for each answered question tool call, its questions with the answers of the result's "question"="answer" pairs.

    Quotes in either may be escaped by a backslash.
    """
    asked = rows.select("session_id", F.explode("tool_use").alias("t")).where("t.name = 'AskUserQuestion'")
    asked = asked.select("session_id", F.col("t.tool_use_id").alias("id"), C.array(F.try_parse_json(F.col("t.input")), "$.questions").alias("questions"))
    told = rows.select("session_id", "message_index", F.explode("tool_result").alias("r")).select("session_id", "message_index", F.col("r.tool_use_id").alias("id"), F.col("r.content").alias("content"))
    plain = lambda i: F.transform(F.regexp_extract_all("content", F.lit(ANSWER), F.lit(i)), lambda x: F.trim(F.replace(F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))))
    pairs = F.arrays_zip(plain(1).alias("q"), plain(2).alias("a"))
    both = told.join(asked, ["session_id", "id"]).withColumn("pairs", pairs)
    qa = F.transform("questions", lambda q: C.asked(q, F.get(F.filter("pairs", lambda p: p["q"] == F.trim(C.string(q, "$.question"))), F.lit(0))["a"]))
    linked = both.groupBy("session_id", "message_index").agg(F.flatten(F.collect_list(qa)).alias("qa"))
    return rows.join(linked, ["session_id", "message_index"], "left")


def sessions(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """records() -> one row per file. meta: (session_id, toolUseId, spawnDepth, agentType) of spawned sessions."""
    top, n = F.col("top"), F.col("line_no")
    message = C.fields(C.field(top, "message"))
    told = bound(_string(message, "content"), lambda x: F.when(~blank(x) & ~x.startswith("<"), x))
    rows = rows.withColumn("top", C.fields(F.col("v")))
    # each value is looked up once, though the totals name it more than once
    rows = rows.select(
        "session_id", F.col("file").alias("path"), "line_no", "type",
        F.when(F.col("type") == "user", told).alias("first_user"),
        _string(top, "customTitle").alias("custom"),
        _string(top, "aiTitle").alias("made"),
        bound(_string(top, "timestamp"), timestamp).alias("at"),
        _string(top, "cwd").alias("cwd"),
        _string(top, "entrypoint").alias("entrypoint"),
        said(_string(top, "sessionId")).alias("own_id"),
        F.coalesce(C.flag(C.field(top, "isSidechain"), "$"), F.lit(False)).alias("aside"),
        F.when(F.col("type") == "assistant", C.model_name(C.field(message, "model"), "$")).alias("model"),
    )
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), n))
    first = lambda x: C.first_in_order(F.col(x), n)
    out = rows.groupBy("session_id", "path").agg(
        F.coalesce(last("custom"), last("made"), first("first_user"), first("cwd"), F.lit("Untitled")).alias("title"),
        last("at").alias("date"),
        F.count_if(F.col("type").isin("user", "assistant")).alias("message_count"),
        first("cwd").alias("project_dir"),
        first("entrypoint").alias("surface"),
        first("own_id").alias("told_id"),
        F.bool_or("aside").alias("side"),
        C.distinct_in_order(F.col("model"), "line_no").alias("models"),
    )
    sub = F.col("path").contains("/subagents/") | (F.col("side") & F.col("session_id").startswith("agent-"))
    out = out.withColumn("kind", F.when(sub, "subagent"))
    out = out.withColumn("parent_uuid", F.when(F.col("path").contains("/subagents/"), C.folder(F.col("path"), 2)).when(sub, F.col("told_id")))
    if meta is not None:
        out = out.join(meta.select("session_id", F.col("toolUseId").alias("spawn_tool_use_id"), F.col("spawnDepth").cast("int").alias("spawn_depth"), F.col("agentType").alias("subagent_type")), "session_id", "left")
    out = out.withColumn("title", title_text(F.col("title"))).withColumn("agent", F.lit("claude")).withColumn("launch_surface", F.col("surface"))
    return conform(out, SESSIONS)


def spawn_meta(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar files of spawned sessions, keyed like their transcripts."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json").text(path, wholetext=True)
    return spawns_of(raw.select(F.col("_metadata.file_path").alias("p"), "value"))


def spawns_of(files: DataFrame) -> DataFrame:
    """spawn_meta() of files (p, value)."""
    v = F.try_parse_json("value")
    return files.select(F.regexp_replace(F.element_at(F.split("p", "/"), -1), r"\.meta\.json$", "").alias("session_id"), C.string(v, "$.toolUseId").alias("toolUseId"), C.integer(v, "$.spawnDepth").alias("spawnDepth"), C.string(v, "$.agentType").alias("agentType"))


def repair_parents(all_sessions: DataFrame, all_messages: DataFrame) -> DataFrame:
    """A deeper spawned session's parent is the session that made the spawn call, first emitter first; never itself."""
    calls = all_messages.select("session_id", "message_index", F.explode("tool_use").alias("t")).where(F.lower("t.name").isin(*D.TASK_NAMES) & F.col("t.tool_use_id").isNotNull())
    emitter = calls.groupBy(F.col("t.tool_use_id").alias("spawn_tool_use_id")).agg(F.min(F.struct("session_id", "message_index"))["session_id"].alias("emitter"))
    deep = F.col("emitter").isNotNull() & (F.coalesce("spawn_depth", F.lit(99)) > 1) & (F.col("emitter") != F.col("session_id"))
    return all_sessions.join(emitter, "spawn_tool_use_id", "left").withColumn("parent_uuid", F.when(deep, F.col("emitter")).otherwise(F.col("parent_uuid"))).drop("emitter")


def desktop_meta(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, d_title, d_dir, d_date): a desktop client's own record of sessions; the last path wins."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return desktop_of(raw.select(F.col("_metadata.file_path").alias("p"), "value"))


def desktop_of(files: DataFrame) -> DataFrame:
    """desktop_meta() of files (p, value)."""
    raw, v = files.withColumn("v", F.try_parse_json("value")), F.col("v")
    key = F.coalesce(F.nullif(C.string(v, "$.cliSessionId"), F.lit("")), C.string(v, "$.sessionId"))
    rows = raw.select(key.alias("session_id"), C.string(v, "$.title").alias("d_title"), F.coalesce(C.string(v, "$.originCwd"), C.string(v, "$.cwd")).alias("d_dir"), F.coalesce(C.millis(v, "$.lastActivityAt"), C.millis(v, "$.createdAt")).alias("d_date"), C.model_name(v, "$.model").alias("d_model"), "p")
    return rows.where("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct("d_title", "d_dir", "d_date", "d_model"), "p").alias("x")).select("session_id", "x.*")


def overlay_desktop(all_sessions: DataFrame, meta: DataFrame) -> DataFrame:
    """Sessions of both roots: the desktop title wins, the transcript's directory wins; without transcript, no messages."""
    s = all_sessions.join(meta, "session_id", "full_outer")
    s = s.withColumn("agent", F.coalesce("agent", F.lit("claude"))).withColumn("title", title_text(F.coalesce("d_title", "title", F.lit("Untitled")))).withColumn("project_dir", F.coalesce("project_dir", "d_dir")).withColumn("date", F.coalesce("date", "d_date")).withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    s = s.withColumn("models", F.when(F.size("models") > 0, F.col("models")).when(F.col("d_model").isNotNull(), F.array("d_model"))).withColumn("launch_surface", F.coalesce("launch_surface", F.when(F.coalesce("d_title", "d_dir", F.col("d_date").cast("string")).isNotNull(), "desktop")))
    return conform(s, SESSIONS)


def ingest(spark: SparkSession, path: str, desktop: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, path)
    told = messages(rows)
    found = repair_parents(sessions(rows, spawn_meta(spark, path)), told)
    return conform(overlay_desktop(found, desktop_meta(spark, desktop)) if desktop else found, SESSIONS), told
