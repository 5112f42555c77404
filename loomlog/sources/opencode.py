"""Sessions kept in three tables: session, message, part (exported as Parquet, or read over JDBC by the caller)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import title_text
from ..schema import MESSAGES, SESSIONS, conform
from . import common as C


def _kind(p: Column) -> Column:
    return C.string(p["v"], "$.type")


def _of(kind: str, made) -> Column:
    return F.transform(F.filter("parts", lambda p: _kind(p) == kind), made)


def _compact(v: Column) -> Column:
    """File metadata without contents: names, types and counts only."""
    names = F.transform(C.array(v, "$.files"), lambda f: F.struct(C.string(f, "$.path").alias("path"), C.integer(f, "$.added").alias("added"), C.integer(f, "$.removed").alias("removed")))
    return F.to_json(F.struct(C.string(v, "$.filename").alias("filename"), C.string(v, "$.mime").alias("mime"), C.string(v, "$.hash").alias("hash"), F.when(F.size(names) > 0, names).alias("files")))


def messages(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    # a variant can't be sorted, so order by time and id of the raw row
    grouped = part.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(F.col("time_created").alias("at"), F.col("id").alias("pid"), F.col("data").alias("data")))).alias("raw"))
    grouped = grouped.withColumn("parts", F.transform("raw", lambda r: F.struct(r["at"].alias("at"), F.try_parse_json(r["data"]).alias("v"))))
    m = message.join(session.select(F.col("id").alias("session_id")), "session_id", "left_semi").join(grouped.withColumnRenamed("message_id", "id"), "id", "left")
    m = m.withColumn("v", F.try_parse_json("data"))
    v = F.col("v")
    role = C.string(v, "$.role")
    none = F.lit(None).cast("string")
    m = m.withColumn("parts", F.coalesce("parts", F.filter(F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("variant").alias("v"))), lambda x: F.lit(False))))
    tool_input = lambda p: F.coalesce(F.to_json(F.try_variant_get(p["v"], "$.state.input", "variant")), F.lit(""))
    calls = _of("tool", lambda p, i: F.struct(i.alias("ord"), C.string(p["v"], "$.tool").alias("name"), tool_input(p).alias("input"), C.string(p["v"], "$.callID").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts")))
    files = F.transform(F.filter("parts", lambda p: _kind(p).isin("file", "patch")), lambda p, i: F.struct((i + 1000).alias("ord"), _kind(p).alias("name"), _compact(p["v"]).alias("input"), none.alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts")))
    done = F.filter("parts", lambda p: (_kind(p) == "tool") & (C.as_text(p["v"], "$.state.output").isNotNull() | (C.string(p["v"], "$.state.status") == "error")))
    results = F.transform(done, lambda p, i: F.struct(i.alias("ord"), F.coalesce(C.as_text(p["v"], "$.state.output"), C.string(p["v"], "$.state.error"), F.lit("")).alias("content"), (C.string(p["v"], "$.state.status") == "error").alias("is_error"), C.string(p["v"], "$.callID").alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent")))
    asked = _of("tool", lambda p: F.when(C.string(p["v"], "$.tool") == "question", F.struct(C.array(p["v"], "$.state.input.questions").alias("qs"), C.array(p["v"], "$.state.metadata.answers").alias("as"))))
    # answers stand in a list beside the questions
    qa = F.flatten(F.transform(F.array_compact(asked), lambda x: F.transform(F.filter(x["qs"], lambda q: C.string(q, "$.question").isNotNull()), lambda q, i: C.asked(q, F.coalesce(C.chosen(F.get(x["as"], i), "$"), F.lit(""))))))
    refs = _of("file", lambda p: F.struct(F.when(C.string(p["v"], "$.mime").startswith("image/"), F.lit("image")).otherwise(F.lit("attachment")).alias("kind"), C.string(p["v"], "$.filename").alias("target"), F.lit("structured").alias("origin")))
    usage = C.tokens(input=C.integer(v, "$.tokens.input"), output=C.integer(v, "$.tokens.output"), reasoning=C.integer(v, "$.tokens.reasoning"), cache_read=C.integer(v, "$.tokens.cache.read"), cache_write=C.integer(v, "$.tokens.cache.write"))
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    out = m.where(role.isin("user", "assistant")).select(
        F.lit("opencode").alias("agent"), "session_id", (F.row_number().over(w) - 1).alias("message_index"), role.alias("role"),
        C.strings(_of("text", lambda p: F.nullif(C.string(p["v"], "$.text"), F.lit("")))).alias("text"),
        F.timestamp_millis(F.coalesce(F.array_min(F.transform("parts", lambda p: p["at"])), F.col("time_created"))).alias("ts"),
        F.nullif(C.strings(_of("reasoning", lambda p: F.nullif(C.string(p["v"], "$.text"), F.lit("")))), F.lit("")).alias("thinking"),
        F.when(role == "assistant", C.model_name(v, "$.modelID")).alias("model"),
        F.when(role == "assistant", F.concat(calls, files)).otherwise(calls).alias("tool_use"), results.alias("tool_result"),
        F.when(F.size(qa) > 0, qa).alias("qa"), F.when(role == "user", refs).alias("user_refs"), F.when(role == "assistant", usage).alias("tokens"),
    )
    return conform(out, MESSAGES)


def sessions(session: DataFrame, told: DataFrame) -> DataFrame:
    counts = told.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), C.distinct_in_order(F.col("model"), "message_index").alias("models"))
    s = session.join(counts, session.id == counts.session_id, "left")
    return conform(s.select(F.lit("opencode").alias("agent"), F.col("id").alias("session_id"), title_text(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))).alias("title"), F.timestamp_millis(F.coalesce("time_updated", "time_created")).alias("date"), F.coalesce("message_count", F.lit(0)).alias("message_count"), F.nullif("parent_id", F.lit("")).alias("parent_uuid"), F.when(F.nullif("parent_id", F.lit("")).isNotNull(), "subagent").alias("kind"), F.col("directory").alias("project_dir"), "models"), SESSIONS)


def ingest(spark: SparkSession, *roots: str) -> tuple[DataFrame, DataFrame]:
    """Several roots may hold a session; the first one's copy is read."""
    tables = {}
    for i, root in enumerate(roots):
        for name in ("session", "message", "part"):
            df = spark.read.parquet(f"{root}/{name}.parquet").withColumn("root", F.lit(i))
            tables[name] = tables[name].unionByName(df, allowMissingColumns=True) if name in tables else df
    best = tables["session"].groupBy(F.col("id").alias("sid")).agg(F.min("root").alias("first_root"))
    session = tables["session"].join(best, (F.col("id") == F.col("sid")) & (F.col("root") == F.col("first_root"))).drop("sid", "first_root")
    own = lambda t: tables[t].join(best, (F.col("session_id") == F.col("sid")) & (F.col("root") == F.col("first_root"))).drop("sid", "first_root")
    told = messages(session, own("message"), own("part"))
    return sessions(session, told), told
