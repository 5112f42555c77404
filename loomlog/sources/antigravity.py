"""One directory per session: a transcript of typed records, and perhaps a plan file beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, timestamp, title_text
from ..schema import MESSAGES, SESSIONS, conform
from . import common as C

#: Transcript names by preference; the first with usable records is read.
NAMES = ("transcript.jsonl", "overview.txt")


def _session(file: Column) -> Column:
    """The directory above .system_generated, or the file's own."""
    inside = F.regexp_extract(file, r"([^/]+)/\.system_generated/", 1)
    return F.when(inside != "", inside).otherwise(C.folder(file))


def records(spark: SparkSession, path: str) -> DataFrame:
    """path: the directory that holds the session directories."""
    # named in full, as directories with a leading dot are passed over in listings
    places = [f"{d}{n}" for d in (".system_generated/logs/", "") for n in NAMES]
    return records_of(C.read_files(spark, f"{path.rstrip('/')}/*/{{{','.join(places)}}}"))


def records_of(lines: DataFrame) -> DataFrame:
    """Lines (file, at, value) as records."""
    rows = C.from_lines(lines).withColumn("session_id", _session(F.col("file")))
    v = F.col("v")
    side = F.upper(F.coalesce(C.string(v, "$.source"), C.string(v, "$.type"), F.lit("")))
    kind = F.upper(F.coalesce(C.string(v, "$.type"), F.lit("")))
    role = F.when(side.startswith("USER") | kind.startswith("USER"), "user").when(side.startswith("MODEL") | kind.startswith("MODEL"), "assistant")
    rows = rows.withColumn("role", role).where("role is not null")
    rank = F.array_position(F.array(*map(F.lit, NAMES)), F.element_at(F.split("file", "/"), -1))
    rows = rows.withColumn("rank", rank)
    best = Window.partitionBy("session_id")
    return rows.withColumn("best", F.min("rank").over(best)).where("rank = best").drop("best", "rank")


def messages(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    one = F.when(C.string(v, "$.tool_name").isNotNull(), F.array(v)).otherwise(C.array(v, "$.tool_calls"))
    parts = F.filter(C.array(v, "$.content"), lambda p: C.string(p, "$.type").isin("tool_call", "tool_use", "functionCall"))
    calls = F.concat(one, parts)
    name = lambda p: F.coalesce(C.string(p, "$.name"), C.string(p, "$.tool_name"), C.string(p, "$.functionCall.name"))
    given = lambda p: F.coalesce(C.as_text(p, "$.args"), C.as_text(p, "$.input"), C.as_text(p, "$.arguments"), C.as_text(p, "$.functionCall.args"), F.lit(""))
    text = F.coalesce(C.string(v, "$.content"), C.strings(F.transform(C.array(v, "$.content"), lambda p: F.nullif(C.string(p, "$.text"), F.lit("")))), F.lit(""))
    w = Window.partitionBy("session_id").orderBy("line_no")
    out = rows.select(F.lit("antigravity").alias("agent"), "session_id", (F.row_number().over(w) - 1).alias("message_index"), "role", text.alias("text"), timestamp(F.coalesce(C.string(v, "$.timestamp"), C.string(v, "$.created_at"))).alias("ts"), F.transform(calls, lambda p, i: F.struct(i.alias("ord"), name(p).alias("name"), given(p).alias("input"), C.string(p, "$.id").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))).alias("tool_use"))
    return conform(out, MESSAGES)


def plan_files(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, path, body) of the plan files."""
    with C.listed_together(spark):
        raw = spark.read.text(f"{path.rstrip('/')}/*/implementation_plan.md", wholetext=True)
    return raw.select(C.folder(F.col("_metadata.file_path")).alias("session_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def sessions(rows: DataFrame, told: DataFrame) -> DataFrame:
    first = F.min_by(F.when((F.col("role") == "user") & ~blank(F.col("text")) & ~F.col("text").startswith("<"), F.col("text")), F.when((F.col("role") == "user") & ~blank(F.col("text")) & ~F.col("text").startswith("<"), F.col("message_index")))
    s = told.groupBy("session_id").agg(F.coalesce(first, F.lit("Untitled")).alias("title"), F.max("ts").alias("date"), F.count(F.lit(1)).alias("message_count"))
    files = rows.groupBy("session_id").agg(F.min("file").alias("path"))
    return conform(s.join(files, "session_id").withColumn("agent", F.lit("antigravity")).withColumn("title", title_text(F.col("title"))), SESSIONS)


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, path)
    told = messages(rows)
    return sessions(rows, told), told
