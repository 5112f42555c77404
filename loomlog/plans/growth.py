"""Registered queries over real files that grow, and over streams of several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import common as C
from ..sources import tail
from ..sources.files import write_files
from ..streaming import jobs
from ..tables import cut, shared_folder
from .more import _talk
from .queries import LOG, register, table

FILES, BEFORE = 8, 3
HOSTILE = ("", "not json", "[1, 2]", '"text"', '{"conv_id": ')


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df)}/files-{uuid.uuid4().hex}"


def _lines(spark, sf_dir) -> DataFrame:
    """Conversations as JSON lines of a few files: early turns come first, hostile lines in between, later ones once the files have grown."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    late = F.col("turn") >= BEFORE
    rows = c.select(F.concat(F.lit("log"), F.col("conv_id") % FILES, F.lit(".jsonl")).alias("file"), F.struct(late.alias("late"), "conv_id", "turn").alias("at"), line.alias("value"))
    hostile = F.element_at(F.array(*map(F.lit, HOSTILE)), (F.col("at.conv_id") % len(HOSTILE) + 1).cast("int"))
    return rows.withColumn("value", F.when(F.col("at.turn") % 2 == 0, F.concat(hostile, F.lit("\r\n"), "value", F.lit("\n"))).otherwise(F.concat("value", F.lit("\n"))))


def _early(rows: DataFrame) -> DataFrame:
    """What the files hold at first: the early lines and half of the line that is being written."""
    first = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    half = rows.where("at.late").withColumn("n", first).where("n = 1").select("file", "at", F.expr("left(value, length(value) - 9)").alias("value"))
    return rows.where("not at.late").unionByName(half)


@register(f"""SELECT conv_id, turn, length(text) AS chars, CASE WHEN turn < {BEFORE} THEN 1 ELSE 2 END AS run,
row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY turn >= {BEFORE}, conv_id, turn) AS line FROM conversations""")
def tail_growth(spark, sf_dir):
    """Files that grow between two reads: each line once, in the read in which its newline came, in the file's order over small splits."""
    rows = cut(_lines(spark, sf_dir))
    at = _folder(rows)
    write_files(_early(rows), at, end="").count()
    first, offsets = tail.added(spark, at, split=4_096)
    first, offsets = cut(first), cut(offsets)
    write_files(rows, at, end="").count()
    second, _ = tail.added(spark, at, offsets, split=4_096)
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    read = C.from_lines(both.select("file", F.struct("start", "run").alias("at"), "value"), keep=("at",)).select("file", "at.*", "v")
    read = read.select("file", "start", "run", C.integer(F.col("v"), "$.conv_id").alias("conv_id"), C.integer(F.col("v"), "$.turn").alias("turn"), F.length(C.string(F.col("v"), "$.text")).alias("chars"))
    line = F.row_number().over(Window.partitionBy("file").orderBy("start"))
    return read.select("conv_id", "turn", F.col("chars").cast("long").alias("chars"), "run", line.cast("long").alias("line"))


@register("SELECT conv_id, turn, role, text FROM conversations")
def stream_merged(spark, sf_dir):
    """The same files followed by a stream and merged by file and place. The last micro-batch comes again, which changes nothing."""
    rows = cut(_lines(spark, sf_dir))
    at = _folder(rows)
    out = f"{at}-table"

    def parsed(lines: DataFrame) -> DataFrame:
        read = C.from_lines(lines.select("file", F.col("start").alias("at"), "value"), keep=("at",)).withColumnRenamed("at", "start")
        v = F.col("v")
        return read.select("file", "start", C.integer(v, "$.conv_id").alias("conv_id"), C.integer(v, "$.turn").alias("turn"), C.string(v, "$.role").alias("role"), C.string(v, "$.text").alias("text"))

    for part in (_early(rows), rows):
        write_files(part, at, end="").count()
        jobs.ingest_merged(tail.follow(spark, at, f"{at}-log", split=65_536), parsed, out, f"{at}-state").awaitTermination()
    again = cut(spark.read.parquet(f"{out}/batch=1"))
    jobs.keep_batch(again, 1, out)
    return jobs.merged(spark, out).select("conv_id", "turn", "role", "text")


@register(f"""WITH {LOG}, b AS (SELECT session_id, seq FROM log WHERE tool = 'Bash' AND k % 4 <= 1), r AS (SELECT session_id, seq AS pos FROM log WHERE tool = 'Edit'), l AS (SELECT session_id, max(seq) AS last FROM log GROUP BY 1),
f AS (SELECT b.session_id, b.seq, last, min(pos) FILTER (WHERE pos BETWEEN b.seq + 1 AND b.seq + 6) - b.seq AS reaction_offset FROM b JOIN l USING (session_id) LEFT JOIN r ON r.session_id = b.session_id GROUP BY b.session_id, b.seq, last)
SELECT session_id, seq AS message_index, reaction_offset, reaction_offset IS NOT NULL AS confirmed FROM f WHERE reaction_offset IS NOT NULL OR last >= seq + 6""")
def stream_confirmed(spark, sf_dir):
    """Dangerous commands of a stream, confirmed by regret in whichever of two micro-batches it comes; untold while either may still come."""
    m = cut(_talk(spark, sf_dir))
    at = _folder(m)
    store = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for early in (True, False):
            m.where((F.col("message_index") < 37) == early).write.mode("append").parquet(f"{at}/in")
            stream = jobs.confirmed_incidents(spark.readStream.schema(m.schema).parquet(f"{at}/in"))
            jobs.ingest(stream, lambda s: s, f"{at}/data", f"{at}/state", None).awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(store)
        else:
            spark.conf.set(store, was)
    return spark.read.parquet(f"{at}/data").select("session_id", "message_index", "reaction_offset", "confirmed")
