"""Structured Streaming forms of ingest, dedup, stall detection and incidents, and the table that streams are merged into."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dictionaries as D
from ..functions.text import labels
from ..operators.audit import command_of, reaction
from ..operators.normalise import subtype


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partition: str | None = "agent"):
    """Write transform(stream) as Parquet, once per row, and stop when all there is has been read."""
    writer = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(partition) if partition else writer).trigger(availableNow=True).start()


def merge_changed(batch: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("session_id", "line_no")) -> DataFrame:
    """What a batch of re-read files adds to the rows kept: one row per key, the batch's where both have it."""
    old = existing.join(batch.select(*keys), list(keys), "left_anti")
    return old.unionByName(batch.dropDuplicates(list(keys)))


def dedup_calls(stream: DataFrame, key: str = "call_key", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each call within the watermark; rows without key all pass."""
    keyed = stream.withColumn("_key", F.coalesce(F.col(key), F.expr("uuid()")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


class Stalled(StatefulProcessor):
    """Tells once when a session has had no row for `after_ms` of processing time."""

    def __init__(self, after_ms: int = 600_000):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = max((int(x.timestamp() * 1000) for pdf in rows for x in pdf["ts"].dropna()), default=0)
        old = self.last.get() if self.last.exists() else (0, 0)
        if old[1]:
            self.handle.deleteTimer(old[1])
        timer = timerValues.getCurrentProcessingTimeInMs() + self.after_ms
        self.handle.registerTimer(timer)
        self.last.update((max(at, old[0]), timer))
        yield pd.DataFrame({"session_id": pd.Series(dtype=str), "last_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"session_id": [key[0]], "last_ms": [at]})

    def close(self) -> None:
        pass


def stalled_sessions(stream: DataFrame, after_ms: int = 600_000) -> DataFrame:
    """(session_id, last_ms) of sessions that fall silent. Needs the RocksDB state store."""
    return stream.select("session_id", "ts").groupBy("session_id").transformWithStateInPandas(Stalled(after_ms), "session_id string, last_ms long", "Append", "ProcessingTime")


def live_incidents(messages: DataFrame) -> DataFrame:
    """Dangerous shell commands of a stream of messages, with the patterns that fired."""
    calls = messages.select("agent", "session_id", "message_index", "ts", F.explode("tool_use").alias("t")).where(subtype(F.col("t.name")) == "bash")
    rows = calls.withColumn("command", command_of(F.col("t.input"))).withColumn("patterns", labels(F.col("command"), D.DANGER))
    return rows.where(F.size("patterns") > 0).drop("t")


def confirm_incidents(batch: DataFrame, messages: DataFrame, window: int = 6) -> DataFrame:
    """A batch of live incidents with the regret that followed within the next messages stored so far. For foreachBatch, which
    may see a later message only in a later batch: reread the last batches' incidents then."""
    keys = ["agent", "session_id", "message_index"]
    near = messages.join(batch.select("agent", "session_id").distinct(), ["agent", "session_id"], "left_semi")
    told = reaction(near, D.REGRET, window).select(*keys, "reaction")
    return batch.join(told, keys, "left").withColumn("confirmed", F.col("reaction").isNotNull())


class Confirm(StatefulProcessor):
    """Incidents of one session that wait for regret: state holds those with fewer than ``window`` messages after them, so at most
    ``window``, and where regret was said last. Each is told once: at the regret, after ``window`` messages, or when the session
    has been silent for ``after_ms`` (None: never)."""

    def __init__(self, window: int, after_ms: int | None):
        self.window, self.after_ms = window, after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, patterns string")
        self.seen = handle.getValueState("seen", "last long, regret string, timer long")

    def _told(self, key, rows) -> pd.DataFrame:
        at, patterns, regret = zip(*rows, strict=True) if rows else ((), (), ())
        return pd.DataFrame(
            {
                "agent": pd.Series([key[0]] * len(rows), dtype=object),
                "session_id": pd.Series([key[1]] * len(rows), dtype=object),
                "message_index": pd.Series(at, dtype="int64"),
                "patterns": pd.Series([p.split(",") for p in patterns], dtype=object),
                "reaction_offset": pd.Series([None if r is None else r - a for a, r in zip(at, regret, strict=True)], dtype="Int64"),
                "confirmed": pd.Series([r is not None for r in regret], dtype=bool),
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, regret, timer = self.seen.get() if self.seen.exists() else (-1, "", 0)
        waiting = [(x[0], x[1]) for x in self.open.get()] if self.open.exists() else []
        regrets = [int(x) for x in regret.split(",") if x]
        for pdf in rows:
            last = max(last, int(pdf["message_index"].max()))
            waiting += [(int(i), p) for i, p in zip(pdf["message_index"], pdf["patterns"], strict=True) if p]
            regrets += [int(i) for i in pdf.loc[pdf["regret"], "message_index"]]
        regrets.sort()
        told, kept = [], []
        for i, p in sorted(set(waiting)):
            # the first regret after it; rows of a batch come in any order
            j = bisect_right(regrets, i)
            if j < len(regrets) and regrets[j] <= i + self.window:
                told.append((i, p, regrets[j]))
            elif last >= i + self.window:
                told.append((i, p, None))
            else:
                kept.append((i, p))
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if kept:
            self.open.put(kept)
            if self.after_ms is not None:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.after_ms
                self.handle.registerTimer(timer)
        elif self.open.exists():
            self.open.clear()
        self.seen.update((last, ",".join(str(x) for x in regrets if x > last - self.window), timer))
        yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = [(x[0], x[1], None) for x in self.open.get()] if self.open.exists() else []
        self.open.clear()
        last, regret, _ = self.seen.get()
        self.seen.update((last, regret, 0))
        yield self._told(key, waiting)

    def close(self) -> None:
        pass


CONFIRMED = "agent string, session_id string, message_index long, patterns array<string>, reaction_offset long, confirmed boolean"


def confirmed_incidents(messages: DataFrame, window: int = 6, after_ms: int | None = None) -> DataFrame:
    """CONFIRMED: dangerous shell commands of a stream of messages with the regret said within the next ``window`` messages, in
    whichever micro-batch it comes. Messages of a session come in order between batches, in any order within one; the
    text stays in the JVM, only numbers and labels reach the state. With ``after_ms`` the stream goes on until it is
    stopped, as timers need batches without data. Needs the RocksDB state store."""
    bash = F.filter("tool_use", lambda t: subtype(t["name"]) == "bash")
    fired = F.array_distinct(F.flatten(F.transform(bash, lambda t: labels(command_of(t["input"]), D.DANGER))))
    rows = messages.select("agent", "session_id", "message_index", F.array_join(fired, ",").alias("patterns"), (F.size(labels(F.col("text"), D.REGRET)) > 0).alias("regret"))
    rows = rows.withColumn("patterns", F.coalesce("patterns", F.lit(""))).withColumn("regret", F.coalesce("regret", F.lit(False)))
    return rows.groupBy("agent", "session_id").transformWithStateInPandas(Confirm(window, after_ms), CONFIRMED, "Append", "None" if after_ms is None else "ProcessingTime")


def keep_batch(batch: DataFrame, number: int, out: str) -> None:
    """For foreachBatch: a micro-batch as a part of its own, named by its number. The same batch again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={number}")


def merged(spark: SparkSession, out: str, keys: tuple[str, ...] = ("file", "start"), begins: Column | None = None) -> DataFrame:
    """What ``keep_batch`` has kept: one row per key, the latest batch's. ``begins`` tells rows with which a file starts anew (by default
    those at start 0): what earlier batches had of a file that was replaced is gone."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").withColumn("batch", F.col("batch").cast("long"))
    begins = F.col("start") == 0 if begins is None else begins
    anew = rows.where(begins).groupBy(keys[0]).agg(F.max("batch").alias("_anew"))
    rows = rows.join(anew, keys[0], "left").where(F.coalesce(F.col("batch") >= F.col("_anew"), F.lit(True))).drop("_anew")
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_r")).select(*keys, "_r.*").drop("batch")


def compact(spark: SparkSession, out: str, to: str, keys: tuple[str, ...] = ("file", "start"), begins: Column | None = None) -> int:
    """The merged table as one part in another folder, numbered like the last batch in it, which is returned; later batches go there."""
    last = spark.read.option("basePath", out).parquet(f"{out}/batch=*").agg(F.max(F.col("batch").cast("long"))).head()[0]
    keep_batch(merged(spark, out, keys, begins), last, to)
    return last


def ingest_merged(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """transform(micro-batch) merged into ``out`` by file and start, each batch once, until all there is has been read."""
    return stream.writeStream.foreachBatch(lambda batch, number: keep_batch(transform(batch), number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_from(lines: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (file, line_no, ...) past each file's offset (file, line_no; none: from its start), and the new offsets."""
    new = lines.join(offsets.select("file", F.col("line_no").alias("_seen")), "file", "left").where(F.col("line_no") > F.coalesce("_seen", F.lit(0))).drop("_seen")
    told = lines.groupBy("file").agg(F.max("line_no").alias("line_no"))
    kept = offsets.select("file", "line_no").unionByName(told).groupBy("file").agg(F.max("line_no").alias("line_no"))
    return new, kept
