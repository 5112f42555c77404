"""Streaming jobs against their batch forms."""

from pyspark.sql import functions as F

from loomlog.operators import normalise
from loomlog.sources.adapters import log_from_events
from loomlog.streaming import jobs


def test_ingest_and_incidents(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    m = log_from_events(e).withColumn("tool_use", F.transform("tool_use", lambda t: t.withField("input", F.lit('{"command": "git reset --hard"}'))))
    src = str(tmp_path / "src")
    m.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(m.schema).parquet(src)
    jobs.ingest(stream, jobs.live_incidents, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == normalise.events(m).where("tool = 'Bash'").count() > 0
    jobs.ingest(stream, jobs.live_incidents, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()


def test_dedup_in_stream(spark, tmp_path):
    rows = [(f"k{i % 5}" if i % 7 else None, f"2025-01-01 00:00:{i % 60:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "call_key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.dedup_calls(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    jobs.ingest(stream, lambda s: s, str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("call_key is not null").count() == 5 and out.where("call_key is null").count() == sum(k is None for k, _ in rows)


def test_merge_changed(spark):
    old = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "session_id string, line_no long, v string")
    new = spark.createDataFrame([("s", 2, "B"), ("s", 3, "c"), ("s", 3, "c")], "session_id string, line_no long, v string")
    assert sorted(tuple(x) for x in jobs.merge_changed(new, old).collect()) == [("s", 1, "a"), ("s", 2, "B"), ("s", 3, "c")]


def test_sessions_need_no_exchange_when_bucketed(spark, tmp_path):
    m = log_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    m.write.bucketBy(4, "agent", "session_id").sortBy("agent", "session_id", "message_index").mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("bucketed_messages")
    plan = normalise.previous_text(spark.table("bucketed_messages"))._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table bucketed_messages")
    assert "Exchange" not in plan


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def test_incidents_are_confirmed_in_later_batches(spark, tmp_path):
    """Against a loop, over micro-batches that cut the sessions anywhere."""
    import random

    from loomlog.schema import MESSAGES, conform

    r = random.Random(7)
    rows = []
    for s in range(30):
        for i in range(r.randint(1, 40)):
            command = r.choice(["ls", "ls", "git reset --hard", "rm -rf /tmp/x"])
            rows.append((f"s{s}", i, r.choice(["fine", "fine", "fine", "fine", "Sorry, I accidentally deleted it"]), command))
    flat = spark.createDataFrame(rows, "session_id string, message_index long, text string, command string")
    tool = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Bash").alias("name"), F.to_json(F.struct("command")).alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts")))
    m = conform(flat.withColumn("agent", F.lit("claude")).withColumn("role", F.lit("user")).withColumn("tool_use", tool), MESSAGES)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.conf.set(STORE, ROCKS)
    try:
        for lo in range(0, 40, 10):
            m.where((F.col("message_index") >= lo) & (F.col("message_index") < lo + 10)).coalesce(1).write.mode("append").parquet(src)
            stream = jobs.confirmed_incidents(spark.readStream.schema(m.schema).parquet(src))
            jobs.ingest(stream, lambda s: s, out, str(tmp_path / "state"), None).awaitTermination()
    finally:
        spark.conf.unset(STORE)
    want = set()
    by = {}
    for s, i, text, command in rows:
        by.setdefault(s, []).append((i, "accidentally" in text, command != "ls"))
    for s, said in by.items():
        for i, _, danger in said:
            near = [j - i for j, regret, _ in said if regret and i < j <= i + 6]
            if danger and (near or len(said) > i + 6):
                want.add((s, i, near[0] if near else None, bool(near)))
    got = [(x.session_id, x.message_index, x.reaction_offset, x.confirmed) for x in spark.read.parquet(out).collect()]
    assert len(got) == len(want) > 100 and set(got) == want and len({x[3] for x in got}) == 2


def test_the_same_batch_again_changes_nothing(spark, tmp_path):
    from loomlog.sources import tail

    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.jsonl").write_text("1\n2\n3\n")
    (src / "b.jsonl").write_text("x\n")

    def run():
        stream = tail.follow(spark, str(src), str(tmp_path / "log"))
        jobs.ingest_merged(stream, lambda d: d, out, str(tmp_path / "state")).awaitTermination()
        return sorted((x.file.rsplit("/", 1)[1], x.start, x.value) for x in jobs.merged(spark, out).collect())

    assert run() == [("a.jsonl", 0, "1"), ("a.jsonl", 2, "2"), ("a.jsonl", 4, "3"), ("b.jsonl", 0, "x")]
    with (src / "b.jsonl").open("a") as f:
        f.write("y\n")
    (src / "a.jsonl").write_text("new\n")  # shorter: replaced
    want = [("a.jsonl", 0, "new"), ("b.jsonl", 0, "x"), ("b.jsonl", 2, "y")]
    assert run() == want == run()
    again = spark.read.parquet(f"{out}/batch=1").collect()
    jobs.keep_batch(spark.createDataFrame(again, "file string, start long, size long, value string"), 1, out)
    assert run() == want
    assert jobs.compact(spark, out, str(tmp_path / "compacted")) == 1
    assert sorted((x.file.rsplit("/", 1)[1], x.start, x.value) for x in jobs.merged(spark, str(tmp_path / "compacted")).collect()) == want
