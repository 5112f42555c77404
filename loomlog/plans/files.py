"""Registered queries over trees of real log files, and of rules that such files bring up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, normalise, query, search
from ..schema import MESSAGES, SESSIONS, conform
from ..sources import antigravity, claude, common, opencode
from ..sources.files import write_files
from ..tables import shared_folder
from .queries import CONV, conversation_log, register, table


def _place(df: DataFrame) -> str:
    return f"{shared_folder(df)}/logs-{uuid.uuid4().hex}"


def _file(path: Column, at, value: Column) -> list[Column]:
    return [path.alias("file"), (F.lit(at) if isinstance(at, int) else at).cast("long").alias("at"), value.alias("value")]


def _talk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("id", F.col("conv_id").cast("string"))


@register("""WITH m AS (SELECT conv_id AS c, count(*) AS n, count(*) FILTER (WHERE role = 'user' AND turn % 2 = 0) AS images FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1)
SELECT CASE WHEN c % 4 = 3 THEN 'agent-' || c ELSE CAST(c AS VARCHAR) END AS session_id, n AS message_count, CASE WHEN c % 4 = 3 THEN CAST(c - 1 AS VARCHAR) END AS parent, CASE WHEN c % 4 = 3 THEN c % 5 END AS depth, images FROM m""")
def claude_tree(spark, sf_dir):
    """A tree of transcript files: sub-sessions in folders of their own with a sidecar each, other files beside them; images as references."""
    c = _talk(spark, sf_dir)
    sub = F.col("conv_id") % 4 == 3
    folder = F.concat(F.lit("p"), F.col("conv_id") % 3, F.lit("/"))
    inside = F.concat(folder, (F.col("conv_id") - 1).cast("string"), F.lit("/subagents/agent-"), "id")
    path = F.when(sub, F.concat(inside, F.lit(".jsonl"))).otherwise(F.concat(folder, "id", F.lit(".jsonl")))
    blocks = F.concat(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))), F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("role").alias("role"), blocks.alias("content")).alias("message")))
    rows = c.select(*_file(path, F.col("turn"), line))
    one = c.select("conv_id", "id").distinct()
    meta = one.where(sub).select(*_file(F.concat(inside, F.lit(".meta.json")), 0, F.to_json(F.struct(F.concat(F.lit("t"), "id").alias("toolUseId"), (F.col("conv_id") % 5).alias("spawnDepth")))))
    noise = one.select(*_file(F.concat(folder, F.lit("notes-"), "id", F.lit(".txt")), 0, F.lit('{"type":"user","message":{"content":"no"}}')))
    at = _place(c)
    write_files(rows.unionByName(meta).unionByName(noise), at).count()
    found = claude.records(spark, at)
    m = claude.messages(found)
    s = claude.sessions(found, claude.spawn_meta(spark, at))
    images = m.groupBy("session_id").agg(F.sum(F.size(F.filter("user_refs", lambda r: r["kind"] == "image"))).alias("n"))
    return s.join(images, "session_id").select("session_id", "message_count", F.col("parent_uuid").alias("parent"), F.col("spawn_depth").cast("bigint").alias("depth"), F.coalesce(F.when(F.col("n") > 0, F.col("n")), F.lit(0)).cast("bigint").alias("images"))


@register("""WITH m AS (SELECT conv_id AS c, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1)
SELECT 's' || c AS session_id, n + CASE WHEN c % 2 = 0 THEN 1 ELSE 0 END AS events, CASE WHEN c % 2 = 0 THEN 'Plan ' || c END AS plan FROM m""")
def antigravity_tree(spark, sf_dir):
    """A folder for each session, logs in a hidden folder below it; a plan file becomes one more event, titled by its heading."""
    c = _talk(spark, sf_dir)
    side = F.when(F.col("role") == "user", "USER_EXPLICIT").otherwise("MODEL")
    rows = c.select(*_file(F.concat(F.lit("s"), "id", F.lit("/.system_generated/logs/transcript.jsonl")), F.col("turn"), F.to_json(F.struct(side.alias("source"), F.concat(F.lit("."), "text").alias("content")))))
    plans = c.where("conv_id % 2 = 0").select("id").distinct().select(*_file(F.concat(F.lit("s"), "id", F.lit("/implementation_plan.md")), 0, F.concat(F.lit("# Plan "), "id", F.lit("\n\nDo it."))))
    at = _place(c)
    write_files(rows.unionByName(plans), at).count()
    _, m = antigravity.ingest(spark, at)
    e = normalise.events(m, antigravity.plan_files(spark, at))
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.max(F.when(F.col("type") == "plan_event", F.col("title"))).alias("plan"))


@register("""SELECT 's' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'second' ELSE 'first' END AS title, count(*) AS message_count, 0 AS blobs FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def opencode_roots(spark, sf_dir):
    """Two roots that share most sessions: the first one's copy counts. File parts keep their names, never their contents."""
    c = _talk(spark, sf_dir)
    sid = F.concat(F.lit("s"), "id")
    one = c.groupBy("conv_id", "id").agg(F.min("turn").alias("turn"))
    at = _place(c)
    for root, some in (("a", F.col("conv_id") % 3 > 0), ("b", F.lit(True))):
        title = "first" if root == "a" else "second"
        session = one.where(some).select(sid.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(title).alias("title"), F.lit(0).cast("long").alias("time_created"), F.lit(0).cast("long").alias("time_updated"), F.lit(None).cast("string").alias("directory"))
        message = c.where(some).select(F.concat(sid, F.lit("-"), "turn").alias("id"), sid.alias("session_id"), F.col("turn").alias("time_created"), F.col("turn").alias("time_updated"), F.to_json(F.struct("role")).alias("data"))
        blob = F.struct(F.lit("file").alias("type"), F.lit("image/png").alias("mime"), F.lit("x.png").alias("filename"), F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("QUJD"), F.lit(50))).alias("url"))
        part = c.where(some).select(F.concat(sid, F.lit("-"), "turn", F.lit("-p")).alias("id"), F.concat(sid, F.lit("-"), "turn").alias("message_id"), sid.alias("session_id"), F.col("turn").alias("time_created"), F.col("turn").alias("time_updated"), F.to_json(blob).alias("data"))
        for name, df in (("session", session), ("message", message), ("part", part)):
            df.write.parquet(f"{at}/{root}/{name}.parquet")
    s, m = opencode.ingest(spark, f"{at}/a", f"{at}/b")
    kept = F.to_json(F.struct("text", "tool_use", "user_refs"))
    blobs = m.groupBy("session_id").agg(F.count_if(kept.contains("QUJD")).alias("blobs"))
    return s.join(blobs, "session_id").select("session_id", "title", "message_count", F.col("blobs").cast("int").alias("blobs"))


@register("SELECT conv_id, turn, text FROM conversations")
def file_union(spark, sf_dir):
    """Lines of several files that a pattern names, as one table."""
    c = table(spark, sf_dir, "conversations")
    at = _place(c)
    write_files(c.select(*_file(F.concat(F.lit("part-"), F.col("conv_id") % 5, F.lit(".log")), F.col("conv_id") * 1_000 + F.col("turn"), F.to_json(F.struct("conv_id", "turn", "text")))), at).count()
    v = F.col("v")
    rows = common.from_lines(common.read_files(spark, f"{at}/part-[0-4].log"))
    return rows.select(common.integer(v, "$.conv_id").alias("conv_id"), common.integer(v, "$.turn").alias("turn"), common.string(v, "$.text").alias("text"))


@register(f"WITH {CONV} SELECT role || '_turn' AS type, count(*) AS n, count(DISTINCT text) AS hashes FROM turns GROUP BY 1")
def content_hashes(spark, sf_dir):
    """Events have one hash for each content, wherever they stand."""
    e = normalise.events(conversation_log(spark, sf_dir).withColumn("user_refs", F.lit(None).cast("array<struct<kind:string,target:string,origin:string>>")))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha256").alias("hashes"))


@register("SELECT o_orderkey AS message_index FROM orders WHERE o_orderstatus = 'F'")
def query_task_key(spark, sf_dir):
    """Plan events of one task."""
    o = table(spark, sf_dir, "orders")
    given = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("step"), F.lit("pending").alias("status"))).alias("plan"), F.concat(F.lit("Ship "), "o_orderstatus").alias("explanation")))
    call = F.array(F.struct(F.lit(0).alias("ord"), F.lit("update_plan").alias("name"), given.alias("input"), F.col("o_orderkey").cast("string").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts")))
    m = conform(o.select(F.lit("codex").alias("agent"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("message_index"), F.lit("assistant").alias("role"), F.lit("").alias("text"), call.alias("tool_use")), MESSAGES)
    return query.query(normalise.events(m), type="plan_event", task_key="ship f", mask=False).select("message_index")


@register("""SELECT p_partkey AS note, unnest(CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['Why'] WHEN 2 THEN ['Risks'] ELSE ['Why', 'Risks'] END) AS section FROM part""")
def note_sections(spark, sf_dir):
    """Sections that a note lacks, or has with nothing but a comment in them."""
    n = F.col("p_partkey") % 4
    why = F.when(n.isin(0, 2), F.concat(F.lit("## Why\n"), "p_name", F.lit("\n"))).when(n == 1, "## Why\n<!-- to come -->\n").otherwise("")
    risks = F.when(n < 2, "## Risks\nnone\n").when(n == 2, "## Risks\n \n").otherwise("### Risks\nnot at this level\n")
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note"), F.concat(F.lit("# Note\n"), why, risks).alias("text"))
    return audit.required_sections(notes, ["Why", "Risks"])


@register("""WITH o AS (SELECT DISTINCT o_custkey, o_orderkey % 4 AS k FROM orders) SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE k WHEN 0 THEN 'pytest' WHEN 1 THEN 'go test' WHEN 2 THEN 'npm test' ELSE 'pytest' END AS runner,
CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'tool_use[Bash].input' WHEN 2 THEN 'tool_result.content' ELSE 'tool_use[pytest].name' END AS surface FROM o""")
def test_surfaces(spark, sf_dir):
    """Test runners and where they were named; a pattern doesn't reach from one place into the next."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    call = F.struct(F.lit(0).alias("ord"), F.when(k == 3, "pytest").otherwise("Bash").alias("name"), F.when(k == 1, '{"command": "GO  test ./..."}').otherwise('{"command": "docker exec web"}').alias("input"), F.lit("t").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))
    result = F.struct(F.lit(0).alias("ord"), F.when(k == 2, "npm run test").otherwise("a test").alias("content"), F.lit(False).alias("is_error"), F.lit("t").alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent"))
    m = conform(o.select(F.lit("claude").alias("agent"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("message_index"), F.lit("assistant").alias("role"), F.when(k == 0, "ran PyTest").otherwise("").alias("text"), F.array(call).alias("tool_use"), F.array(result).alias("tool_result")), MESSAGES)
    return audit.test_evidence(m).select("session_id", "runner", "surface")


@register(f"""WITH {CONV}, s AS (SELECT session_id, string_agg(lower(text), chr(10) ORDER BY message_index) AS hay FROM conv GROUP BY 1) SELECT session_id FROM s WHERE contains(hay, 'the') AND CAST(session_id AS BIGINT) % 3 <> 0
ORDER BY CAST(session_id AS BIGINT) % 50 DESC, session_id LIMIT 25""")
def search_without_noise(spark, sf_dir):
    """Sessions that hold a word, without sub-sessions, newest first."""
    m = conversation_log(spark, sf_dir)
    n = F.col("session_id").cast("long")
    s = conform(m.select("agent", "session_id").distinct().select("agent", "session_id", F.lit("x").alias("title"), F.timestamp_seconds(F.lit(1_735_689_600) + n % 50 * 86_400).alias("date"), F.when(n % 3 == 0, "subagent").alias("kind")), SESSIONS)
    out = search.search_sessions(s, search.haystacks(m), "the", scope="body", limit=25, noise="exclude", sort="date")
    return out.select("session_id")
