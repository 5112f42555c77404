"""Registered queries of pages with totals, spawned sessions, exports and semantic order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit, brief, edits, normalise, query, rollups, text_index
from ..schema import MESSAGES, SESSIONS, conform
from ..sources import claude
from ..tables import cut, shared_folder
from .queries import CONV, LOG, _talk, conversation_log, event_log, register, table


@register(f"""WITH {LOG}, b AS (SELECT session_id, seq, ts, k FROM log WHERE tool = 'Bash' AND k % 4 <= 1), r AS (SELECT session_id, seq AS pos FROM log WHERE tool = 'Edit'),
j AS (SELECT b.session_id, b.seq, b.ts, min(pos) - b.seq AS reaction_offset FROM b LEFT JOIN r ON b.session_id = r.session_id AND pos BETWEEN b.seq + 1 AND b.seq + 6 GROUP BY b.session_id, b.seq, b.ts)
SELECT session_id, seq AS message_index, reaction_offset, (SELECT count(*) FROM j) AS "count", (SELECT count(reaction_offset) FROM j) AS confirmed_count, (SELECT count(*) FROM j) > 40 AS truncated
FROM j ORDER BY ts, session_id || ':' || seq LIMIT 40""")
def incidents_page(spark, sf_dir):
    """The first incidents by time, with how many there are and how many of them are confirmed."""
    m = _talk(spark, sf_dir)
    out = audit.incidents(normalise.events(m), m, limit=40)
    return out.select("session_id", "message_index", F.col("reaction.offset").alias("reaction_offset"), "count", "confirmed_count", "truncated")


@register(f"""WITH {LOG}, c AS (SELECT session_id, seq, ts FROM log WHERE tool = 'Edit')
SELECT session_id, seq, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 60 AS truncated FROM c ORDER BY ts, session_id, seq LIMIT 60""")
def tool_calls_page(spark, sf_dir):
    """The first calls of a tool by time, with the total of all."""
    m = event_log(spark, sf_dir)
    return edits.tool_calls(normalise.events(m), m, name="Edit", limit=60).select("session_id", "seq", "total", "truncated")


def _spawns(spark, sf_dir):
    """Customers as sessions that call a sub-session for each order; what the parent is told differs from what the child says."""
    o = table(spark, sf_dir, "orders").withColumn("use", F.concat(F.lit("u"), "o_orderkey"))
    call = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Task").alias("name"), F.lit("{}").alias("input"), F.col("use").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts")))
    cost = F.struct(F.lit("told").alias("agent_type"), F.lit("m-told").alias("model"), F.lit("ok").alias("status"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("bigint").alias("tool_uses"), F.col("o_orderkey").alias("total_tokens"))
    result = F.array(F.struct(F.lit(0).alias("ord"), F.lit("done").alias("content"), F.lit(False).alias("is_error"), F.col("use").alias("tool_use_id"), cost.alias("subagent")))
    base = o.select(F.lit("claude").alias("agent"), F.col("o_custkey").cast("string").alias("session_id"), (2 * F.col("o_orderkey")).alias("message_index"), F.lit("").alias("text"), call.alias("tool_use"), result.alias("tool_result"))
    m = conform(base.withColumn("role", F.lit("assistant")).drop("tool_result"), MESSAGES).unionByName(conform(base.withColumn("role", F.lit("user")).withColumn("message_index", F.col("message_index") + 1).drop("tool_use"), MESSAGES))
    n = F.col("o_orderkey") % 4
    child = o.where(n > 0).select(F.lit("claude").alias("agent"), F.concat(F.lit("agent-"), "o_orderkey").alias("session_id"), F.col("use").alias("spawn_tool_use_id"), F.when(n != 1, "tester").alias("subagent_type"), F.when(n != 2, F.array(F.lit("m-own"))).alias("models"), F.when(n == 3, F.col("o_custkey")).alias("total"))
    tokens = child.select("agent", "session_id", F.struct("total").alias("tokens"), F.when(F.col("total").isNotNull(), "exact").alias("token_source"))
    return m, conform(child, SESSIONS), tokens


@register("""SELECT 'u' || o_orderkey AS tool_use_id, CASE WHEN o_orderkey % 4 > 0 THEN 'agent-' || o_orderkey END AS child_id, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 'tester' ELSE 'told' END AS agent_type,
CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'm-own' ELSE 'm-told' END AS models, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey ELSE o_orderkey END AS cost FROM orders""")
def spawn_facts(spark, sf_dir):
    """Spawn calls: a child's own kind, models and exact cost go before what the parent was told; a child without cost is still named."""
    m, s, tokens = _spawns(spark, sf_dir)
    out = edits.tool_calls(normalise.events(m), m, name="Task", spawn_cost=edits.child_cost(s, tokens))
    return out.select("tool_use_id", "child_id", "agent_type", F.array_join("models", ",").alias("models"), "cost")


@register("""SELECT 'agent-' || o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'p' || o_custkey END AS parent FROM orders""")
def spawn_repair(spark, sf_dir):
    """Sessions whose path names the first session above them: deeper ones move under the one that made the call, others stay."""
    m, _, _ = _spawns(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    s = conform(o.select(F.lit("claude").alias("agent"), F.concat(F.lit("agent-"), "o_orderkey").alias("session_id"), F.concat(F.lit("p"), "o_custkey").alias("parent_uuid"), F.concat(F.lit("u"), "o_orderkey").alias("spawn_tool_use_id"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("spawn_depth")), SESSIONS)
    return claude.repair_parents(s, m).select("session_id", F.col("parent_uuid").alias("parent"))


@register(f"""WITH {CONV}, f AS (SELECT session_id, count(*) AS n, arg_min(text, message_index) FILTER (WHERE role = 'user') AS goal, arg_max(role, message_index) AS last_role, arg_max(text, message_index) AS last_text, arg_max(text, message_index) FILTER (WHERE role = 'assistant') AS said FROM conv GROUP BY 1),
s AS (SELECT *, trim(split_part(trim(coalesce(goal, ''), ' ' || chr(10)), chr(10), 1)) AS g, CASE WHEN last_role = 'user' THEN trim(last_text, ' ' || chr(10)) ELSE '' END AS o, trim(coalesce(said, ''), ' ' || chr(10)) AS a FROM f)
SELECT 'claude/' || session_id || '.md' AS file, md5('# Session: T' || session_id || chr(10) || chr(10) || '**UUID**: ' || session_id || ' · **Agent**: claude · **Date**: 2025-02-03' || chr(10) || chr(10) || '- 2025-02-03 — claude — T' || session_id || ' [non-actionable]' || chr(10) || chr(10) || '## Round: T' || session_id
|| chr(10) || chr(10) || '### Goal' || chr(10) || CASE WHEN g = '' THEN 'n/a' WHEN length(g) > 200 THEN left(g, 199) || '…' ELSE g END || chr(10) || chr(10) || '### Status' || chr(10) || CASE last_role WHEN 'assistant' THEN 'completed' ELSE 'in-progress' END || chr(10) || chr(10) || '### Files touched' || chr(10) || '(none)' || chr(10) || chr(10) || '### Decisions' || chr(10) || '(none)'
|| chr(10) || chr(10) || '### Open' || chr(10) || CASE WHEN o = '' THEN 'n/a' WHEN length(o) > 200 THEN left(o, 199) || '…' ELSE o END || chr(10) || chr(10) || '### Next actions' || chr(10) || CASE WHEN a = '' THEN 'n/a' WHEN length(a) > 200 THEN left(a, 199) || '…' ELSE a END
|| chr(10) || chr(10) || '### Snapshot' || chr(10) || 'tokens: ' || n || chr(10)) AS digest FROM s""")
def export_rounds(spark, sf_dir):
    """Each session as a Markdown file: written, and read back from the files."""
    m = cut(conversation_log(spark, sf_dir).withColumn("agent", F.lit("claude")))
    s = m.groupBy("agent", "session_id").agg(F.count(F.lit(1)).alias("n"))
    s = conform(s.select("agent", "session_id", F.concat(F.lit("T"), "session_id").alias("title"), F.lit("2025-02-03").cast("timestamp").alias("date"), F.create_map(F.lit("token_count"), F.col("n").cast("string")).alias("extra")), SESSIONS)
    at = f"{shared_folder(m)}/export-{uuid.uuid4().hex}"
    brief.export(brief.rounds(s, m, mask=False), at).count()
    back = spark.read.option("recursiveFileLookup", "true").text(at, wholetext=True)
    return back.select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("file"), F.md5("value").alias("digest"))


def _letters():
    """A toy embedding: how often each letter occurs."""

    def vectors(texts):
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    return vectors


_COUNTS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: length({0}) - length(replace({0}, c, '')))"


@register(f"""WITH {CONV}, m AS (SELECT session_id, seq, lower(text) AS hay, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM turns WHERE contains(lower(text), 'the of')), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM m),
q AS (SELECT unnest(['of', 'the']) AS t), tf AS (SELECT session_id, seq, hay, len(tokens) AS dl, t, len(list_filter(tokens, lambda x: x = t)) AS f FROM m, q), df AS (SELECT t, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY 1),
b AS (SELECT session_id, seq, hay, sum(CASE WHEN f > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf JOIN df USING (t), s GROUP BY 1, 2, 3),
v AS (SELECT *, CAST({_COUNTS.format("hay")} AS DOUBLE[26]) AS x, CAST({_COUNTS.format("'the of'")} AS DOUBLE[26]) AS y FROM b)
SELECT session_id, seq, round(array_cosine_similarity(x, y), 6) AS similarity FROM v""")
def query_semantic(spark, sf_dir):
    """Events that hold a text, put in order by meaning, as a toy embedding has it; all of them fit the pool."""
    out = query.query(normalise.events(conversation_log(spark, sf_dir)), text="the of", sort="semantic", embed=_letters, pool=1_000_000, mask=False)
    return out.select("session_id", "seq", F.round("similarity", 6).alias("similarity"))


@register("""SELECT event_type AS "type", count(*) AS "rows", CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT props) AS BIGINT) AS props, true AS near FROM events GROUP BY 1""")
def rollup_by_day(spark, sf_dir):
    """Distinct counts merged from rollups by day: exact ones, and whether the sketches are within four standard errors of them."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type")
    days = cut(rollups.exact_rollup(e, ["type"], ["user_id", "props"]))
    exact = rollups.merged_exact(days, ["type"]).groupBy("type").pivot("metric", ["rows", "user_id", "props"]).agg(F.first("n"))
    told = rollups.merged(cut(rollups.rollup(e, ["type"], ["user_id", "props"])), ["type"]).select("type", F.col("rows").alias("n"), F.col("user_id").alias("u"), F.col("props").alias("p"))
    both = exact.join(told, "type")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * rollups.error() * F.col(a) + 1
    return both.select("type", "rows", F.col("user_id").alias("users"), "props", ((F.col("n") == F.col("rows")) & close("user_id", "u") & close("props", "p")).alias("near"))


NEEDLE = "token = "


@register(f"""WITH d AS (SELECT doc_id FROM documents WHERE contains(lower(text), '{NEEDLE}')) SELECT doc_id FROM d""")
def query_text_indexed(spark, sf_dir):
    """Documents that hold a text, found by the index and verified on the texts that it leaves."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("g").alias("agent"), F.col("doc_id").cast("string").alias("session_id"), "text")
    grams = cut(text_index.index(d, ["text"]))
    return text_index.narrowed(d, grams, NEEDLE).where(F.contains(F.lower("text"), F.lit(NEEDLE))).select("doc_id")
