"""Registered queries: each binds operators to the given tables, with the same result stated in SQL where SQL can.

Conversations are session logs as they stand. Events are logs of one session per user, in
which clicks, purchases and errors are tool calls (see ``sources.adapters``).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import audit, brief, edits, normalise, plan_events, query, quotes, search, sessions, tokens
from ..schema import MESSAGES, conform
from ..sources import codex
from ..sources.adapters import log_from_conversations, log_from_events
from ..streaming import jobs
from ..tables import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

CONV = """conv AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS message_index, role, text FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index) - 1 AS seq FROM conv WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S'))"""
LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, ts, event_type, value, props,
CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'read_file' WHEN 'purchase' THEN 'Edit' WHEN 'error' THEN 'Bash' END AS tool,
CASE event_type WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'bash' END AS kind FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def conversation_log(spark, sf_dir):
    return log_from_conversations(table(spark, sf_dir, "conversations"))


def event_log(spark, sf_dir):
    return log_from_events(table(spark, sf_dir, "events"))


@register(f"""WITH {CONV}, asked AS (SELECT session_id, message_index, last_value(CASE WHEN role = 'user' AND regexp_matches(text, '\\S') THEN text END IGNORE NULLS) OVER
(PARTITION BY session_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS intent FROM conv)
SELECT session_id, seq, text, intent FROM turns JOIN asked USING (session_id, message_index) WHERE role = 'assistant'""")
def previous_intent(spark, sf_dir):
    """Assistant turns with the request before them."""
    m = conversation_log(spark, sf_dir)
    return query.query(normalise.events(m), messages=m, type="assistant_turn", mask=False).select("session_id", "seq", "text", "intent")


@register(f"WITH {CONV} SELECT session_id, seq, session_id || ':' || seq AS id, role || '_turn' AS type, message_index, text FROM turns")
def event_flatten(spark, sf_dir):
    return normalise.events(conversation_log(spark, sf_dir)).select("session_id", "seq", "id", "type", "message_index", "text")


@register(f"""WITH {LOG} SELECT session_id, seq, CASE WHEN tool IS NULL THEN 'user_turn' ELSE 'tool_call(' || kind || ')' END AS type, tool,
CASE WHEN tool IS NOT NULL THEN 'src/m' || (k % 7) || '.py' END AS file FROM log""")
def event_flatten_calls(spark, sf_dir):
    return normalise.events(event_log(spark, sf_dir)).select("session_id", "seq", "type", "tool", "file")


@register(f"""WITH {LOG}, named AS (SELECT CASE k % 9 WHEN 0 THEN 'MultiEdit' WHEN 1 THEN 'write_file' WHEN 2 THEN 'View' WHEN 3 THEN 'local_shell_call' WHEN 4 THEN 'Agent' WHEN 5 THEN 'Skill'
WHEN 6 THEN 'mcp__files__search' WHEN 7 THEN 'WebFetch' ELSE 'Compile' END AS tool, k FROM log)
SELECT tool, CASE k % 9 WHEN 0 THEN 'edit' WHEN 1 THEN 'write' WHEN 2 THEN 'read' WHEN 3 THEN 'bash' ELSE 'other' END AS subtype,
CASE k % 9 WHEN 0 THEN 'edit' WHEN 1 THEN 'write' WHEN 2 THEN 'read' WHEN 3 THEN 'bash' WHEN 4 THEN 'task' WHEN 5 THEN 'skill' WHEN 6 THEN 'mcp' WHEN 7 THEN 'web' ELSE 'other' END AS tool_kind,
CASE k % 9 WHEN 4 THEN 'role-' || (k % 4) WHEN 5 THEN 'do-' || (k % 3) WHEN 6 THEN 'files:search' END AS tool_resolved, count(*) AS n FROM named GROUP BY ALL""")
def tool_classify(spark, sf_dir):
    """Tool names to subtype, kind and what a wrapper really calls."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = ["MultiEdit", "write_file", "View", "local_shell_call", "Agent", "Skill", "mcp__files__search", "WebFetch", "Compile"]
    given = F.when(k % 9 == 4, F.format_string('{"subagent_type": "role-%d"}', k % 4)).when(k % 9 == 5, F.format_string('{"command": "/do-%d now"}', k % 3)).otherwise("{}")
    rows = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, names)), k % 9 + 1).alias("tool"), given.alias("input")).withColumn("v", normalise.decode(F.col("input")))
    tool = F.col("tool")
    return rows.select("tool", normalise.subtype(tool).alias("subtype"), normalise.tool_kind(tool).alias("tool_kind"), normalise.tool_resolved(tool, F.col("v")).alias("tool_resolved")).groupBy("tool", "subtype", "tool_kind", "tool_resolved").agg(F.count(F.lit(1)).alias("n"))


def _with_errors_as_results(m: DataFrame) -> DataFrame:
    """Each error row also reports a failed result of the call before it."""
    w = normalise.session_window()
    before = F.lag(F.get("tool_use", F.lit(0))["tool_use_id"]).over(w)
    bash = F.get("tool_use", F.lit(0))["name"] == "Bash"
    made = F.array(F.struct(F.lit(0).alias("ord"), F.lit("failed").alias("content"), F.lit(True).alias("is_error"), before.alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent")))
    return conform(m.withColumn("tool_result", F.when(bash & before.isNotNull(), made)), MESSAGES)


@register(f"""WITH {LOG}, told AS (SELECT session_id, lag(CASE WHEN tool IS NOT NULL THEN event_id END) OVER (PARTITION BY session_id ORDER BY seq) AS id, tool FROM log),
bad AS (SELECT DISTINCT session_id, id FROM told WHERE tool = 'Bash' AND id IS NOT NULL)
SELECT log.session_id, seq, log.tool, CASE WHEN bad.id IS NOT NULL THEN true END AS is_error FROM log LEFT JOIN bad ON log.session_id = bad.session_id AND log.event_id = bad.id WHERE log.tool IS NOT NULL""")
def call_result_correlation(spark, sf_dir):
    m = _with_errors_as_results(event_log(spark, sf_dir))
    return normalise.with_errors(normalise.events(m), m).where("tool is not null").select("session_id", "seq", "tool", "is_error")


@register(f"""WITH {LOG} SELECT session_id, seq, tool, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM log WHERE tool IS NOT NULL AND kind <> 'read' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
AND ('src/m' || (k % 7) || '.py') LIKE '%m3%'""")
def query_facets_type_date(spark, sf_dir):
    e = normalise.events(event_log(spark, sf_dir))
    utc = dt.timezone.utc
    out = query.query(e, type="tool_call", since=dt.datetime(2024, 1, 5, tzinfo=utc), until=dt.datetime(2024, 1, 20, 12, tzinfo=utc), file="m3").where("tool_kind <> 'read'")
    return out.select("session_id", "seq", "tool", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register(f"WITH {CONV} SELECT session_id, seq, text FROM turns WHERE contains(lower(text), 'the ')")
def query_text(spark, sf_dir):
    return query.query(normalise.events(conversation_log(spark, sf_dir)), text="The ", mask=False).select("session_id", "seq", "text")


@register(f"""WITH {LOG}, busy AS (SELECT session_id FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE tool = 'Bash') > 10)
SELECT session_id, count(*) AS n, count(*) FILTER (WHERE tool = 'Edit') AS edits FROM log WHERE session_id IN (SELECT session_id FROM busy) GROUP BY 1""")
def query_sessions_semi(spark, sf_dir):
    """Events of sessions with many shell calls: the session filter is a semi-join."""
    e = normalise.events(event_log(spark, sf_dir))
    busy = e.groupBy("agent", "session_id").agg(F.count_if(F.col("tool") == "Bash").alias("n")).where("n > 10")
    return query.query(e, sessions=busy, mask=False).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tool") == "Edit").alias("edits"))


_WALK = f"""WITH {LOG}, a AS (SELECT session_id, seq AS anchor_seq FROM log WHERE tool = 'Bash'),
near AS (SELECT session_id, anchor_seq, seq, row_number() OVER (PARTITION BY session_id, anchor_seq ORDER BY seq %s) AS distance FROM log JOIN a USING (session_id) WHERE tool IS NULL AND seq %s anchor_seq)
SELECT session_id, anchor_seq, seq, distance FROM near WHERE distance <= 2"""


def _walk(spark, sf_dir, direction):
    e = normalise.events(event_log(spark, sf_dir))
    out = query.walk(e, e.where("tool = 'Bash'"), "user_turn", direction, 2)
    return out.select("session_id", "anchor_seq", "seq", F.col("distance").cast("bigint").alias("distance"))


@register(_WALK % ("DESC", "<"))
def relative_walk_prev(spark, sf_dir):
    return _walk(spark, sf_dir, "prev")


@register(_WALK % ("ASC", ">"))
def relative_walk_next(spark, sf_dir):
    return _walk(spark, sf_dir, "next")


@register(f"""WITH {CONV}, r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS u FROM turns)
SELECT x.session_id, x.seq, coalesce(string_agg(y.text, ' | ' ORDER BY y.seq), '') AS requests FROM r x LEFT JOIN r y ON x.session_id = y.session_id AND y.role = 'user' AND y.seq < x.seq AND y.u > x.u - (CASE WHEN x.role = 'user' THEN 1 ELSE 0 END) - 2 GROUP BY ALL""")
def last_two_requests(spark, sf_dir):
    """Every event with the two user turns before it, by one window."""
    out = query.neighbours(normalise.events(conversation_log(spark, sf_dir)), "user_turn", "prev", 2)
    return out.select("session_id", "seq", F.array_join("near", " | ").alias("requests"))


@register(f"""WITH {LOG} SELECT session_id, seq, last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM log""")
def carry_forward(spark, sf_dir):
    m = event_log(spark, sf_dir)
    value = F.when(F.col("text").startswith("view"), F.regexp_extract("text", r'"k": ?([0-9]+)', 1).cast("bigint"))
    return normalise.carry_forward(m, value, "carried", "message_index").select("session_id", F.col("message_index").alias("seq"), "carried")


@register("""WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS message_index, role, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '' ELSE text END AS text, CASE WHEN role = 'assistant' THEN 't' || turn END AS thinking FROM conversations),
t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY message_index) AS turn_no FROM m),
p AS (SELECT *, CASE WHEN role = 'assistant' AND text = '' THEN min(CASE WHEN role = 'assistant' AND text <> '' THEN message_index END) OVER (PARTITION BY session_id, turn_no ORDER BY message_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS target FROM t),
x AS (SELECT session_id, target, string_agg(thinking, chr(10) ORDER BY message_index) AS more FROM p WHERE target IS NOT NULL GROUP BY 1, 2)
SELECT p.session_id, p.message_index, nullif(concat_ws(chr(10), CASE WHEN p.target IS NULL THEN p.thinking END, x.more), '') AS thinking FROM p LEFT JOIN x ON p.session_id = x.session_id AND p.message_index = x.target""")
def orphan_fold(spark, sf_dir):
    m = conversation_log(spark, sf_dir)
    own = F.col("role") == "assistant"
    m = m.withColumn("text", F.when(own & (F.col("message_index") % 4 == 1), "").otherwise(F.col("text"))).withColumn("thinking", F.when(own, F.concat(F.lit("t"), F.col("message_index"))))
    return normalise.fold_thinking(m).select("session_id", "message_index", "thinking")


@register("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id AS child, CASE WHEN conv_id = 1 THEN 9 ELSE conv_id // 2 END AS parent FROM conversations WHERE conv_id > 0),
r AS (SELECT parent AS root, child AS id FROM e UNION SELECT r.root, e.child FROM r JOIN e ON e.parent = r.id)
SELECT root, id FROM r WHERE root <> id""")
def subtree_closure(spark, sf_dir):
    """All descendants of every session, over edges that hold a cycle."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("child")).where("child > 0").distinct()
    edges = c.withColumn("parent", F.when(F.col("child") == 1, 9).otherwise(F.floor(F.col("child") / 2))).select("parent", "child")
    return sessions.descendants(edges, edges.select(F.col("parent").alias("id")).distinct())


def _tree(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("text").alias("title"))
    return c.select(F.lit("claude").alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("conv_id") > 0, F.floor(F.col("conv_id") / 2).cast("string")).alias("parent_uuid"), "message_count", "title", F.when(F.col("conv_id") % 3 == 0, "subagent").alias("kind"))


@register("SELECT CAST(conv_id // 2 AS VARCHAR) AS parent_id, CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE conv_id > 0 AND conv_id // 2 IN (SELECT conv_id FROM conversations) GROUP BY conv_id")
def children(spark, sf_dir):
    return sessions.children(_tree(spark, sf_dir)).select("parent_id", "session_id")


@register("""WITH o AS (SELECT o_custkey AS id, max(o_orderpriority) AS title, min(o_orderstatus) AS dir FROM orders GROUP BY 1)
SELECT coalesce(c.id, o.id) AS id, coalesce(o.title, c_name) AS title, coalesce(c_mktsegment, o.dir) AS dir, c.id IS NOT NULL AS in_a, o.id IS NOT NULL AS in_b FROM (SELECT c_custkey + 10 AS id, * FROM customer) c FULL OUTER JOIN o ON c.id = o.id""")
def full_outer_overlay(spark, sf_dir):
    """Two roots of the same sessions, each with some of its own: the second's title and the first's directory win."""
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey").cast("bigint") + 10).alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("dir"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("title"), F.min("o_orderstatus").alias("dir"))
    return sessions.full_overlay(a, b, "id", ["title"], ["dir"])


_METRICS = """count(*) AS "count", count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE tool = 'Edit') AS edits, count(DISTINCT file) AS files"""
_AGG = f"""WITH {LOG}, x AS (SELECT *, 'src/m' || (k % 7) || '.py' AS file FROM log)"""


def _calls(spark, sf_dir) -> DataFrame:
    e = normalise.events(event_log(spark, sf_dir))
    k = F.coalesce(F.get_json_object("body", "$.k"), F.regexp_extract("text", r'"k": ?([0-9]+)', 1)).cast("int")
    return e.withColumn("k", k).withColumn("edits", F.when(F.col("tool") == "Edit", 1).otherwise(0)).withColumn("file", F.format_string("src/m%d.py", F.col("k") % 7))


@register(f"{_AGG}, g AS (SELECT coalesce(tool, '(unknown)') AS \"group\", {_METRICS} FROM x GROUP BY 1) SELECT *, row_number() OVER (ORDER BY edits DESC, sessions DESC, \"count\" DESC, \"group\") AS rank FROM g")
def aggregate_default(spark, sf_dir):
    out = A.aggregate(_calls(spark, sf_dir), "tool", ["count", "sessions", "edits", "files"])
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edits"), F.desc("sessions"), F.desc("count"), "group")).cast("bigint"))  # one row per tool


@register(f"{_AGG}, g AS (SELECT CAST(k % 10 AS VARCHAR) AS \"group\", {_METRICS} FROM x GROUP BY 1) SELECT *, row_number() OVER (ORDER BY sessions DESC, edits DESC, \"group\") AS rank FROM g")
def aggregate_stats(spark, sf_dir):
    out = A.aggregate(_calls(spark, sf_dir), F.col("k") % 10, ["count", "sessions", "edits", "files"], rank_by="stats")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sessions"), F.desc("edits"), "group")).cast("bigint"))  # ten rows


@register(f"""{_AGG}, l AS (SELECT CASE WHEN k % 5 = 0 THEN [] WHEN k % 5 = 1 THEN ['a', 'b'] ELSE [event_type] END AS labels, * FROM x)
SELECT label AS "group", {_METRICS} FROM (SELECT unnest(labels) AS label, * EXCLUDE (labels) FROM l) GROUP BY 1
UNION ALL SELECT '(total)', {_METRICS} FROM l""")
def aggregate_list_key(spark, sf_dir):
    """A row with several labels counts under each, one with none under none; the total counts each row once."""
    kind = F.element_at(F.array(F.lit("click"), F.lit("purchase"), F.lit("error")), F.array_position(F.array(F.lit("read_file"), F.lit("Edit"), F.lit("Bash")), F.col("tool")).cast("int"))
    kind = F.when(F.col("tool").isNull(), F.split_part("text", F.lit(" "), F.lit(1))).otherwise(kind)
    labels = F.when(F.col("k") % 5 == 0, F.array().cast("array<string>")).when(F.col("k") % 5 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(kind))
    rows = _calls(spark, sf_dir).withColumn("labels", labels)
    names = ["count", "sessions", "edits", "files"]
    return A.aggregate(rows, "labels", names).unionByName(A.totals(rows, names).withColumn("group", F.lit("(total)")))


@register(f"""WITH {LOG} SELECT event_type AS "group", count(*) AS "count", CAST(sum(CASE WHEN tool IS NOT NULL THEN CAST(floor(value) AS BIGINT) END) AS BIGINT) AS tokens_total, CAST(NULL AS BIGINT) AS tokens_input,
count(*) FILTER (WHERE tool IS NOT NULL AND value IS NOT NULL AND k % 2 = 0) AS tokens_exact, count(*) FILTER (WHERE tool IS NOT NULL AND value IS NOT NULL AND k % 2 = 1) AS tokens_estimated, count(*) FILTER (WHERE tool IS NULL OR value IS NULL) AS tokens_unknown FROM log GROUP BY 1""")
def aggregate_tokens(spark, sf_dir):
    """Null-preserving token sums, and how many rows are exact, estimated and unknown."""
    m = event_log(spark, sf_dir)
    k = F.coalesce(F.get_json_object(F.get("tool_use", F.lit(0))["input"], "$.k"), F.regexp_extract("text", r'"k": ?([0-9]+)', 1)).cast("int")
    kind = F.coalesce(F.element_at(F.create_map(F.lit("read_file"), F.lit("click"), F.lit("Edit"), F.lit("purchase"), F.lit("Bash"), F.lit("error")), F.get("tool_use", F.lit(0))["name"]), F.split_part("text", F.lit(" "), F.lit(1)))
    rows = m.withColumn("token_source", F.when(k % 2 == 0, "exact").otherwise("estimated")).withColumn("kind", kind)
    return A.aggregate(rows, "kind", ["count", "tokens"]).select("group", "count", "tokens_total", "tokens_input", "tokens_exact", "tokens_estimated", "tokens_unknown")


def _session_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = event_log(spark, sf_dir)
    rows = m.groupBy("agent", "session_id").agg(F.max("ts").alias("date"), F.count(F.lit(1)).alias("message_count"))
    rows = rows.withColumn("kind", F.when(F.col("session_id").cast("int") % 3 == 0, "subagent"))
    made = normalise.with_intent(normalise.events(m).where("tool = 'Edit'"), m)
    return rows, made


_STATS = f"""WITH {LOG}, a AS (SELECT *, trim(last_value(CASE WHEN tool IS NULL THEN event_type || ' ' || props END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS intent FROM log),
s AS (SELECT session_id, max(ts) AS date, count(*) AS messages, count(*) FILTER (WHERE tool = 'Edit') AS edits FROM a GROUP BY 1), l AS (SELECT *, %s AS label FROM s),
i AS (SELECT label, count(DISTINCT intent) AS intents FROM l LEFT JOIN a ON l.session_id = a.session_id AND tool = 'Edit' GROUP BY 1)
SELECT label AS "group", count(*) AS sessions, CAST(sum(edits) AS BIGINT) AS edits, max(i.intents) AS intents, CAST(sum(messages) AS BIGINT) AS messages FROM l JOIN i USING (label) GROUP BY 1"""


@register(_STATS % "strftime(date, '%Y-%m-%d')")
def session_stats_date(spark, sf_dir):
    return sessions.session_stats(*_session_rows(spark, sf_dir), group_by="date")[0].select("group", "sessions", "edits", "intents", "messages")


@register(_STATS % "CASE WHEN CAST(session_id AS INTEGER) % 3 = 0 THEN 'subagent' ELSE 'main' END")
def session_stats_kind(spark, sf_dir):
    return sessions.session_stats(*_session_rows(spark, sf_dir), group_by="kind")[0].select("group", "sessions", "edits", "intents", "messages")


@register("""SELECT CAST(l_partkey AS VARCHAR) AS file, count(*) AS edits, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_returnflag) AS intents, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS agents FROM lineitem GROUP BY 1""")
def file_frequency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("file"), F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("intent"), F.col("l_linestatus").alias("agent"))
    return A.file_frequency(li, top=0)


@register("""WITH x AS (SELECT l_orderkey AS s, l_suppkey AS c, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem)
SELECT CAST(s AS VARCHAR) AS session_id, CAST(sum(q) AS BIGINT) AS total FROM x WHERE r = 1 GROUP BY 1""")
def usage_dedup(spark, sf_dir):
    """One usage per call, then sums."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    none = F.lit(None).cast("bigint")
    use = F.struct(*[none.alias(f) for f in A.TOKEN_FIELDS[:-1]], F.col("l_quantity").cast("bigint").alias("total"))
    m = table(spark, sf_dir, "lineitem").select(F.lit("claude").alias("agent"), F.col("l_orderkey").cast("string").alias("session_id"), F.row_number().over(w).alias("message_index"), F.concat_ws("|", "l_orderkey", "l_suppkey").alias("call_key"), use.alias("tokens"))
    return tokens.exact_totals(conform(m, MESSAGES)).select("session_id", F.col("tokens.total").alias("total"))


@register(f"WITH {LOG} SELECT session_id, max_by(CAST(floor(value * 100) AS BIGINT), seq) AS total FROM log GROUP BY 1")
def last_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("codex").alias("agent"), F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("at"), F.floor(F.col("value") * 100).alias("counter"))
    return tokens.last_counters(e, "counter", "at").select("session_id", "total")


@register("""WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, CASE WHEN text = '' THEN CAST(doc_id AS VARCHAR) ELSE 'u' || left(text, 256) END ORDER BY doc_id) AS r FROM documents) SELECT source AS session_id, doc_id FROM x WHERE r = 1""")
def text_prefix_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), "doc_id", F.lit("user").alias("role"), "text")
    return codex.dedup_user_texts(rows, "doc_id").select("session_id", "doc_id")


@register("""SELECT CAST(conv_id AS VARCHAR) AS session_id, role || '_turn' AS bucket, CAST(ceil((sum(length(text)) + count(*) - 1) / 4.0) AS BIGINT) AS tokens FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY 1, 2""")
def component_tokens(spark, sf_dir):
    return tokens.component_tokens(conversation_log(spark, sf_dir)).select("session_id", "bucket", "tokens")


@register("""WITH own AS (SELECT conv_id AS id, CAST(ceil((sum(length(text)) FILTER (WHERE role = 'user') + count(*) FILTER (WHERE role = 'user') - 1) / 4.0) AS BIGINT) AS u, CAST(ceil((sum(length(text)) FILTER (WHERE role = 'assistant') + count(*) FILTER (WHERE role = 'assistant') - 1) / 4.0) AS BIGINT) AS a FROM conversations WHERE text <> '' GROUP BY 1),
t AS (SELECT id, coalesce(u, 0) + coalesce(a, 0) AS own FROM own)
SELECT CAST(p.id AS VARCHAR) AS session_id, p.own, CAST(sum(c.own) AS BIGINT) AS children, CAST(p.own + coalesce(sum(c.own), 0) AS BIGINT) AS total FROM t p LEFT JOIN t c ON c.id // 2 = p.id AND c.id > 0 GROUP BY p.id, p.own""")
def tree_tokens(spark, sf_dir):
    """Sessions' tokens with those of their direct children."""
    tree = _tree(spark, sf_dir)
    return tokens.tree_tokens(tokens.session_tokens(conversation_log(spark, sf_dir), tree), tree).select("session_id", "own", "children", "total")


_HAY = "SELECT doc_id, lower(text) AS hay, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents"


@register(f"""WITH d AS ({_HAY}), m AS (SELECT * FROM d WHERE contains(hay, 'token') AND contains(hay, 'the')), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM m),
q AS (SELECT unnest(['the', 'token']) AS t), tf AS (SELECT doc_id, len(tokens) AS dl, t, len(list_filter(tokens, lambda x: x = t)) AS f FROM m, q), df AS (SELECT t, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(CASE WHEN f > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 6) AS score FROM tf JOIN df USING (t), s GROUP BY doc_id""")
def bm25_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay"))
    found = d.where(search.matches(F.col("hay"), *search.parse("the token")))
    return search.bm25(found, "doc_id", "hay", "the token").select("doc_id", F.round("score", 6).alias("score"))


@register("SELECT doc_id FROM documents WHERE (contains(lower(text), 'token') OR contains(lower(text), 'than and')) AND NOT contains(lower(text), 'onhe')")
def search_or_not(spark, sf_dir):
    hay = F.lower("text")
    return table(spark, sf_dir, "documents").where(search.matches(hay, *search.parse('token "than and" -onhe'), "OR")).select("doc_id")


@register("""WITH d AS (SELECT doc_id, lower(text) AS hay, strpos(lower(text), 'token') - 1 AS i FROM documents), e AS (SELECT *, greatest(0, i - 60) AS s, least(length(hay), i + 145) AS z FROM d WHERE i >= 0),
c AS (SELECT *, trim(substring(hay, s + 1, z - s)) AS core FROM e), h AS (SELECT *, CASE WHEN s > 0 AND NOT starts_with(core, '...') THEN '...' ELSE '' END || core AS one FROM c)
SELECT doc_id, left(one || CASE WHEN z < length(hay) AND NOT ends_with(one, '...') THEN '...' ELSE '' END, 200) AS snippet FROM h""")
def snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay")).where(F.contains("hay", F.lit("token")))
    return d.select("doc_id", T.snippet(F.col("hay"), ["token"]).alias("snippet"))


@register("""WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id AS id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))) AS sim, CAST((vec_id * 37) % 101 AS DOUBLE) AS score FROM embeddings, q),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM v), t AS (SELECT * FROM p WHERE r <= 50), b AS (SELECT id, score, 0.75 * (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) + 0.25 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS blended FROM t)
SELECT v.id, row_number() OVER (ORDER BY CASE WHEN b.id IS NOT NULL THEN round(blended, 6) END DESC, b.score DESC, b.id) * CASE WHEN b.id IS NULL THEN NULL ELSE 1 END AS position, round(blended, 6) AS blended FROM v LEFT JOIN b ON v.id = b.id""")
def semantic_rerank(spark, sf_dir):
    """The best fifty by score put in order of a blend with similarity to the first vector."""
    v = table(spark, sf_dir, "embeddings")
    first = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    rows = v.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("id"), search.cosine(F.col("embedding"), F.col("q")).alias("sim"), (F.col("vec_id") * 37 % 101).cast("double").alias("score"))  # one row
    out = search.rerank(rows, "sim")
    return out.select("id", F.col("position").cast("bigint").alias("position"), F.round("blended", 6).alias("blended"))


@register("""SELECT doc_id, CAST(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}')) AS BIGINT) AS hits, md5(regexp_replace(text, '(token = ")[0-9a-f]{40}', '\\1[REDACTED:GENERIC_SECRET]', 'g')) AS digest FROM documents""")
def redact_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("r", T.redact(F.col("text")))
    return d.select("doc_id", F.size("r.hits").cast("bigint").alias("hits"), F.md5("r.text").alias("digest"))


_SAID = """CASE WHEN tool IS NULL THEN CASE WHEN k % 3 = 0 THEN 'thanks, it works' WHEN k % 3 = 1 THEN 'still broken, try again' ELSE 'go on' END WHEN tool = 'Edit' THEN 'Sorry, my mistake' ELSE '' END"""


def _talk(spark, sf_dir) -> DataFrame:
    """The event log with telling texts: users praise or complain, edits apologise, shell calls are dangerous."""
    m = event_log(spark, sf_dir)
    call = F.get("tool_use", F.lit(0))
    k = F.coalesce(F.get_json_object(call["input"], "$.k"), F.regexp_extract("text", r'"k": ?([0-9]+)', 1)).cast("int")
    m = m.withColumn("k", k)
    said = F.when(F.col("role") == "user", F.when(F.col("k") % 3 == 0, "thanks, it works").when(F.col("k") % 3 == 1, "still broken, try again").otherwise("go on")).when(call["name"] == "Edit", "Sorry, my mistake").otherwise("")
    commands = F.array(*map(F.lit, ("rm -rf /home/x", "git push --force", "git push --force-with-lease", "ls -la")))
    command = F.element_at(commands, F.col("k") % 4 + 1)
    made = F.when(call["name"] == "Bash", F.transform("tool_use", lambda t: t.withField("input", F.to_json(F.struct(command.alias("command")))))).otherwise(F.col("tool_use"))
    return conform(m.withColumn("text", said).withColumn("tool_use", made), MESSAGES)


@register(f"""WITH {LOG}, x AS (SELECT k, CASE WHEN tool = 'Bash' THEN k % 4 END AS c FROM log WHERE tool = 'Bash')
SELECT label, count(*) AS "count" FROM (SELECT unnest(CASE c WHEN 0 THEN ['fs.rm_rf_any', 'fs.rm_rf_danger_path'] WHEN 1 THEN ['git.push_force'] ELSE [] END) AS label FROM x) GROUP BY 1""")
def dictionary_labels(spark, sf_dir):
    """Danger labels of shell commands, each counted under all its labels."""
    e = normalise.events(_talk(spark, sf_dir))
    rows = e.where("tool = 'Bash'").withColumn("labels", T.labels(audit.command_of(F.col("body")), D.DANGER))
    return audit.multi_counts(rows, "labels")


@register(f"""WITH {LOG}, b AS (SELECT session_id, seq, k FROM log WHERE tool = 'Bash' AND k % 4 <= 1), r AS (SELECT session_id, seq AS pos FROM log WHERE tool = 'Edit'),
j AS (SELECT b.session_id, b.seq, b.k, min(pos) AS first FROM b LEFT JOIN r ON b.session_id = r.session_id AND pos BETWEEN b.seq + 1 AND b.seq + 6 GROUP BY 1, 2, 3)
SELECT session_id, seq AS message_index, CASE WHEN k % 4 = 0 THEN 'fs.rm_rf_any,fs.rm_rf_danger_path' ELSE 'git.push_force' END AS patterns, first - seq AS reaction_offset, first IS NOT NULL AS confirmed FROM j""")
def incidents_window(spark, sf_dir):
    """Dangerous commands with the apology, if one comes within six messages."""
    m = _talk(spark, sf_dir)
    out = audit.incidents(normalise.events(m), m)
    return out.select("session_id", "message_index", F.array_join("patterns", ",").alias("patterns"), F.col("reaction.offset").alias("reaction_offset"), "confirmed")


def _web(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    given = F.when(F.col("page_id") % 5 == 4, F.to_json(F.struct(F.col("url").alias("query")))).otherwise(F.to_json(F.struct(F.col("url"))))
    call = F.struct(F.lit(0).alias("ord"), F.lit("WebFetch").alias("name"), given.alias("input"), F.col("page_id").cast("string").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))
    return conform(p.select(F.lit("claude").alias("agent"), (F.col("page_id") % 50).cast("string").alias("session_id"), F.col("page_id").alias("message_index"), F.lit("assistant").alias("role"), F.lit("").alias("text"), F.array(call).alias("tool_use")), MESSAGES)


@register("""SELECT page_id AS message_index, CASE WHEN page_id % 5 <> 4 THEN lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) END AS host, CASE WHEN page_id % 5 = 4 THEN 'search' ELSE 'fetch' END AS request_kind, CASE WHEN page_id % 5 <> 4 AND starts_with(url, 'http://') THEN 'plain_http' ELSE '' END AS risks FROM pages""")
def network_pages(spark, sf_dir):
    out = audit.network(normalise.events(_web(spark, sf_dir)))
    return out.select("message_index", "host", "request_kind", F.array_join("risks", ",").alias("risks"))


@register("""SELECT host AS "group", count(*) AS requests, count(*) FILTER (WHERE risky) AS risky FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, starts_with(url, 'http://') AS risky FROM pages WHERE page_id % 5 <> 4) WHERE host = 'example.com' OR host LIKE '%.example.com' GROUP BY 1""")
def network_rollup(spark, sf_dir):
    """Requests to a domain and its subdomains, by host."""
    out = audit.network(normalise.events(_web(spark, sf_dir)), kind="fetch", domain="example.com")
    return out.groupBy(F.col("host").alias("group")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.size("risks") > 0).alias("risky"))


@register(f"""WITH {LOG}, u AS (SELECT session_id, k % 3 AS c, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM log WHERE tool IS NULL),
t AS (SELECT session_id, bool_or(c = 0) AS good, bool_or(c = 1) AS bad FROM u WHERE r <= 3 GROUP BY 1),
prior AS (SELECT session_id, tool, lag(CASE WHEN tool IS NOT NULL THEN event_id END) OVER (PARTITION BY session_id ORDER BY seq) AS id FROM log),
res AS (SELECT session_id, count(*) AS n FROM prior WHERE tool = 'Bash' AND id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT session_id FROM log),
v AS (SELECT s.session_id, coalesce(n, 0) AS tool_results, CASE WHEN coalesce(good, false) AND NOT coalesce(bad, false) THEN 'positive' WHEN coalesce(bad, false) THEN 'negative' ELSE 'neutral' END AS verdict FROM s LEFT JOIN t USING (session_id) LEFT JOIN res USING (session_id))
SELECT session_id, tool_results, verdict, CASE WHEN verdict = 'negative' THEN 'failure' WHEN verdict = 'positive' THEN CASE WHEN tool_results >= 4 THEN 'mixed' ELSE 'success' END WHEN tool_results >= 4 THEN 'failure' ELSE 'unknown' END AS status FROM v""")
def outcome(spark, sf_dir):
    """Good and bad words of the last three user turns, and failed results (here each counted result failed)."""
    out = audit.outcomes(_with_errors_as_results(_talk(spark, sf_dir)))
    return out.select("session_id", "tool_results", "verdict", "status")


_QUOTED = """WITH m AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
q AS (SELECT conv_id AS s, turn, role, CASE WHEN role = 'user' AND length(before) >= 80 AND turn % 2 = 0 THEN 'You said "' || substring(before, 7, 57) || '" ~' || turn ELSE text END AS text FROM m)"""


@register(f"""{_QUOTED}, t AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY turn) AS rank FROM q WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S') ),
g AS (SELECT s, turn, role, rank, p, substring(text, p, 40) AS g FROM t, unnest(range(1, length(text) - 38)) AS r(p) WHERE length(text) >= 40),
h AS (SELECT a.s, a.turn AS a_id, b.turn AS b_id, a.p AS a_at, b.p AS b_at FROM g a JOIN g b ON a.s = b.s AND a.g = b.g AND a.role = 'assistant' AND b.role = 'user' AND a.rank <= b.rank AND a.rank > b.rank - 60),
i AS (SELECT *, a_at - row_number() OVER (PARTITION BY s, a_id, b_id, a_at - b_at ORDER BY a_at) AS island FROM h),
r AS (SELECT s, a_id, b_id, min(a_at) AS a_start, min(b_at) AS b_start, count(*) + 39 AS n FROM i GROUP BY s, a_id, b_id, a_at - b_at, island),
k AS (SELECT *, row_number() OVER (PARTITION BY s, b_id ORDER BY n DESC, a_id DESC, a_start, b_start) AS best FROM r)
SELECT CAST(k.s AS VARCHAR) AS session_id, b_id AS message_index, a_id AS source_index, substring(t.text, b_start, n) AS quote, n AS length FROM k JOIN t ON k.s = t.s AND k.b_id = t.turn WHERE best = 1""")
def verbatim_quotes(spark, sf_dir):
    """Longest runs of forty characters or more that user turns take from assistant turns before them."""
    m = conversation_log(spark, sf_dir)
    before = F.lag("text").over(normalise.session_window())
    made = F.concat(F.lit('You said "'), F.substring("before", 7, 57), F.lit('" ~'), F.col("message_index"))
    m = m.withColumn("before", before).withColumn("text", F.when((F.col("role") == "user") & (F.length("before") >= 80) & (F.col("message_index") % 2 == 0), made).otherwise(F.col("text")))
    return quotes.quotes(m).select("session_id", "message_index", "source_index", "quote", "length")


@register("""WITH x AS (SELECT page_id, [{'kind': 'file', 'target': 'docs/a.md'}, {'kind': 'url', 'target': url}, {'kind': 'file', 'target': 'src/p' || page_id || '.py'}] AS refs FROM pages)
SELECT page_id AS message_index, r.kind AS kind, r.target AS target FROM (SELECT page_id, unnest(refs) AS r FROM x)""")
def user_references(spark, sf_dir):
    """References in user texts; what stands in fenced code or comes twice gives none."""
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit('<doc path="docs/a.md"> see '), F.col("url"), F.lit(" and @src/p"), F.col("page_id"), F.lit(".py or @someone ```https://no.example/x``` again "), F.col("url"))
    return p.select(F.col("page_id").alias("message_index"), F.explode(T.dedup_refs(T.user_refs(text))).alias("r")).select("message_index", "r.kind", "r.target")


@register("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS seq, o_orderpriority AS task_key FROM orders),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id, task_key ORDER BY seq) AS version, max(seq) OVER (PARTITION BY session_id, task_key) AS last, max(seq) OVER (PARTITION BY session_id) AS current FROM o)
SELECT session_id, seq, task_key, version, CASE WHEN last < current THEN 'completed_major' WHEN seq = last THEN 'final' ELSE 'draft' END AS kind FROM x""")
def plan_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("claude").alias("agent"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("seq"), F.lit("plan_event").alias("type"), F.col("o_orderpriority").alias("task_key"))
    return plan_events.revisions(rows).select("session_id", "seq", "task_key", F.col("version").cast("bigint").alias("version"), "kind")


@register("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey, o_orderstatus AS st FROM orders),
r AS (SELECT *, CASE st WHEN 'O' THEN 'approved' WHEN 'F' THEN 'stay_in_plan_mode' END AS verdict FROM o WHERE st IN ('O', 'F'))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY o_orderkey) - 1 AS ordinal, verdict, CASE WHEN st = 'F' THEN CAST(sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY o_orderkey) AS BIGINT) END AS round,
CASE WHEN st = 'F' THEN 'step ' || o_orderkey || ' > first, fix it' ELSE '' END AS said FROM r""")
def feedback_rounds(spark, sf_dir):
    """The user's answers to plans: numbered, with rounds for those that have words; technical failures are none."""
    o = table(spark, sf_dir, "orders").withColumn("agent", F.lit("claude")).withColumn("session_id", F.col("o_custkey").cast("string")).withColumn("id", F.col("o_orderkey").cast("string"))
    e = o.select("agent", "session_id", F.col("o_orderkey").alias("seq"), F.lit("plan_event").alias("type"), F.lit("t").alias("task_key"), F.col("id").alias("tool_use_id"), "id", F.lit("").alias("body"))
    status = F.col("o_orderstatus")
    raw = F.when(status == "O", F.lit(plan_events.APPROVED + " the plan.")).when(status == "F", F.concat(F.lit(plan_events.STAY + "\n" + plan_events.COMMENTS + '\n[Re: "step '), F.col("id"), F.lit(' > first"] fix it'))).otherwise(F.lit(plan_events.TECHNICAL))
    told = F.array(F.struct(F.lit(0).alias("ord"), raw.alias("content"), F.lit(False).alias("is_error"), F.col("id").alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent")))
    m = conform(o.select("agent", "session_id", F.col("o_orderkey").alias("message_index"), F.lit("user").alias("role"), told.alias("tool_result")), MESSAGES)
    out = plan_events.responses(e, m)
    said = F.array_join(F.transform("pairs", lambda p: F.concat_ws(", ", p["quote"], p["comment"])), "; ")
    return out.select("session_id", F.col("ordinal").cast("bigint").alias("ordinal"), "verdict", F.col("round").cast("bigint").alias("round"), said.alias("said"))


@register("""WITH p AS (SELECT p_brand AS file, p_partkey AS i, '@@ ' || 'change ' || p_size || chr(10) || '- ' || p_name || chr(10) || '+ ' || p_type AS b FROM part)
SELECT file, count(*) AS edits, md5(string_agg(b, chr(10) ORDER BY i)) AS digest FROM p GROUP BY 1""")
def hunks_diff(spark, sf_dir):
    """Edits of each file under the requests behind them, as one diff."""
    p = table(spark, sf_dir, "part")
    given = F.to_json(F.struct(F.col("p_brand").alias("file_path"), F.col("p_name").alias("old_string"), F.col("p_type").alias("new_string")))
    call = F.struct(F.lit(0).alias("ord"), F.lit("Edit").alias("name"), given.alias("input"), F.col("p_partkey").cast("string").alias("tool_use_id"), F.lit(None).cast("timestamp").alias("ts"))
    none = F.array().cast("array<struct<ord:int,name:string,input:string,tool_use_id:string,ts:timestamp>>")
    two = F.explode(F.array(F.struct((F.col("p_partkey") * 2).alias("message_index"), F.lit("user").alias("role"), F.format_string("change %d", "p_size").alias("text"), none.alias("tool_use")), F.struct((F.col("p_partkey") * 2 + 1).alias("message_index"), F.lit("assistant").alias("role"), F.lit("").alias("text"), F.array(call).alias("tool_use"))))
    m = conform(p.select(F.lit("claude").alias("agent"), F.col("p_brand").alias("session_id"), two.alias("m")).select("agent", "session_id", "m.*"), MESSAGES)
    return edits.session_diff(normalise.events(m), m).select("file", "edits", F.md5("diff").alias("digest"))


@register("""SELECT p_partkey AS id, path, append FROM (SELECT p_partkey, unnest([{'path': 'out/' || p_size || '.txt', 'append': p_size % 2 = 0}, {'path': 'log', 'append': true}]) AS t FROM part), LATERAL (SELECT t.path AS path, t.append AS append)""")
def shell_redirects(spark, sf_dir):
    """Files that commands write by redirection; quoted signs, numbered streams and arrows are none."""
    op = F.when(F.col("p_size") % 2 == 0, ">>").otherwise(">")
    command = F.concat(F.lit("echo 'a > b' \""), F.col("p_name"), F.lit(" >x\" "), op, F.lit(" out/"), F.col("p_size"), F.lit(".txt 2> err; run -> y &>> log"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(T.redirect_targets(command)).alias("t")).select("id", "t.path", "t.append")


@register("""WITH x AS (SELECT doc_id, source, sum(length('{"doc_id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || '}')) OVER w AS total, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT doc_id, source FROM x WHERE total <= 1000 OR n = 1""")
def byte_budget(spark, sf_dir):
    """The first rows of each source that fit a budget of serialised size."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return query.byte_budget(rows, ["doc_id"], 1000, by=["source"]).select("doc_id", "source")


@register("""SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE '…[truncated]' || right(text, 200) END) AS tail, md5(CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '…[truncated]' END) AS head FROM documents""")
def output_caps(spark, sf_dir):
    """Texts cut at 200 characters from either end."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.smart_cap(F.col("text"), 200, "tail")).alias("tail"), F.md5(T.smart_cap(F.col("text"), 200, "head")).alias("head"))


@register("""SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN starts_with(CAST(doc_id AS VARCHAR), '9') THEN 'id' ELSE 'title' END AS how, n_chars > 1000 AS readable FROM documents WHERE starts_with(CAST(doc_id AS VARCHAR), '9') OR contains(lower(left(text, 100)), '9')""")
def locate(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.left("text", F.lit(100)).alias("title"), F.lit(None).cast("timestamp").alias("date"), F.lit(None).cast("string").alias("path"), (F.col("n_chars") - 1000).alias("message_count"))
    return sessions.locate(s, "9").select("session_id", "how", "readable")


@register("""WITH u AS (SELECT conv_id, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S')),
p AS (SELECT conv_id, max(CASE WHEN n = 1 THEN text END) AS l, max(CASE WHEN n = 2 THEN text END) AS r FROM u WHERE n <= 2 GROUP BY 1),
c AS (SELECT conv_id, CASE WHEN len(regexp_split_to_array(l, '\\s+')) <= 3 AND r IS NOT NULL THEN r ELSE l END AS t FROM p),
f AS (SELECT conv_id, trim(regexp_extract(t, '^(?s:(.*?[.!?])(?:\\s|$))', 1)) AS a, t FROM c)
SELECT CAST(conv_id AS VARCHAR) AS session_id, array_to_string(list_filter(regexp_split_to_array(CASE WHEN a = '' THEN t ELSE a END, '\\s+'), lambda w: lower(w) NOT IN ('ok', 'thanks', 'thank', 'yes', 'no', 'please', 'got it', 'great', 'sure', 'fine', 'the', 'a', 'an', 'this', 'that', 'is', 'are', 'was', 'were')), ' ') AS summary FROM f""")
def task_summary(spark, sf_dir):
    return audit.task_summaries(conversation_log(spark, sf_dir)).select("session_id", "summary")


@register("""WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text || CASE WHEN turn % 2 = 1 THEN ' We decided to use docker. Done!' ELSE ' Chose nothing.' END, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM conversations WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, left(trim(s), 200) AS decision FROM s WHERE regexp_matches(s, 'decided to') AND regexp_matches(s, 'docker') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10""")
def decisions(spark, sf_dir):
    m = conversation_log(spark, sf_dir)
    m = m.withColumn("text", F.concat("text", F.when(F.col("message_index") % 2 == 1, " We decided to use docker. Done!").otherwise(" Chose nothing.")))
    return audit.decisions(m).select("session_id", F.col("n").cast("bigint").alias("n"), "decision")


@register(f"""WITH {LOG}, b AS (SELECT session_id, max(CASE WHEN tool = 'Bash' AND k % 2 = 0 THEN seq END) AS last, count(*) FILTER (WHERE tool = 'Bash') AS lint, count(*) FILTER (WHERE tool = 'Bash') * 2 AS checks FROM log GROUP BY 1)
SELECT b.session_id, lint AS lint_runs, checks AS verifications, CAST(count(log.seq) AS BIGINT) AS calls_after_last_error FROM b LEFT JOIN log ON log.session_id = b.session_id AND log.tool IS NOT NULL AND log.seq > b.last GROUP BY ALL""")
def quality_signals(spark, sf_dir):
    """Lint and test mentions, and calls after the last failure."""
    m = event_log(spark, sf_dir)
    call = F.get("tool_use", F.lit(0))
    k = F.get_json_object(call["input"], "$.k").cast("int")
    bash = call["name"] == "Bash"
    told = F.array(F.struct(F.lit(0).alias("ord"), F.lit("3 failed").alias("content"), F.lit(True).alias("is_error"), call["tool_use_id"].alias("tool_use_id"), F.lit(None).cast("struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>").alias("subagent")))
    m = m.withColumn("tool_result", F.when(bash & (k % 2 == 0), told)).withColumn("tool_use", F.when(bash, F.transform("tool_use", lambda t: t.withField("input", F.lit("ruff . && pytest test_x test")))).otherwise(F.col("tool_use")))
    out = audit.quality_signals(conform(m, MESSAGES))
    return out.select("session_id", "lint_runs", "verifications", "calls_after_last_error")


@register("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, max(ts) AS date FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(floor(epoch(now)) - floor(epoch(date)) AS BIGINT) AS age_sec, floor(epoch(now)) - floor(epoch(date)) > 3600 AS stale FROM s, m""")
def recency(spark, sf_dir):
    m = event_log(spark, sf_dir)
    s = m.groupBy("session_id").agg(F.max("ts").alias("date"))
    now = s.agg(F.max("date").alias("now"))
    return sessions.recency(s.crossJoin(F.broadcast(now)), F.col("now"), 3600).select("session_id", "age_sec", "stale")  # one row


@register(f"""WITH {LOG}, x AS (SELECT *, {_SAID} AS said, CASE tool WHEN 'Bash' THEN '{{"command":"' || CASE k % 4 WHEN 0 THEN 'rm -rf /home/x' WHEN 1 THEN 'git push --force' WHEN 2 THEN 'git push --force-with-lease' ELSE 'ls -la' END || '"}}' ELSE '{{"file_path":"src/m' || (k % 7) || '.py","k":' || k || '}}' END AS body FROM log),
u AS (SELECT session_id, string_agg('> ' || said, chr(10) ORDER BY seq) AS turns FROM x WHERE tool IS NULL GROUP BY 1),
n AS (SELECT session_id, kind, count(*) AS n FROM x WHERE tool IS NOT NULL GROUP BY 1, 2), t AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS calls, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS by_kind FROM n GROUP BY 1),
f AS (SELECT session_id, 'src/m' || (k % 7) || '.py' AS file, count(*) AS n FROM x WHERE tool = 'Edit' GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, file) AS r FROM f),
fs AS (SELECT session_id, count(*) AS n_files, string_agg(n || '× ' || file, chr(10) ORDER BY r) FILTER (WHERE r <= 20) AS files FROM fr GROUP BY 1),
prior AS (SELECT session_id, tool, lag(CASE WHEN tool IS NOT NULL THEN event_id END) OVER (PARTITION BY session_id ORDER BY seq) AS id FROM log), bad AS (SELECT DISTINCT session_id, id FROM prior WHERE tool = 'Bash' AND id IS NOT NULL),
e AS (SELECT x.session_id, x.seq, x.tool || ' ' || body AS detail, row_number() OVER (PARTITION BY x.session_id ORDER BY seq) AS r FROM x JOIN bad ON x.session_id = bad.session_id AND x.event_id = bad.id), es AS (SELECT session_id, string_agg(detail, chr(10) ORDER BY seq) AS errors FROM e WHERE r <= 10 GROUP BY 1),
b AS (SELECT u.session_id, concat_ws(chr(10), '## User' || chr(10) || turns, '## Tools' || chr(10) || coalesce(calls || ' ' || by_kind, '0')) AS base, '## Files' || chr(10) || files AS files, '## Errors' || chr(10) || errors AS errors, calls, coalesce(n_files, 0) AS n_files FROM u LEFT JOIN t USING (session_id) LEFT JOIN fs USING (session_id) LEFT JOIN es USING (session_id)),
l AS (SELECT *, concat_ws(chr(10), base, files, errors) AS b0, concat_ws(chr(10), base, files) AS b1 FROM b)
SELECT session_id, CASE WHEN length(b0) <= 700 THEN b0 WHEN length(b1) <= 700 THEN b1 ELSE base END AS brief, CASE WHEN length(b0) <= 700 THEN 0 WHEN length(b1) <= 700 THEN 1 WHEN length(base) <= 700 THEN 2 ELSE 3 END AS dropped, length(base) > 700 AS over_budget, calls, n_files FROM l""")
def audit_brief(spark, sf_dir):
    """A digest of each session within a budget."""
    m = _with_errors_as_results(_talk(spark, sf_dir))
    e = normalise.events(m)
    bad = normalise.with_errors(e, m).where("is_error").withColumn("detail", F.concat_ws(" ", "tool", "body"))
    return brief.audit_brief(e, m, bad, budget=700).drop("agent")


@register("SELECT count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """Events read as a stream into Parquet until all are in, then counted."""
    events = table(spark, sf_dir, "events")
    out = f"{shared_folder(events)}/stream-{uuid.uuid4().hex}"
    schema = events.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    jobs.ingest(stream, lambda s: s.select("event_id", "user_id", "event_type", "ts"), f"{out}/data", f"{out}/state", "event_type").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum("event_id").alias("ids")).drop("event_type")
