"""Messages to events: user turns, assistant turns, tool calls and plan events in one order.

The rows of a session are ordered by message_index everywhere; time is not an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import blank, bound, dedup_refs, first_heading, json_path, normal_title, said, user_refs

SESSION = ("agent", "session_id")


def session_window(order: str = "message_index"):
    return Window.partitionBy(*SESSION).orderBy(order)


def decode(text: Column) -> Column:
    """Tool input as a variant; null if it isn't JSON or is over a million characters."""
    return F.when(F.length(text) <= 1_000_000, F.try_parse_json(text))


def _plain(name: Column) -> Column:
    return F.lower(F.trim(name))


def _subtype(plain: Column) -> Column:
    return F.when(plain.isin(*D.EDIT_NAMES), "edit").when(plain.isin(*D.WRITE_NAMES), "write").when(plain.isin(*D.READ_NAMES), "read").when(plain.isin(*D.BASH_NAMES), "bash").otherwise("other")


def subtype(name: Column) -> Column:
    return bound(_plain(name), _subtype)


_MCP = r"^mcp__(.+?)__(.+)$"


def tool_kind(name: Column) -> Column:
    mcp = F.trim(name).rlike(_MCP)
    return bound(_plain(name), lambda n: F.when(mcp, "mcp").when(n.isin(*D.TASK_NAMES), "task").when(n.isin(*D.SKILL_NAMES), "skill").when(n.isin(*D.WEB_NAMES), "web").otherwise(_subtype(n)))


def _first(v: Column, keys) -> Column:
    return F.coalesce(*[said(F.trim(json_path(v, f"$.{k}"))) for k in keys])


def tool_resolved(name: Column, v: Column) -> Column:
    """What a wrapper really calls; null for plain tools and nameless wrappers."""
    skill = F.nullif(F.regexp_replace(F.split_part(_first(v, D.SKILL_KEYS), F.lit(" "), F.lit(1)), "^/+", ""), F.lit(""))
    server = F.concat_ws(":", F.regexp_extract(F.trim(name), _MCP, 1), F.regexp_extract(F.trim(name), _MCP, 2))
    return bound(tool_kind(name), lambda kind: F.when(kind == "mcp", server).when(kind == "task", _first(v, D.TASK_KEYS)).when(kind == "skill", skill))


def file_of(v: Column) -> Column:
    """The file that a call names."""
    at = lambda x, keys: [said(json_path(x, f"$.{k}")) for k in keys]
    files = F.coalesce(json_path(v, "$.files", "array<variant>"), F.array().cast("array<variant>"))
    inner = F.get(F.filter(F.transform(files, lambda f: F.coalesce(*at(f, D.PATH_KEYS))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*at(v, D.PATH_KEYS), inner, *at(v, D.LATE_PATH_KEYS))


def results(messages: DataFrame) -> DataFrame:
    """(agent, session_id, tool_use_id, is_error, content): the last result of each call."""
    rows = messages.select(*SESSION, "message_index", F.explode("tool_result").alias("r")).where("r.tool_use_id is not null")
    last = F.max_by(F.struct("r.is_error", "r.content", "r.subagent"), F.struct("message_index", "r.ord"))
    return rows.groupBy(*SESSION, F.col("r.tool_use_id").alias("tool_use_id")).agg(last.alias("x")).select(*SESSION, "tool_use_id", "x.is_error", "x.content", "x.subagent")


def with_results(calls: DataFrame, messages: DataFrame) -> DataFrame:
    return calls.join(results(messages), [*SESSION, "tool_use_id"], "left")


def fold_thinking(messages: DataFrame) -> DataFrame:
    """Thinking of assistant messages without text or tools moves to the next one with text before the next user message."""
    w = session_window()
    turn = messages.withColumn("_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    says = (F.col("role") == "assistant") & ~blank(F.col("text"))
    orphan = (F.col("role") == "assistant") & blank(F.col("text")) & (F.coalesce(F.size("tool_use"), F.lit(0)) <= 0) & ~blank(F.col("thinking"))
    ahead = Window.partitionBy(*SESSION, "_turn").orderBy("message_index").rowsBetween(1, Window.unboundedFollowing)
    turn = turn.withColumn("_to", F.when(orphan, F.min(F.when(says, F.col("message_index"))).over(ahead)))
    moved = turn.where("_to is not null").groupBy(*SESSION, F.col("_to").alias("message_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "thinking"))), lambda x: x["thinking"]), "\n").alias("_more"))
    out = turn.join(moved, [*SESSION, "message_index"], "left")
    own = F.when(F.col("_to").isNull(), F.nullif("thinking", F.lit("")))
    return out.withColumn("thinking", F.nullif(F.concat_ws("\n", own, "_more"), F.lit(""))).drop("_turn", "_to", "_more")


def plan_signal(agent: Column, name: Column, v: Column) -> Column:
    """A struct (signal, title, path, body, steps) if the call states a plan, else null."""
    file = json_path(v, "$.file_path")
    none = F.lit(None).cast("string")
    steps = F.coalesce(json_path(v, "$.plan", "array<variant>"), json_path(v, "$.steps", "array<variant>"))
    states = F.filter(F.transform(steps, lambda s: json_path(s, "$.status")), lambda s: s.isNotNull())
    status = F.when(F.size(states) > 0, F.when(F.forall(states, lambda s: s == "completed"), "completed").when(F.exists(states, lambda s: s == "in_progress"), "in_progress").otherwise("pending"))
    step_title = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (json_path(v, "$.name"), json_path(v, "$.explanation"), json_path(F.get(steps, F.lit(0)), "$.step"), json_path(F.get(steps, F.lit(0)), "$.text"))], F.lit("Plan"))

    def made(signal, title, path, text, state):
        return F.struct(F.lit(signal).alias("signal"), title.alias("title"), path.alias("path"), F.nullif(text, F.lit("")).alias("body"), state.alias("status"))

    leave = made("claude:ExitPlanMode", F.coalesce(first_heading(json_path(v, "$.plan")), F.lit("Plan")), none, json_path(v, "$.plan"), none)
    write = made("claude:Write(plans/*.md)", F.coalesce(first_heading(json_path(v, "$.content")), F.element_at(F.split(file, "/"), -1)), file, json_path(v, "$.content"), none)
    update = made("codex:update_plan", step_title, none, none, status)
    return F.when((agent == "claude") & (name == "ExitPlanMode"), leave).when((agent == "claude") & name.isin("Write", "write", "write_file", "create_file") & file.rlike(r"(?i)plans/[^/]*\.md$"), write).when((agent == "codex") & (name == "update_plan"), update)


USE = "struct<ord:int,name:string,input:string,tool_use_id:string,ts:timestamp>"
EVENT = f"struct<phase:int,ord:int,type:string,text:string,use:{USE},v:variant,plan:struct<signal:string,title:string,path:string,body:string,status:string>>"


def events(messages: DataFrame, plan_files: DataFrame | None = None) -> DataFrame:
    """One row per event, seq counting those of a session from 0.

    plan_files (session_id, path, body) adds one plan event at the end of its session.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def event(phase, type_, text=none("string"), use=none(USE), v=none("variant"), plan=none(EVENT)["plan"]):
        return F.struct(F.lit(phase).alias("phase"), F.coalesce(use["ord"], F.lit(0)).alias("ord"), F.lit(type_).alias("type"), text.alias("text"), use.alias("use"), v.alias("v"), plan.alias("plan"))

    def told(t):
        # an input is parsed once, a plan worked out once
        plan = lambda p: F.when(p.isNotNull(), event(2, "plan_event", p["title"], t, plan=p))
        return bound(decode(t["input"]), lambda v: F.array(event(1, "tool_call", F.lit(""), t, v), bound(plan_signal(F.col("agent"), t["name"], v), plan)))

    tools = F.coalesce(F.filter("tool_use", lambda t: F.coalesce(t["name"], F.lit("")) != ""), F.array().cast(f"array<{USE}>"))
    says = ~blank(F.col("text"))
    none_events = F.array().cast(f"array<{EVENT}>")
    made = F.when(F.col("role") == "user", F.when(says, F.array(event(0, "user_turn", F.col("text")))).otherwise(none_events)).when(
        F.col("role") == "assistant",
        F.concat(F.when(says, F.array(event(0, "assistant_turn", F.col("text")))).otherwise(none_events), F.array_compact(F.flatten(F.transform(tools, told)))),
    )
    rows = messages.select(*SESSION, "message_index", F.col("ts").alias("message_ts"), "role", "model", ~blank(F.col("thinking")), F.when(F.col("role") == "user", dedup_refs(F.concat(F.coalesce("user_refs", F.array().cast("array<struct<kind:string,target:string,origin:string>>")), F.coalesce(user_refs(F.col("text")), F.array().cast("array<struct<kind:string,target:string,origin:string>>"))))).alias("user_refs"), F.explode(made).alias("e"))
    rows = rows.withColumnRenamed(rows.columns[6], "has_thinking").select(*SESSION, "message_index", "model", "has_thinking", "user_refs", "message_ts", "e.*")
    # each field is a column, so that those nobody reads are not worked out
    name, v, of_call = F.col("use.name"), F.col("v"), lambda x: F.when(F.col("phase") == 1, x)
    fields = {
        "type": F.coalesce(of_call(F.concat(F.lit("tool_call("), subtype(name), F.lit(")"))), F.col("type")), "text": F.col("text"),
        "body": F.when(F.col("phase") == 1, F.coalesce("use.input", F.lit(""))).otherwise(F.col("plan.body")), "tool": of_call(name), "tool_kind": of_call(tool_kind(name)),
        "tool_resolved": of_call(tool_resolved(name, v)), "file": of_call(file_of(v)), "title": F.col("plan.title"), "agent_signal": F.col("plan.signal"),
        "plan_path": F.col("plan.path"), "plan_status": F.col("plan.status"), "tool_use_id": F.col("use.tool_use_id"), "ts": F.coalesce("use.ts", "message_ts"),
    }
    rows = rows.select(*SESSION, "message_index", "model", "has_thinking", "user_refs", "phase", "ord", *[x.alias(n) for n, x in fields.items()]).withColumn("late", F.lit(0))
    if plan_files is not None:
        extra = plan_files.select(F.lit("antigravity").alias("agent"), "session_id", F.lit(-1).cast("bigint").alias("message_index"), F.lit(2).alias("phase"), F.lit(0).alias("ord"), F.lit("plan_event").alias("type"), F.coalesce(first_heading(F.col("body")), F.lit("implementation_plan.md")).alias("title"), F.lit("antigravity:implementation_plan.md").alias("agent_signal"), F.col("path").alias("plan_path"), "body", F.lit(1).alias("late"))
        rows = rows.unionByName(extra.withColumn("text", F.col("title")), allowMissingColumns=True)
    w = Window.partitionBy(*SESSION).orderBy("late", "message_index", "phase", "ord")
    rows = rows.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint"))
    refs = F.to_json(F.struct("tool", "tool_kind", "tool_resolved", "file", "title", "agent_signal", F.col("plan_path").alias("path"), "user_refs"))
    rows = rows.withColumn("id", F.concat_ws(":", "session_id", "seq")).withColumn("sha256", F.sha2(F.to_json(F.struct(refs.alias("refs"), "text", "type")), 256))
    return with_task_keys(rows).drop("late", "phase").withColumnRenamed("ord", "tool_ord")


def with_task_keys(rows: DataFrame) -> DataFrame:
    """task_key of plan events: the slug of the plan file; a plan exit inherits the last one; else the title."""
    slug = F.lower(F.nullif(F.regexp_extract("plan_path", r"(?i)(plans/[^/]*\.md)$", 1), F.lit("")))
    w = Window.partitionBy(*SESSION).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("type") == "plan_event", slug), ignorenulls=True).over(w)
    key = F.when(F.col("agent") == "claude", F.coalesce(carried, normal_title(F.col("title")))).when(F.col("agent") == "antigravity", F.coalesce("plan_path", normal_title(F.col("title")))).otherwise(normal_title(F.col("title")))
    return rows.withColumn("task_key", F.when(F.col("type") == "plan_event", key))


def with_errors(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Events with is_error from their call's result; null where nothing is known."""
    return rows.join(results(messages).select(*SESSION, "tool_use_id", "is_error"), [*SESSION, "tool_use_id"], "left")


def carry_forward(rows: DataFrame, value: Column, name: str, order: str, by=SESSION) -> DataFrame:
    """rows with the latest non-null value up to each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def previous_text(messages: DataFrame, name: str = "intent") -> DataFrame:
    """Messages with the nearest earlier non-blank user text."""
    w = session_window().rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & ~blank(F.col("text")), F.col("text"))
    return messages.withColumn(name, F.last(said, ignorenulls=True).over(w))


def with_intent(rows: DataFrame, messages: DataFrame) -> DataFrame:
    return rows.join(previous_text(messages).select(*SESSION, "message_index", "intent"), [*SESSION, "message_index"], "left")
