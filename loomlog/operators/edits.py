"""File edits and tool calls: attribution, hunks, diffs, filtered calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import contains_ci, json_path, redact, redirect_targets, smart_cap
from .audit import command_of
from .normalise import SESSION, decode, results, with_intent
from .ranks import slice_of
from .sessions import with_total


def _events_with_raw(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").startswith("tool_call("))


def file_edits(events: DataFrame, messages: DataFrame, path: str | None = None, include_input: bool = False, since=None, until=None) -> DataFrame:
    """One row per edited file of each edit call or shell redirect, with the request behind it and what the assistant said with it.

    Without the input, its hash and length stand for it.
    """
    calls = _events_with_raw(events)
    if since is not None:
        calls = calls.where(F.col("ts") >= F.lit(since))
    if until is not None:
        calls = calls.where(F.col("ts") <= F.lit(until))
    direct = calls.where(F.col("tool").isin(*D.EDIT_TOOLS) & F.col("file").isNotNull()).withColumn("append", F.lit(None).cast("boolean")).withColumn("via", F.lit("tool"))
    shell = calls.where(F.col("tool").isin(*D.SHELL_TOOLS)).withColumn("t", F.explode(redirect_targets(command_of(F.col("body")))))
    shell = shell.withColumn("file", F.col("t.path")).withColumn("append", F.col("t.append")).drop("t").withColumn("via", F.lit("shell"))
    rows = direct.unionByName(shell)
    if path:
        rows = rows.where(F.contains("file", F.lit(path)))
    rows = with_intent(rows, messages)
    said = messages.where("role = 'assistant'").select(*SESSION, "message_index", F.nullif("text", F.lit("")).alias("assistant_text"))
    rows = rows.join(said, [*SESSION, "message_index"], "left")
    if include_input:
        return rows.withColumn("input", redact(F.col("body"))["text"])
    return rows.withColumn("input_sha256", F.sha2(F.coalesce(F.to_json(decode(F.col("body"))), F.col("body")), 256)).withColumn("input_length", F.length("body"))


HUNKS = "array<struct<kind:string,old:string,new:string,content:string,mode:string,cmd:string>>"


def hunks(raw: Column, tool: Column, append: Column) -> Column:
    """What an edit does: replacements, a whole content, a shell command, or unknown."""
    v = decode(raw)
    none = F.lit(None).cast("string")

    def hunk(kind, old=none, new=none, content=none, mode=none, cmd=none):
        return F.struct(F.lit(kind).alias("kind"), old.alias("old"), new.alias("new"), content.alias("content"), mode.alias("mode"), cmd.alias("cmd"))

    many = json_path(v, "$.edits", "array<variant>")
    listed = F.transform(many, lambda e: hunk("replace", F.coalesce(json_path(e, "$.old_string"), F.lit("")), F.coalesce(json_path(e, "$.new_string"), F.lit(""))))
    one = F.array(hunk("replace", F.coalesce(json_path(v, "$.old_string"), F.lit("")), F.coalesce(json_path(v, "$.new_string"), F.lit(""))))
    whole = F.array(hunk("write", content=json_path(v, "$.content")))
    shell = F.array(hunk("shell", mode=F.when(append, ">>").otherwise(">"), cmd=command_of(raw)))
    made = F.when(tool.isin(*D.SHELL_TOOLS), shell).when(F.size(many) > 0, listed).when(json_path(v, "$.old_string").isNotNull() | json_path(v, "$.new_string").isNotNull(), one).when(json_path(v, "$.content").isNotNull(), whole)
    return F.coalesce(made, F.array(hunk("unknown")))


def render_hunks(h: Column) -> Column:
    """The hunks as text: - and + lines; shell commands with their mode."""
    lines = lambda text, sign: F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(sign), x))
    none = F.array().cast("array<string>")

    def said(x):
        return F.when(x["kind"] == "replace", F.concat(F.when(x["old"] != "", lines(x["old"], "- ")).otherwise(none), F.when(x["new"] != "", lines(x["new"], "+ ")).otherwise(none))).when(x["kind"] == "write", lines(x["content"], "+ ")).when(x["kind"] == "shell", F.array(F.concat(F.lit("$ ("), x["mode"], F.lit(") "), x["cmd"]))).otherwise(F.array(F.lit("? unknown edit")))

    return F.array_join(F.flatten(F.transform(h, said)), "\n")


def session_diff(events: DataFrame, messages: DataFrame, path: str | None = None, mask: bool = True) -> DataFrame:
    """Per session and file: its edits in order, each under the request behind it, as one text."""
    rows = file_edits(events, messages, path, include_input=True).withColumn("hunk", render_hunks(hunks(F.col("body"), F.col("tool"), F.col("append"))))
    block = F.concat(F.lit("@@ "), F.coalesce(F.regexp_replace("intent", r"\s+", " "), F.lit("(no request)")), F.lit("\n"), F.col("hunk"))
    out = rows.groupBy(*SESSION, "file").agg(F.count(F.lit(1)).alias("edits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n").alias("diff"))
    return out.withColumn("diff", redact(F.col("diff"))["text"]) if mask else out


def tool_calls(
    events: DataFrame, messages: DataFrame, name: str | None = None, name_contains: str | None = None, input_contains: str | None = None, output_contains: str | None = None,
    output_excludes: str | None = None, is_error: bool | None = None, cap: int = 2000, mode: str | None = None, spawn_cost: DataFrame | None = None, limit: int | None = None, intent: bool = True,
) -> DataFrame:
    """Calls with their output, error flag, intent and what a spawned session cost. Filters read whole texts; masks and cuts come last.

    is_error is false where nothing is known; is_error_reliable tells whether the source has a flag. spawn_cost: child_cost() of
    spawned sessions; what a child tells of itself goes before what its parent was told. With ``limit`` (0: none) the first
    calls by time, each with the total of all and whether that leaves some out (truncated). Without ``intent`` there is no such column, and
    no message is sorted and joined for it.
    """
    if name is not None and name_contains is not None:
        raise ValueError("give name or name_contains, not both")
    if all(x is None for x in (name, name_contains, input_contains, output_contains, output_excludes, is_error)):
        raise ValueError("give at least one filter")
    rows = _events_with_raw(events)
    if name is not None:
        rows = rows.where(F.col("tool") == name)
    if name_contains is not None:
        rows = rows.where(contains_ci(F.col("tool"), name_contains))
    if input_contains is not None:
        rows = rows.where(contains_ci(F.col("body"), input_contains))
    rows = rows.join(results(messages).withColumnRenamed("content", "output"), [*SESSION, "tool_use_id"], "left")
    rows = rows.withColumn("is_error", F.coalesce("is_error", F.lit(False))).withColumn("is_error_reliable", F.col("agent").isin(*D.RELIABLE_ERROR_AGENTS))
    output = F.coalesce("output", F.lit(""))
    if output_contains is not None:
        rows = rows.where(contains_ci(output, output_contains))
    if output_excludes is not None:
        rows = rows.where(~contains_ci(output, output_excludes))
    if is_error is not None:
        rows = rows.where(F.col("is_error") == is_error)
    if limit is not None:
        ordered = [F.asc_nulls_last("ts"), F.asc("session_id"), F.asc("seq")]
        rows = with_total(slice_of(rows, ordered, 0, limit) if limit else rows, rows, limit or None)
    if intent:
        rows = with_intent(rows, messages)
    if spawn_cost is not None:
        c = spawn_cost.select("agent", F.col("spawn_tool_use_id").alias("tool_use_id"), "child_id", "child_total", "child_type", "child_models")
        rows = rows.join(c, ["agent", "tool_use_id"], "left").withColumn("cost", F.coalesce("child_total", "subagent.total_tokens"))
        rows = rows.withColumn("agent_type", F.coalesce("child_type", "subagent.agent_type")).withColumn("models", F.coalesce("child_models", F.when(F.col("subagent.model").isNotNull(), F.array("subagent.model"))))
        rows = rows.drop("child_type", "child_models")
    rows = rows.withColumn("output", redact(F.col("output"))["text"]).withColumn("input", redact(F.col("body"))["text"])
    capped = smart_cap(F.col("output"), cap, mode) if mode else F.when(F.col("is_error"), smart_cap(F.col("output"), cap, "smart")).otherwise(smart_cap(F.col("output"), cap, "head"))
    rows = rows.withColumn("output_cut", F.length("output") > cap)
    return rows.withColumn("output", capped)


def child_cost(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(agent, spawn_tool_use_id, child_id, child_total, child_type, child_models) of spawned sessions: exact costs (null: none
    known), what kind of session it is and its models (null: none named). Of sessions of one call the first id counts."""
    own = tokens.where("token_source = 'exact'").select(*SESSION, F.col("tokens.total").alias("child_total"))
    found = sessions.where("spawn_tool_use_id is not null").join(own, list(SESSION), "left")
    named = F.when(F.size("models") > 0, F.col("models"))
    found = found.select("agent", "spawn_tool_use_id", F.col("session_id").alias("child_id"), "child_total", F.nullif("subagent_type", F.lit("")).alias("child_type"), named.alias("child_models"))
    # one by one, so that what nobody reads is not worked out; equal ids are met in one order by all
    return found.groupBy("agent", "spawn_tool_use_id").agg(*[F.min_by(c, "child_id").alias(c) for c in found.columns[2:]])
