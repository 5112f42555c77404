"""Plan revisions, the user's responses to them, and bodies by id. Order is seq within a session, never time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CUT, redacted, rendered, strip
from ..tables import sorted_join
from .normalise import SESSION


def revisions(events: DataFrame) -> DataFrame:
    """Plan events with version (1 first) and kind: the last of the session's current task is final, earlier ones drafts,
    those of other tasks completed_major. The current task is the one with the latest event."""
    rows = events.where("type = 'plan_event'")
    task = Window.partitionBy(*SESSION, "task_key")
    rows = rows.withColumn("version", F.row_number().over(task.orderBy("seq"))).withColumn("_last", F.max("seq").over(task)).withColumn("_current", F.max("seq").over(Window.partitionBy(*SESSION)))
    kind = F.when(F.col("_last") < F.col("_current"), "completed_major").when(F.col("seq") == F.col("_last"), "final").otherwise("draft")
    return rows.withColumn("kind", kind).drop("_last", "_current")


# The formats in which an interactive approval is recorded.
TECHNICAL = "Tool permission request failed"
APPROVED = "User has approved"
EDITED = "## Approved Plan (edited by user):"
STAY = "User chose to stay in plan mode"
COMMENTS = "Comments on the plan:"
REJECTED = "The user doesn't want to proceed"
SAID = "the user said:"
SELECTED = "On selected text:"
RE_PAIR = r'(?s)\[Re: "(.*?)"\]'


def _after(text: Column, marker: str) -> Column:
    return F.substring(text, F.instr(text, marker) + len(marker), F.length(text))


def _pairs(quotes: Column, comments: Column, lead: Column) -> Column:
    made = F.filter(F.zip_with(quotes, comments, lambda q, c: F.struct(F.nullif(strip(q), F.lit("")).alias("quote"), strip(c).alias("comment"))), lambda p: p["quote"].isNotNull() | (p["comment"] != ""))
    first = F.when(strip(lead) != "", F.array(F.struct(F.lit(None).cast("string").alias("quote"), strip(lead).alias("comment")))).otherwise(F.array().cast("array<struct<quote:string,comment:string>>"))
    return F.concat(first, made)


def re_pairs(text: Column) -> Column:
    """(quote, comment) pairs of [Re: "quote"] comment ...; what comes first has no quote."""
    pieces = F.split(text, RE_PAIR, -1)
    return _pairs(F.regexp_extract_all(text, F.lit(RE_PAIR), F.lit(1)), F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, F.lit(0)))


def selected_pairs(text: Column) -> Column:
    """(quote, comment) pairs of blocks after the marker: leading > lines are the quote."""
    pieces = F.split(text, SELECTED, -1)
    blocks = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda b: F.regexp_replace(b, r"^\n+", ""))
    head = r"^((?:>[^\n]*(?:\n|$))*)"
    quotes = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_extract(b, head, 1), r"(?m)^> ?", ""))
    comments = F.transform(blocks, lambda b: F.regexp_replace(b, head, ""))
    return _pairs(quotes, comments, F.get(pieces, F.lit(0)))


def responses(events: DataFrame, messages: DataFrame) -> DataFrame:
    """The user's verdicts on plans: ordinal, verdict, pairs and edited body; technical and wordless ones are no signal."""
    plans = revisions(events).where("tool_use_id is not null").select(*SESSION, "tool_use_id", F.col("id").alias("plan_id"), "version", F.col("body").alias("plan_body"))
    told = messages.select(*SESSION, "message_index", F.col("ts"), F.explode("tool_result").alias("r")).select(*SESSION, "message_index", "ts", "r.tool_use_id", F.coalesce("r.content", F.lit("")).alias("raw"), F.col("r.ord").alias("ord"))
    rows = told.join(sorted_join(plans), [*SESSION, "tool_use_id"]).where(F.col("agent") == "claude")
    raw = F.col("raw")
    stay_tail = F.when(F.contains(raw, F.lit(COMMENTS)), _after(raw, COMMENTS)).otherwise(F.regexp_replace(raw, r"^[^\n]*\n?", ""))
    has_selection = F.contains(raw, F.lit(SELECTED))
    reject_tail = F.when(F.contains(raw, F.lit(SAID)), _after(raw, SAID)).when(has_selection, F.substring(raw, F.instr(raw, SELECTED), F.length(raw)))
    verdict = F.when(raw.startswith(TECHNICAL), None).when(raw.startswith(APPROVED), "approved").when(raw.startswith(STAY), "stay_in_plan_mode").when(raw.startswith(REJECTED) | has_selection, "rejected")
    none = F.array().cast("array<struct<quote:string,comment:string>>")
    rows = rows.withColumn("verdict", verdict).withColumn("pairs", F.when(F.col("verdict") == "stay_in_plan_mode", re_pairs(stay_tail)).when(F.col("verdict") == "rejected", F.coalesce(selected_pairs(reject_tail), none)).otherwise(none))
    rows = rows.withColumn("edited_body", F.when((F.col("verdict") == "approved") & F.contains(raw, F.lit(EDITED)), F.nullif(F.regexp_replace(_after(raw, EDITED), r"^\n+", ""), F.lit(""))))
    rows = rows.where((F.col("verdict") == "approved") | (F.size("pairs") > 0))
    w = Window.partitionBy(*SESSION).orderBy("message_index", "ord")
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    with_pairs = F.when(F.size("pairs") > 0, 1).otherwise(0)
    return rows.withColumn("round", F.when(F.size("pairs") > 0, F.sum(with_pairs).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def sections(bodies: DataFrame) -> DataFrame:
    """(…, section_no, heading, section): a plan's body cut at headings outside fenced code. bodies: id, body."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(?:```|~~~)")
    lines = lines.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    found = F.when(~fence & (F.col("fences") % 2 == 0), F.nullif(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*\s*$", 1)), F.lit("")))
    lines = lines.withColumn("heading", found)
    lines = lines.withColumn("section_no", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("id", "section_no").agg(F.max("heading").alias("heading"), text.alias("section"))


def feedback(events: DataFrame, messages: DataFrame, rounds: str = "all") -> DataFrame:
    """One row per (quote, comment) pair: plan, version, verdict, round, and the one section that holds the quote."""
    if rounds not in ("all", "last"):
        raise ValueError(f"rounds must be all or last, not {rounds!r}")
    rows = responses(events, messages).where("round is not null")
    if rounds == "last":
        rows = rows.withColumn("_m", F.max("round").over(Window.partitionBy(*SESSION))).where("round = _m").drop("_m")
    pairs = rows.select(*SESSION, "plan_id", "version", "verdict", "round", "ordinal", F.posexplode("pairs").alias("n", "p")).select(*SESSION, "plan_id", "version", "verdict", "round", "ordinal", "n", "p.quote", "p.comment")
    parts = sections(rows.select(F.col("plan_id").alias("id"), F.col("plan_body").alias("body")).distinct())
    q = pairs.where("quote is not null").join(sorted_join(parts), pairs.plan_id == parts.id).where(F.contains(rendered(F.col("section")), rendered(F.col("quote"))))
    anchored = q.groupBy(*SESSION, "ordinal", "n").agg(F.when(F.count(F.lit(1)) == 1, F.max("heading")).alias("section"))
    out = pairs.join(sorted_join(anchored), [*SESSION, "ordinal", "n"], "left")
    return out.withColumn("ref", F.format_string("%s:pf%d", F.col("session_id"), F.col("ordinal")))


def plans(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Revisions with the body in force: what the user edited on approval replaces what was proposed."""
    edited = responses(events, messages).where("edited_body is not null").groupBy(*SESSION, "tool_use_id").agg(F.max_by("edited_body", "ordinal").alias("edited_body"))
    out = revisions(events).join(sorted_join(edited), [*SESSION, "tool_use_id"], "left")
    return out.withColumn("user_edited", F.col("edited_body").isNotNull()).withColumn("body", F.coalesce("edited_body", "body")).drop("edited_body")


#: Characters of a body, unless told otherwise.
BODY_CHARS = 500_000


def bodies(ids: DataFrame, events: DataFrame, messages: DataFrame, max_chars: int = BODY_CHARS, shallow: bool = False, thinking: bool = False) -> DataFrame:
    """(id, type, body, verdict, plan_id, pairs, thinking, drafts, truncated) of events, plans and feedback refs; unknown ids have no row.

    shallow: a superseded plan gives the highest version of its task, and drafts lists the ids of that task's other versions. A
    feedback ref (session:pfN) gives the raw answer. thinking: what the assistant thought with an event. Masked, then cut.
    """
    told = responses(events, messages).select(F.format_string("%s:pf%d", F.col("session_id"), F.col("ordinal")).alias("id"), F.lit("plan_feedback").alias("type"), F.col("raw").alias("own"), "verdict", "plan_id", "pairs")
    out = _event_bodies(ids, events, messages, shallow, thinking).unionByName(ids.join(sorted_join(told), "id"), allowMissingColumns=True)
    out = redacted(out, ["own", "thinking", "pairs"])
    cut = (F.length("own") > max_chars) if max_chars > 0 else F.lit(False)
    body = F.when(cut, F.concat(F.left("own", F.lit(max_chars)), F.lit(CUT))).otherwise(F.col("own"))
    return out.select("id", "type", body.alias("body"), "verdict", "plan_id", "pairs", "thinking", "drafts", F.coalesce(cut, F.lit(False)).alias("truncated"))


def _event_bodies(ids: DataFrame, events: DataFrame, messages: DataFrame, shallow: bool, thinking: bool) -> DataFrame:
    rows = events.select("id", *SESSION, "message_index", "type", "task_key", F.coalesce("body", "text").alias("own"))
    out = ids.join(sorted_join(rows), "id")
    if thinking:
        out = out.join(sorted_join(messages.select(*SESSION, "message_index", F.nullif("thinking", F.lit("")).alias("thinking"))), [*SESSION, "message_index"], "left")
    else:
        out = out.withColumn("thinking", F.lit(None).cast("string"))
    if shallow:
        best = plans(events, messages).groupBy(*SESSION, "task_key").agg(F.max_by("body", "version").alias("best"), F.max_by("id", "version").alias("best_id"), F.array_sort(F.collect_list(F.struct("version", "id"))).alias("all"))
        plan = F.col("type") == "plan_event"
        out = out.join(sorted_join(best), [*SESSION, "task_key"], "left").withColumn("own", F.when(plan, F.coalesce("best", "own")).otherwise(F.col("own")))
        drafts = F.when(plan, F.transform(F.filter("all", lambda x: x["id"] != F.col("best_id")), lambda x: x["id"]))
    else:
        drafts = F.lit(None).cast("array<string>")
    return out.select("id", "type", "own", drafts.alias("drafts"), "thinking")

