"""The faceted event query, walks between events, and their order and limits.

Facets make one predicate; masks and cuts come last, on the rows that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import contains_ci, preview, redacted, under
from ..tables import unused
from .normalise import SESSION, with_intent
from .ranks import running, slice_of
from .search import bm25, semantic, spawned

TYPES = ("user_turn", "assistant_turn", "plan_event", "tool_call", *(f"tool_call({k})" for k in D.TOOL_KINDS))
WRAPPED = ("task", "skill", "mcp", "web")


def _check(name: str, value, allowed) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value!r}")


def facets(
    type: str | None = None, agent: str | None = None, session: str | Sequence[str] | None = None, since: datetime | None = None, until: datetime | None = None, file: str | None = None,
    tool: str | None = None, tool_kind: str | None = None, model: str | None = None, user_ref: str | None = None, has_thinking: bool | None = None, text: str | None = None, task_key: str | None = None,
) -> Column:
    """One predicate of all facets given. Bad values raise before anything runs; facets that exclude each other are false."""
    _check("type", type, TYPES)
    _check("agent", agent, (*D.AGENTS, "all"))
    _check("tool_kind", tool_kind, D.TOOL_KINDS)
    out = F.lit(True)
    if type:
        inner = type[10:-1] if type.startswith("tool_call(") else None
        if inner in WRAPPED:
            if tool_kind not in (None, inner):
                return F.lit(False)
            out = out & (F.col("tool_kind") == inner)
        elif type == "tool_call":
            out = out & F.col("type").startswith("tool_call(")
        else:
            out = out & (F.col("type") == type)
    if agent and agent != "all":
        out = out & (F.col("agent") == agent)
    if session is not None:
        ids = [session] if isinstance(session, str) else list(session)
        if not ids:
            raise ValueError("session is an empty list")
        out = out & F.col("session_id").isin(*ids)
    if since is not None:
        out = out & (F.col("ts") >= F.lit(since))
    if until is not None:
        out = out & (F.col("ts") <= F.lit(until))
    if file is not None:
        out = out & F.contains("file", F.lit(file))
    if tool is not None:
        out = out & (F.coalesce(contains_ci(F.col("tool"), tool), F.lit(False)) | F.coalesce(contains_ci(F.col("tool_resolved"), tool), F.lit(False)))
    if tool_kind is not None:
        out = out & (F.col("tool_kind") == tool_kind)
    if model is not None:
        out = out & (F.lower("model") == model.lower())
    if user_ref == "any":
        out = out & (F.size("user_refs") > 0)
    elif user_ref in ("file", "url", "image", "attachment", "ide_context"):
        out = out & F.exists("user_refs", lambda r: r["kind"] == user_ref)
    elif user_ref is not None:
        out = out & F.exists("user_refs", lambda r: F.contains(F.lower(r["target"]), F.lit(user_ref.lower())))
    if has_thinking is not None:
        out = out & (F.col("has_thinking") == has_thinking)
    if text is not None:
        out = out & (F.coalesce(contains_ci(F.col("text"), text), F.lit(False)) | F.coalesce(contains_ci(F.col("body"), text), F.lit(False)))
    if task_key is not None:
        if type not in (None, "plan_event"):
            return F.lit(False)
        out = out & (F.col("task_key") == task_key)
    return out


def sessions_where(sessions: DataFrame, noise: str = "include", project_dir: str | None = None, since=None, until=None, days: int = 0, now=None) -> DataFrame:
    """Sessions without sub-sessions (exclude), only those (only) or all; in a directory or below; in a span of dates. until may
    be a date, which then counts to its end; days: only the last so many before now, which is an argument."""
    if days:
        if now is None:
            raise ValueError("days needs now")
        sessions = sessions.where(F.col("date") >= F.lit(now - timedelta(days=days)))
    if until is not None and not isinstance(until, datetime):
        until = datetime.combine(until, time(23, 59, 59))
    _check("noise", noise, ("include", "exclude", "only"))
    out = sessions if noise == "include" else sessions.where(spawned() if noise == "only" else ~spawned())
    if project_dir is not None:
        out = out.where(under(F.col("project_dir"), project_dir))
    if since is not None:
        out = out.where(F.col("date") >= F.lit(since))
    return out if until is None else out.where(F.col("date") <= F.lit(until))


def query(
    events: DataFrame, sessions: DataFrame | None = None, messages: DataFrame | None = None, limit: int = 0, previews: bool = False, mask: bool = True, sort: str = "date",
    embed: Callable | None = None, pool: int = 50, **given,
) -> DataFrame:
    """Events that fit all facets, by time (nulls last), then session and seq.

    sort = relevance: by the score of the text facet first. sort = semantic: of these the first ``pool`` by a blend with their
    likeness to the text facet, as ``embed`` sees it (see ``search.similar``); the others follow by score. Without
    ``embed`` that is relevance. Neither has a meaning without text facet: then it's by time.
    sessions: only their events (a semi-join); messages: adds each event's intent. Masks and cuts keep the order.
    """
    _check("sort", sort, ("date", "relevance", "semantic"))
    out = events.where(facets(**given))
    if sessions is not None:
        out = out.join(sessions.select(*SESSION), list(SESSION), "left_semi")
    order = [F.col("ts").asc_nulls_last(), F.col("session_id"), F.col("seq")]
    if sort != "date" and given.get("text"):
        out = bm25(out.withColumn("_hay", F.concat_ws("\n", "text", "body")), "id", "_hay", given["text"]).drop("_hay")
        if sort == "semantic" and embed is not None:
            out = semantic(out, given["text"], embed, [F.desc("score"), *order], pool)
            order = [F.asc_nulls_last("position"), F.desc("score"), *order]
        else:
            order = [F.desc("score"), *order]
    if limit:
        # the intent is looked up for these rows only
        out = out.orderBy(*order).limit(limit)
    if messages is not None:
        out = with_intent(out, messages)
    out = out.orderBy(*order)
    if mask:
        out = redacted(out, [c for c in ("text", "body", "intent") if c in out.columns])
    if previews:
        out = out.withColumn("text", preview(F.col("text")))
    return out


def walk(events: DataFrame, anchors: DataFrame, step_type: str, direction: str, n: int = 1) -> DataFrame:
    """The n nearest events of a type (0: all) before or after each anchor (agent, session_id, seq); anchor_seq tells whose.

    Steps are numbered within their session, and an anchor learns the number of the last step up to it. So it meets n rows by their
    numbers, not all of its session. With n = 0 each anchor comes with all its steps, as many as the answer has.
    """
    _check("direction", direction, ("prev", "next"))
    back = direction == "prev"
    steps = events.where(facets(type=step_type))
    a = anchors.select(*SESSION, F.col("seq").alias("anchor_seq"))
    if not n:
        return steps.join(a, list(SESSION)).where(F.col("seq") < F.col("anchor_seq") if back else F.col("seq") > F.col("anchor_seq"))
    number, last = unused(events, "_number"), unused(events, "_last")
    marks = steps.select(*SESSION, F.col("seq").alias("at"), F.lit(1).alias("step")).unionByName(a.select(*SESSION, F.col("anchor_seq").alias("at"), F.lit(0).alias("step")))
    # an anchor's own seq counts as before it when looking ahead, and as after it when looking back
    place = Window.partitionBy(*SESSION).orderBy("at", "step" if back else F.desc("step"))
    known = marks.withColumn(last, F.sum("step").over(place.rowsBetween(Window.unboundedPreceding, 0))).where("step = 0").select(*SESSION, F.col("at").alias("anchor_seq"), last)
    wanted = F.sequence(F.lit(1), F.lit(n))
    known = known.select(*SESSION, "anchor_seq", last, F.explode(wanted).alias("distance"))
    known = known.withColumn(number, F.col(last) + F.col("distance") if not back else F.col(last) + 1 - F.col("distance")).where(F.col(number) > 0)
    numbered = steps.withColumn(number, F.row_number().over(Window.partitionBy(*SESSION).orderBy("seq")))
    return numbered.join(known, [*SESSION, number]).select(*events.columns, "anchor_seq", "distance")


def neighbours(events: DataFrame, step_type: str, direction: str, n: int = 1) -> DataFrame:
    """Every event with the texts of its n nearest events of a type before or after it, in timeline order: one window, no join."""
    text = F.when(facets(type=step_type), F.struct("seq", "text"))
    w = Window.partitionBy(*SESSION).orderBy("seq" if direction == "prev" else F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    if n == 1:
        return events.withColumn("near", F.array_compact(F.array(F.last(text, ignorenulls=True).over(w)["text"])))
    rank = F.sum(F.when(facets(type=step_type), 1).otherwise(0)).over(Window.partitionBy(*SESSION).orderBy("seq" if direction == "prev" else F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("_rank", rank)
    steps = rows.where(facets(type=step_type)).select(*SESSION, F.col("_rank").alias("_r"), F.col("seq").alias("_s"), F.col("text").alias("_t"))
    own = F.col("_rank") - F.when(facets(type=step_type), 1).otherwise(0)
    wanted = rows.withColumn("_r", F.explode_outer(F.when(own > 0, F.sequence(F.greatest(own - n + 1, F.lit(1)), own))))
    found = wanted.join(steps, [*SESSION, "_r"], "left").groupBy(*SESSION, "seq").agg(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_s", "_t")))).alias("near"))
    return events.join(found.withColumn("near", F.transform("near", lambda x: x["_t"])), [*SESSION, "seq"])


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 0, most: int = 1000) -> DataFrame:
    """A page of at most `most` rows in the given order (0: as many as allowed), however far down it is."""
    return slice_of(rows, order, offset, min(limit, most) if limit > 0 else most)


def byte_budget(rows: DataFrame, order: Sequence[str], budget: int = 4_000_000, by: Sequence[str] = ()) -> DataFrame:
    """The first rows (of each group) that fit a budget of serialised size, the first always. Sizes are added up by range, so a group,
    or the whole table, may be of any size."""
    size, total, n = (unused(rows, c) for c in ("_size", "_sum", "_n"))
    sized = rows.withColumn(size, F.length(F.to_json(F.struct(*rows.columns))))
    out = running(sized, order, by, n, {total: size})
    return out.where((F.col(total) <= budget) | (F.col(n) == 0)).drop(size, total, n)
