"""A budgeted digest of each session, and its Markdown form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, redact, strip
from ..sources.common import string
from ..sources.files import write_files
from .audit import decisions
from .normalise import SESSION
from .plan_events import revisions


def footprint(events: DataFrame, most_files: int = 20) -> DataFrame:
    """Per session: calls, calls by kind (kind:n, sorted), edited files (n × file, most edited first) and how many there are."""
    calls = events.where(F.col("type").startswith("tool_call("))
    kinds = calls.groupBy(*SESSION, "tool_kind").agg(F.count(F.lit(1)).alias("n")).groupBy(*SESSION).agg(F.sum("n").alias("calls"), F.array_join(F.array_sort(F.collect_list(F.format_string("%s:%d", "tool_kind", "n"))), ",").alias("by_kind"))
    files = calls.where("tool_kind in ('edit', 'write') and file is not null").groupBy(*SESSION, "file").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*SESSION).orderBy(F.desc("n"), "file")
    files = files.withColumn("r", F.row_number().over(w)).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most_files, F.struct("r", "n", "file")))), lambda x: F.format_string("%d× %s", x["n"], x["file"])), "\n").alias("files"))
    return kinds.join(files, list(SESSION), "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def audit_brief(events: DataFrame, messages: DataFrame, errors: DataFrame | None = None, budget: int = 15_000) -> DataFrame:
    """One digest per session. Over budget, error details go first, then the file list, then plan bodies; user turns are never cut."""
    turns = messages.where((F.col("role") == "user") & ~blank(F.col("text"))).groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: F.concat(F.lit("> "), x["text"])), "\n").alias("turns"))
    rows = turns.join(footprint(events), list(SESSION), "left")
    plan = revisions(events).groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.format_string("v%d %s: %s", "version", "kind", "title").alias("t")))), lambda x: x["t"]), "\n").alias("plan_titles"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("body", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("plan_bodies"))
    rows = rows.join(plan, list(SESSION), "left")
    if errors is not None:
        w = Window.partitionBy(*SESSION).orderBy("seq")
        some = errors.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "detail"))), lambda x: x["detail"]), "\n").alias("errors"))
        rows = rows.join(some, list(SESSION), "left")
    else:
        rows = rows.withColumn("errors", F.lit(None).cast("string"))
    part = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), F.col(c)))
    tools = F.concat(F.lit("## Tools\n"), F.coalesce(F.concat_ws(" ", F.col("calls").cast("string"), "by_kind"), F.lit("0")))
    # each part is masked once, whichever of the ladder is chosen
    parts = F.array(part("User", "turns"), part("Plans", "plan_titles"), tools, part("Plan bodies", "plan_bodies"), part("Files", "files"), part("Errors", "errors"))
    rows = rows.withColumn("_parts", F.transform(parts, lambda p: redact(p)["text"]))
    rows = rows.withColumns({f"_b{i}": F.array_join(F.slice("_parts", 1, n), "\n") for i, n in enumerate((6, 5, 4, 3))})
    chosen = F.coalesce(*[F.when(F.length(f"_b{i}") <= budget, F.col(f"_b{i}")) for i in range(4)], F.col("_b3"))
    level = F.coalesce(*[F.when(F.length(f"_b{i}") <= budget, F.lit(i)) for i in range(4)], F.lit(3))
    return rows.select(*SESSION, chosen.alias("brief"), level.alias("dropped"), (F.length("_b3") > budget).alias("over_budget"), "calls", "n_files")


def markdown(sessions: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """(agent, session_id, document): goal, files, decisions and last words of each session, for df.write.text."""
    user = messages.where((F.col("role") == "user") & ~blank(F.col("text")))
    goal = user.groupBy(*SESSION).agg(F.min_by("text", "message_index").alias("goal"), F.max_by("text", "message_index").alias("last"))
    made = decisions(messages).groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "decision"))), lambda x: F.concat(F.lit("- "), x["decision"])), "\n").alias("decisions"))
    rows = sessions.join(goal, list(SESSION), "left").join(made, list(SESSION), "left").join(footprint(events), list(SESSION), "left")
    section = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")))
    doc = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))), section("Goal", "goal"), section("Files touched", "files"), section("Decisions", "decisions"), section("Last request", "last"))
    return rows.select(*SESSION, doc.alias("document")).withColumn("document", redact(F.col("document"))["text"])


#: What the export calls tools that touch files, and the keys that name the file, in order of preference; fixed values.
FILE_TOOLS = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit", "read", "edit", "write")
PATH_KEYS = ("file_path", "notebook_path", "path")
SNAPSHOT_KEYS = ("tokens", "token_count", "total_tokens")


def _shortened(text, n: int = 200):
    """Trimmed, and cut to n characters with an ellipsis; null if nothing is left."""
    text = F.nullif(strip(text), F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def rounds(sessions: DataFrame, messages: DataFrame, mask: bool = True) -> DataFrame:
    """(agent, session_id, document): a Markdown document of each session with goal, status, files, decisions, what is open (the last
    message, if it is the user's), next actions (the last thing an assistant said) and a snapshot of its cost.

    A session without messages, with fewer than five, or without tool calls is marked as non-actionable.
    """
    at, role, text = F.col("message_index"), F.col("role"), F.coalesce("text", F.lit(""))
    user, own = role == "user", role == "assistant"
    told = messages.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(F.size("tool_use") > 0, F.lit(False))).alias("tools"),
        F.min_by(text, F.when(user, at)).alias("goal"),
        F.max_by(role, at).alias("last"),
        F.max_by(F.when(user, text), at).alias("open"),
        F.max_by(text, F.when(own, at)).alias("next"),
    )
    calls = messages.select(*SESSION, "message_index", F.explode("tool_use").alias("t")).where(F.col("t.name").isin(*FILE_TOOLS))
    v = F.try_parse_json(F.col("t.input"))
    path = F.coalesce(*[F.nullif(string(v, f"$.{k}"), F.lit("")) for k in PATH_KEYS])
    files = calls.select(*SESSION, path.alias("file"), F.struct("message_index", "t.ord").alias("at")).where("file is not null").groupBy(*SESSION, "file").agg(F.min("at").alias("at"))
    listed = lambda rows, order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    files = files.groupBy(*SESSION).agg(listed(files, "at", F.concat(F.lit("- `"), "file", F.lit("`"))).alias("files"))
    made = decisions(messages)
    made = made.groupBy(*SESSION).agg(listed(made, "n", F.concat(F.lit("- "), "decision")).alias("decisions"))
    rows = sessions.join(told, list(SESSION), "left").join(files, list(SESSION), "left").join(made, list(SESSION), "left")
    number = lambda k: F.expr(f"try_cast(extra['{k}'] as double)")
    cost = F.coalesce(*[F.when(number(k) != 0, F.concat(F.lit("tokens: "), number(k).cast("long"))) for k in SNAPSHOT_KEYS], F.when(number("cost") != 0, F.concat(F.lit("cost: "), F.element_at("extra", "cost"))))
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("None"))
    title = lambda other: F.coalesce(F.nullif("title", F.lit("")), F.lit(other))
    section = lambda name, body, none="n/a": F.concat(F.lit(f"### {name}\n"), F.coalesce(body, F.lit(none)))
    head = F.concat(F.lit("# Session: "), title("(untitled)"), F.lit("\n\n**UUID**: "), "session_id", F.lit(" · **Agent**: "), "agent", F.lit(" · **Date**: "), day, F.lit("\n\n- "), day, F.lit(" — "), "agent", F.lit(" — "), title("(untitled)"), F.when((F.coalesce("n", F.lit(0)) < 5) | ~F.coalesce("tools", F.lit(False)), " [non-actionable]").otherwise(""))
    goal = _shortened(F.regexp_extract(strip(F.coalesce("goal", F.lit(""))), r"^[^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]*", 0))
    parts = [section("Goal", goal), section("Status", F.when(F.col("last") == "assistant", "completed").otherwise("in-progress")), section("Files touched", F.col("files"), "(none)"), section("Decisions", F.col("decisions"), "(none)"), section("Open", _shortened(F.col("open"))), section("Next actions", _shortened(F.col("next"))), section("Snapshot", cost)]
    body = F.when(F.col("n").isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("## Round: "), title("Round")), *parts))
    out = rows.select(*SESSION, F.concat(F.concat_ws("\n\n", head, body), F.lit("\n")).alias("document"))
    return out.withColumn("document", redact(F.col("document"))["text"]) if mask else out


def export(documents: DataFrame, folder: str) -> DataFrame:
    """Write (agent, session_id, document) as one file each, folder/agent/session.md, when the result (file, lines, size) is computed.

    Characters other than letters, digits, dot, dash and underscore become underscores, and a name that has any gets a
    hash of the id at its end, so no two sessions share a file.
    """
    plain = F.regexp_replace("session_id", r"[^A-Za-z0-9._-]", "_")
    name = F.when(plain == F.col("session_id"), plain).otherwise(F.concat(plain, F.lit("-"), F.left(F.sha2("session_id", 256), F.lit(16))))
    return write_files(documents.select(F.concat_ws("/", "agent", F.concat(name, F.lit(".md"))).alias("file"), F.lit(0).alias("at"), F.col("document").alias("value")), folder, end="")
