"""Audits: dangerous commands, network requests, session outcomes, quality signals, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import blank, fragment, host, json_path, labels, redacted, request_risks, strip
from ..tables import cut, sorted_join
from .normalise import SESSION, decode
from .ranks import slice_of


def command_of(raw: Column) -> Column:
    """The shell command in a tool input: a string or a list of strings under one of the command keys, else the input itself."""
    v = decode(raw)
    found = []
    for k in D.COMMAND_KEYS:
        found += [F.when(json_path(v, f"$.{k}").rlike(r"\S"), json_path(v, f"$.{k}")), F.when(F.size(json_path(v, f"$.{k}", "array<string>")) > 0, F.array_join(json_path(v, f"$.{k}", "array<string>"), " "))]
    return F.coalesce(*found, json_path(v, "$"), raw)


def reaction(messages: DataFrame, table, window: int = 6) -> DataFrame:
    """Messages with the first of the next `window` messages (any role) whose text fires: offset, role, labels and text."""
    if window < 1:
        return messages.withColumn("reaction", F.lit(None).cast("struct<offset:bigint,role:string,labels:array<string>,text:string>"))
    w = Window.partitionBy(*SESSION).orderBy("message_index").rowsBetween(1, window)
    told = messages.withColumn("_l", labels(F.col("text"), table))
    hit = F.when(F.size("_l") > 0, F.struct("message_index", "role", F.col("_l").alias("labels"), "text"))
    told = told.withColumn("_r", F.first(hit, ignorenulls=True).over(w))
    made = F.struct((F.col("_r.message_index") - F.col("message_index")).alias("offset"), F.col("_r.role").alias("role"), F.col("_r.labels").alias("labels"), F.col("_r.text").alias("text"))
    return told.withColumn("reaction", F.when(F.col("_r").isNotNull(), made)).drop("_l", "_r")


def dangerous(calls: DataFrame) -> DataFrame:
    """Shell calls with their command and the patterns that fired, those without left out. The command is worked out once for all patterns."""
    found = F.get(F.transform(F.array(command_of(F.col("body"))), lambda c: F.struct(c.alias("command"), labels(c, D.DANGER).alias("patterns"))), F.lit(0))
    return calls.withColumn("_found", found).where(F.size("_found.patterns") > 0).select(*calls.columns, "_found.command", "_found.patterns")


def incidents(events: DataFrame, messages: DataFrame, category: str | None = None, confirmed: str = "include", reaction_window: int = 6, mask: bool = True, limit: int | None = None) -> DataFrame:
    """Dangerous shell commands with the patterns that fired, and the regret that followed, if any.

    With ``limit`` (0: none) the first by time, each with the count and confirmed_count of all and whether that leaves some out
    (truncated); masks and fragments are made for these only. The few hits are written once, so all commands are read once.
    """
    if confirmed not in ("include", "only", "exclude"):
        raise ValueError(f"confirmed must be include, only or exclude, not {confirmed!r}")
    if category is not None and category not in {p.split(".")[0] for p, _ in D.DANGER}:
        raise ValueError(f"unknown category {category!r}")
    calls = dangerous(events.where("type = 'tool_call(bash)'"))
    if category:
        calls = calls.where(F.exists("patterns", lambda p: p.startswith(category + ".")))
    calls = cut(calls)
    # reactions are looked for in sessions with a hit only
    near = messages.select(*SESSION, "message_index", "role", "text").join(calls.select(*SESSION).distinct(), list(SESSION), "left_semi")
    rows = calls.join(sorted_join(reaction(near, D.REGRET, reaction_window).select(*SESSION, "message_index", "reaction")), [*SESSION, "message_index"], "left")
    rows = rows.withColumn("confirmed", F.col("reaction").isNotNull())
    if confirmed != "include":
        rows = rows.where(F.col("confirmed") == (confirmed == "only"))
    if limit is not None:
        rows = cut(rows)
        totals = rows.agg(F.count(F.lit(1)).alias("count"), F.count_if("confirmed").alias("confirmed_count"))
        rows = slice_of(rows, [F.asc_nulls_last("ts"), F.asc("id")], 0, limit) if limit else rows
        rows = rows.crossJoin(F.broadcast(totals)).withColumn("truncated", F.col("count") > limit if limit else F.lit(False))  # one row
    first = F.array_min(F.array_compact(F.array(*[F.nullif(F.regexp_instr("command", F.lit(p)), F.lit(0)) for _, p in D.DANGER])))
    rows = rows.withColumn("fragment", fragment(F.col("command"), F.coalesce(first, F.lit(1)) - 1, 500, 100))
    return redacted(rows, ["command", "fragment"]) if mask else rows


def multi_counts(rows: DataFrame, column: str) -> DataFrame:
    """(label, count) of a list column over all rows."""
    return rows.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def request_of(raw: Column) -> tuple[Column, Column]:
    """(url, query) of a web call: the url key, else the first link of the prompt or of a bare string."""
    v = decode(raw)
    text = lambda k: F.nullif(F.trim(json_path(v, f"$.{k}")), F.lit(""))
    bare = F.when(F.coalesce(F.schema_of_variant(v), F.lit("STRING")) == "STRING", F.coalesce(json_path(v, "$"), raw))
    loose = F.nullif(F.regexp_extract(F.coalesce(text("prompt"), bare), D.URL_IN_TEXT, 0), F.lit(""))
    return F.coalesce(text("url"), loose), text("query")


def network(events: DataFrame, kind: str | None = None, risk: str = "include", domain: str | None = None, mask: bool = True) -> DataFrame:
    """Web calls with url, query, host, request_kind and risks."""
    if kind not in (None, "fetch", "search"):
        raise ValueError(f"kind must be fetch or search, not {kind!r}")
    if risk not in ("include", "only", "exclude"):
        raise ValueError(f"risk must be include, only or exclude, not {risk!r}")
    url, query = request_of(F.col("body"))
    rows = events.where("tool_kind = 'web'").withColumn("url", url).withColumn("query", query)
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("risks", request_risks(F.col("url"), F.col("query")))
    rows = rows.withColumn("request_kind", F.when(F.col("url").isNotNull(), "fetch").when(F.col("query").isNotNull(), "search"))
    if kind:
        rows = rows.where(F.col("request_kind") == kind)
    if risk != "include":
        rows = rows.where((F.size("risks") > 0) == (risk == "only"))
    if domain:
        d = domain.lower()
        rows = rows.where((F.col("host") == d) | F.col("host").endswith("." + d))
    return redacted(rows, ["url", "query"]) if mask else rows


def network_totals(requests: DataFrame) -> DataFrame:
    """(by, label, requests, risky) of network()'s rows: one row over all (by = all), one per host, one per risk."""
    risky = F.when(F.size("risks") > 0, 1).otherwise(0)
    rows = requests.select(risky.alias("risky"), F.explode(F.concat(F.array(F.struct(F.lit("all").alias("by"), F.lit("").alias("label"))), F.array_compact(F.array(F.when(F.col("host").isNotNull(), F.struct(F.lit("host").alias("by"), F.col("host").alias("label"))))), F.transform("risks", lambda r: F.struct(F.lit("risk").alias("by"), r.alias("label"))))).alias("x"))
    return rows.groupBy("x.by", "x.label").agg(F.count(F.lit(1)).alias("requests"), F.sum("risky").alias("risky"))


def is_human(text: Column) -> Column:
    """A user's own words: no wrapper, placeholder or long paste."""
    t = strip(text)
    out = (F.length(t) > 0) & (F.length(t) <= 10_000)
    for p in D.NON_HUMAN_PREFIXES:
        out = out & ~t.startswith(p)
    for m in D.NON_HUMAN_MARKERS:
        out = out & ~F.contains(t, F.lit(m))
    return out


def last_user_texts(messages: DataFrame, n: int = 3) -> DataFrame:
    """(agent, session_id, tail): the last n human user texts, oldest first, one per line."""
    w = Window.partitionBy(*SESSION).orderBy(F.desc("message_index"))
    rows = messages.where((F.col("role") == "user") & is_human(F.col("text"))).select(*SESSION, "message_index", strip(F.col("text")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return rows.groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]), "\n").alias("tail"))


def outcomes(messages: DataFrame) -> DataFrame:
    """Per session: status (success, failure, mixed, unknown) from the user's last words and the error rate of tool results."""
    errors = messages.select(*SESSION, F.explode("tool_result").alias("r")).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("tool_results"), F.count_if(F.col("r.is_error")).alias("n_errors"))
    rows = messages.select(*SESSION).distinct().join(last_user_texts(messages), list(SESSION), "left").join(errors, list(SESSION), "left")
    reliable = F.col("agent").isin(*D.RELIABLE_ERROR_AGENTS)
    rows = rows.withColumn("tool_results", F.coalesce("tool_results", F.lit(0))).withColumn("tool_errors", F.when(reliable, F.coalesce("n_errors", F.lit(0))))
    rows = rows.withColumn("error_rate", F.when(reliable & (F.col("tool_results") > 0), F.round(F.col("tool_errors") / F.col("tool_results"), 4)))
    tail = F.coalesce("tail", F.lit(""))
    rows = rows.withColumn("positive", labels(tail, D.POSITIVE)).withColumn("negative", labels(tail, D.NEGATIVE))
    return rows.withColumn("verdict", verdict(F.size("positive"), F.size("negative"))).withColumn("status", status(F.col("verdict"), F.coalesce((F.col("tool_results") >= 4) & (F.col("error_rate") >= 0.5), F.lit(False)))).drop("tail", "n_errors")


def verdict(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")


def status(said: Column, mostly_errors: Column) -> Column:
    return F.when(said == "negative", "failure").when(said == "positive", F.when(mostly_errors, "mixed").otherwise("success")).when(mostly_errors, "failure").otherwise("unknown")


def quality_signals(messages: DataFrame) -> DataFrame:
    """Per session: lint and verification mentions, tool calls after the last error, test runners seen."""
    calls = F.transform("tool_use", lambda t: F.concat_ws("\n", t["name"], t["input"]))
    hay = F.lower(F.concat_ws("\n", "text", calls))
    told = F.transform("tool_result", lambda r: F.lower(r["content"]))
    rows = messages.withColumn("_hay", hay).withColumn("_all", F.concat_ws("\n", "_hay", told)).withColumn("_err", F.coalesce(F.exists(told, lambda c: c.rlike("|".join(D.ERROR_SIGNS))), F.lit(False)))
    last = F.max(F.when(F.col("_err"), F.col("message_index"))).over(Window.partitionBy(*SESSION))
    rows = rows.withColumn("_last", last)
    lint = sum((F.regexp_count("_hay", F.lit(rf"\b{x}\b")) for x in D.LINT), F.lit(0))
    verify = sum((F.regexp_count("_hay", F.lit(p)) for _, p in D.VERIFY), F.lit(0))
    runners = labels(F.col("_all"), D.TEST_RUNNERS)
    return rows.groupBy(*SESSION).agg(F.sum(lint).alias("lint_runs"), F.sum(verify).alias("verifications"), F.coalesce(F.sum(F.when(F.col("message_index") > F.col("_last"), F.greatest(F.size("tool_use"), F.lit(0)))), F.lit(0)).alias("calls_after_last_error"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(runners)))).alias("test_runners"))


def test_evidence(messages: DataFrame) -> DataFrame:
    """(agent, session_id, runner, surface): each test runner that a session names and where: text, tool_use[name].name,
    tool_use[name].input or tool_result.content. A pattern is looked for within one surface at a time."""
    piece = lambda surface, text: F.struct(surface.alias("surface"), F.lower(F.coalesce(text, F.lit(""))).alias("said"))
    called = lambda t, part: F.concat(F.lit("tool_use["), F.coalesce(t["name"], F.lit("")), F.lit(f"].{part}"))
    given = F.flatten(F.transform("tool_use", lambda t: F.array(piece(called(t, "name"), t["name"]), piece(called(t, "input"), t["input"]))))
    told = F.transform("tool_result", lambda r: piece(F.lit("tool_result.content"), r["content"]))
    none = F.array().cast("array<struct<surface:string,said:string>>")
    rows = messages.select(*SESSION, F.explode(F.concat(F.array(piece(F.lit("text"), F.col("text"))), F.coalesce(given, none), F.coalesce(told, none))).alias("p"))
    found = rows.select(*SESSION, F.col("p.surface").alias("surface"), labels(F.col("p.said"), D.TEST_RUNNERS).alias("runners"))
    return found.select(*SESSION, F.explode("runners").alias("runner"), "surface").distinct()


def decisions(messages: DataFrame, most: int = 10, most_chars: int = 200) -> DataFrame:
    """(agent, session_id, n, decision): an assistant's sentences with a decision and something technical."""
    rows = messages.where("role = 'assistant'").select(*SESSION, "message_index", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "s"))
    rows = rows.withColumn("s", strip(F.col("s"))).where(F.col("s").rlike(D.DECISION) & F.col("s").rlike(D.TECHNICAL))
    w = Window.partitionBy(*SESSION).orderBy("message_index", "pos")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(*SESSION, "n", F.left("s", F.lit(most_chars)).alias("decision"))


def task_summaries(messages: DataFrame) -> DataFrame:
    """(agent, session_id, summary): the first sentence of the last user text, or of the one before a short last word."""
    w = Window.partitionBy(*SESSION).orderBy(F.desc("message_index"))
    rows = messages.where((F.col("role") == "user") & ~blank(F.col("text"))).select(*SESSION, "message_index", strip(F.col("text")).alias("text")).withColumn("n", F.row_number().over(w)).where("n <= 2")
    pair = rows.groupBy(*SESSION).agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("last"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("prior"))
    short = F.size(F.split("last", r"\s+")) <= 3
    chosen = F.when(short & F.col("prior").isNotNull(), F.col("prior")).otherwise(F.col("last"))
    first = strip(F.get(F.split(chosen, r"(?<=[.!?])\s+"), F.lit(0)))
    words = F.filter(F.split(first, r"\s+"), lambda x: ~F.lower(x).isin(*D.STOPWORDS))
    return pair.select(*SESSION, F.array_join(words, " ").alias("summary"))


def verb_usage(calls: DataFrame, declared: DataFrame, since=None) -> DataFrame:
    """(tool, calls, params_used, undeclared, unused) of each declared or called tool, sorted names; since: only calls from then on."""
    rows = calls if since is None else calls.where(F.col("ts") >= F.lit(since))
    n = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    params = parameter_usage(rows, declared).groupBy("tool").agg(*[F.array_sort(F.collect_set(F.when(x, F.col("param")))).alias(name) for name, x in (("params_used", F.col("calls") > 0), ("undeclared", ~F.col("declared")), ("unused", F.col("declared") & (F.col("calls") == 0)))])
    return n.join(params, "tool", "full_outer").select("tool", F.coalesce("calls", F.lit(0)).alias("calls"), "params_used", "undeclared", "unused")


def parameter_usage(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """(tool, param, declared, calls): input keys used, against those declared(tool, param)."""
    keys = F.explode(F.json_object_keys("body"))
    used = calls.select("tool", keys.alias("param")).groupBy("tool", "param").agg(F.count(F.lit(1)).alias("calls"))
    return declared.withColumn("declared", F.lit(True)).join(used, ["tool", "param"], "full_outer").select("tool", "param", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("calls", F.lit(0)).alias("calls"))


def unmentioned_files(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, file, mentioned): whether an assistant text or tool input of the session has the file's base name.

    Each message is read against the names of its own session; no session is gathered in one row.
    """
    hay = F.concat_ws("\n", "text", F.transform("tool_use", lambda t: t["input"]))
    named = files.select("session_id", "file").distinct().withColumn("base", F.element_at(F.split("file", "/"), -1))
    said = messages.where("role = 'assistant'").select("session_id", hay.alias("hay")).where("hay <> ''")
    found = named.join(said, "session_id").where(F.contains("hay", F.col("base"))).select("session_id", "file").distinct().withColumn("mentioned", F.lit(True))
    return files.select("session_id", "file").join(found, ["session_id", "file"], "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))


def required_sections(notes: DataFrame, required: list[str]) -> DataFrame:
    """(note, section) of the required level-two sections that a note lacks or leaves empty. notes: (note, text)."""
    part = F.explode(F.split("text", r"(?m)^## "))
    have = notes.select("note", part.alias("p")).select("note", F.trim(F.regexp_extract("p", r"^(.*)", 1)).alias("section"), F.regexp_replace(F.regexp_replace("p", r"^.*\n?", ""), r"(?s)<!--.*?-->", "").alias("body")).where(F.col("body").rlike(r"\S"))
    wanted = notes.select("note").withColumn("section", F.explode(F.array(*map(F.lit, required))))
    return wanted.join(have, ["note", "section"], "left_anti")

