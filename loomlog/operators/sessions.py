"""Session trees, inventories, statistics, recency and lookups."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import MASK
from ..functions.text import has_secret, redacted, secret_types
from ..tables import cut
from .aggregate import UNKNOWN, aggregate, totals
from .normalise import previous_text
from .ranks import running, slice_of


def children(sessions: DataFrame) -> DataFrame:
    """(agent, parent_id, session_id): direct children, within an agent."""
    p = sessions.select("agent", F.col("session_id").alias("parent_id"))
    c = sessions.where("parent_uuid is not null").select("agent", F.col("parent_uuid").alias("parent_id"), "session_id")
    return p.join(c, ["agent", "parent_id"])


def descendants(edges: DataFrame, roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, root, id): everything below each root along (by, parent, child), the root itself left out; cycles end by themselves.

    ``by`` names columns, such as the agent, within which ids are told apart. The way up is doubled in each round: a node knows
    the roots up to n steps above it, and learns those of its ancestors n steps above. So a tree of depth d takes about
    log2(d) rounds, and ends when no node has learned anything; ids without edge and null ids have nothing below.
    """
    by = list(by)
    ups = cut(edges.select(*by, F.col("child").alias("id"), F.col("parent").alias("up")).where("id is not null and up is not null").distinct())
    starts = roots.select(*by, F.col("id").alias("up")).distinct()
    # broadcast only what Spark knows to be small
    known = cut(ups.join(starts, [*by, "up"], "left_semi").withColumnRenamed("up", "root"))
    count = -1
    while (now := known.count()) != count:
        count = now
        above = known.select(*by, F.col("id").alias("up"), "root")
        known = cut(known.unionByName(ups.join(above, [*by, "up"]).select(*known.columns)).distinct())
        ups = cut(ups.join(ups.select(*by, F.col("id").alias("up"), F.col("up").alias("further")), [*by, "up"]).select(*by, "id", F.col("further").alias("up")).distinct())
    return known.where("root <> id").select(*by, "root", "id")


def full_overlay(a: DataFrame, b: DataFrame, key: str, prefer_b: list[str], prefer_a: list[str]) -> DataFrame:
    """Rows of two roots with one key: columns preferred from one side fall back to the other; in_a and in_b tell where it was."""
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key], F.lit(True).alias("_a"))
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key], F.lit(True).alias("_b"))
    j = x.join(y, key, "full_outer")
    return j.select(key, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in prefer_b], *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in prefer_a], F.coalesce("_a", F.lit(False)).alias("in_a"), F.coalesce("_b", F.lit(False)).alias("in_b"))


def inventory(sessions: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest sessions first, each with the total of all and whether the page leaves later ones out. limit 0: all that follow."""
    return with_total(slice_of(sessions, [F.desc_nulls_last("date"), F.asc("session_id")], offset, limit), sessions, offset + limit if limit else None)


def with_total(page: DataFrame, whole: DataFrame, until: int | None = None) -> DataFrame:
    """The page's rows with total, the number of all rows, and truncated: whether there are more than until (None: never)."""
    total = whole.agg(F.count(F.lit(1)).alias("total"))
    out = page.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("truncated", F.lit(False) if until is None else F.col("total") > until)


def last_models(messages: DataFrame) -> DataFrame:
    """(agent, session_id, model): the last model that an assistant's message names; null where none does."""
    named = F.when((F.col("role") == "assistant") & (F.col("model") != ""), F.col("message_index"))
    return messages.groupBy("agent", "session_id").agg(F.max_by("model", named).alias("model"))


def recency(sessions: DataFrame, now: Column, threshold: int = 600) -> DataFrame:
    """age_sec since the last activity, never negative, and whether it is over the threshold. now is an argument, never read from a clock."""
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("date"))
    return sessions.withColumn("age_sec", age).withColumn("stale", F.col("age_sec") > threshold)


def label_of(group_by: str) -> Column:
    """The label of a session in statistics."""
    models = F.size(F.coalesce("models", F.array().cast("array<string>")))
    return {
        "agent": F.coalesce("agent", F.lit(UNKNOWN)),
        "dir": F.coalesce(F.nullif("project_dir", F.lit("")), F.lit(UNKNOWN)),
        "date": F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("(undated)")),
        "kind": F.coalesce("kind", F.lit("main")),
        "model": F.when(models == 1, F.get("models", F.lit(0))).when(models > 1, "(mixed)").otherwise(UNKNOWN),
    }[group_by]


def session_stats(sessions: DataFrame, edits: DataFrame, group_by: str = "agent", top: int = 0, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Statistics by label, and totals, of sessions with the edits (session_id, intent) made in them."""
    if group_by not in ("agent", "dir", "date", "kind", "model"):
        raise ValueError(f"can't group by {group_by}")
    made = edits.groupBy("session_id").agg(F.count(F.lit(1)).alias("edits"), F.collect_set(F.nullif(F.trim("intent"), F.lit(""))).alias("intents"))
    rows = sessions.join(made, "session_id", "left").withColumn("edits", F.coalesce("edits", F.lit(0)))
    metrics = ["sessions", "edits", "intents", "messages", "agents"]
    if tokens is not None:
        rows = rows.join(tokens.select("session_id", "tokens", "token_source"), "session_id", "left")
        metrics.append("tokens")
    rows = rows.withColumn("label", label_of(group_by))
    return aggregate(rows, "label", metrics, "stats", top), totals(rows, metrics, kind_split=True)


def diagnostics(sessions: DataFrame) -> DataFrame:
    """What a corpus holds: per agent its sessions and dates. For explaining an empty result."""
    return sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"))


def hints(sessions: DataFrame, since=None, until=None, wanted: DataFrame | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """(hint): why a query with these filters may be empty: dates outside the corpus, unknown ids, texts that are or hold masks."""
    span = sessions.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    late = F.when(F.lit(since).cast("timestamp") > F.col("last"), F.concat(F.lit("since is after the last session, "), F.date_format("last", "yyyy-MM-dd")))
    early = F.when(F.lit(until).cast("timestamp") < F.col("first"), F.concat(F.lit("until is before the first session, "), F.date_format("first", "yyyy-MM-dd")))
    said = [F.when(F.lit(MASK in t), F.lit(f"{t!r} holds a mask; stored texts hold none")).otherwise(F.when(has_secret(F.lit(t)), F.concat(F.lit("a text looks like a secret ("), F.array_join(secret_types(F.lit(t)), ", "), F.lit(") and would be shown masked")))) for t in texts]
    out = span.select(F.explode(F.array_compact(F.array(late, early, F.when(F.col("last").isNull(), F.lit("there are no sessions")), *said))).alias("hint"))
    if wanted is not None:
        out = out.unionByName(missing(wanted, sessions).select(F.concat(F.lit("no session has the id "), "session_id").alias("hint")))
    return out


def missing(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """The wanted session ids that don't exist."""
    return wanted.join(sessions.select("session_id"), "session_id", "left_anti")


def locate(sessions: DataFrame, needle: str) -> DataFrame:
    """Sessions whose id or path stem starts with the needle (how = id) or whose title holds it (title), latest first."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1), r"\.[^.]*$", "")
    by_id = F.startswith("session_id", F.lit(needle)) | stem.startswith(needle)
    how = F.when(by_id, "id").when(F.contains(F.lower("title"), F.lit(needle.lower())), "title")
    out = sessions.withColumn("how", how).where("how is not null").withColumn("readable", F.col("message_count") > 0)
    return out.orderBy(F.desc_nulls_last("date"), "session_id")


def _likeness_bound(title: Column, needle: str) -> Column:
    """No ratio of matching runs is above this one: twice the letters that both hold, by number, over both lengths."""
    times = {c: needle.count(c) for c in sorted(set(needle))}
    shared = sum((F.least(F.length(title) - F.length(F.replace(title, F.lit(c), F.lit(""))), F.lit(n)) for c, n in times.items()), F.lit(0))
    return F.when(F.length(title) + len(needle) > 0, 2.0 * shared / (F.length(title) + len(needle))).otherwise(1.0)


def closest_titles(sessions: DataFrame, needle: str, ratio: float = 0.5, n: int = 3, first: int = 64) -> DataFrame:
    """(title, ratio): the titles most like the needle, for when locate finds none.

    All titles get an upper bound of their ratio by their letters, in the JVM. The ratios of those with the highest bounds are
    worked out, and then only of titles whose bound isn't below the n-th best of these.
    """
    needle = needle.lower()

    @F.pandas_udf("double")
    def like(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: difflib.SequenceMatcher(None, needle, t).ratio())

    title = F.lower(F.coalesce("title", F.lit("")))
    titles = cut(sessions.select("title").distinct().withColumn("bound", _likeness_bound(title, needle)).where(F.col("bound") >= ratio - 1e-9))
    best = titles.orderBy(F.desc("bound"), "title").limit(first).withColumn("ratio", like(title)).orderBy(F.desc("ratio")).limit(n)
    known, least = best.agg(F.count(F.lit(1)), F.min("ratio")).head()
    least = max(ratio, least if known == n else ratio)
    return titles.where(F.col("bound") >= least - 1e-9).withColumn("ratio", like(title)).where(F.col("ratio") >= ratio).orderBy(F.desc("ratio"), "title").limit(n).select("title", "ratio")


def read(messages: DataFrame, session_id: str, offset: int = 0, limit: int = 0, thinking: bool = False, most: int = 1000, below: DataFrame | None = None) -> DataFrame:
    """A session's rows (session_id, role, content, ts, model, intent, qa, tokens): text, then questions with answers, tool inputs
    and results; rows without content are dropped. below: (session_id) of sub-sessions whose rows follow the session's own."""
    asked = F.transform("qa", lambda q: F.concat(F.lit("Q: "), q["question"], F.lit(" A: "), F.coalesce(q["answer"], F.lit(""))))
    calls = F.transform("tool_use", lambda t: F.concat(F.lit("["), t["name"], F.lit("] "), F.coalesce(t["input"], F.lit(""))))
    told = F.transform("tool_result", lambda r: r["content"])
    content = F.concat_ws("\n", F.nullif("text", F.lit("")), *([F.col("thinking")] if thinking else []), asked, calls, told)
    own = messages.where(F.col("session_id") == session_id)
    if below is not None:
        own = own.unionByName(messages.join(below.select("session_id").where(F.col("session_id") != session_id).distinct(), "session_id", "left_semi").select(*messages.columns))
    rows = previous_text(own).select("session_id", "message_index", "role", content.alias("content"), "ts", "model", "intent", "qa", "tokens").where("content <> ''")
    n = F.col("n")
    rows = running(rows, [F.col("session_id") != session_id, "session_id", "message_index"], rank="n").where((n >= offset) & (n < offset + (min(limit, most) if limit > 0 else most)))
    return redacted(rows.drop("n"), ["content", "intent", "qa"])
