"""Term search with BM25 over matched rows only, snippets, and re-ranking by vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..tables import cut
from .normalise import SESSION

K1, B = 1.5, 0.75


def parse(query: str) -> tuple[list[str], list[str]]:
    """Positive and negative terms, lower case; quoted phrases stay whole; an unclosed quote is an ordinary character."""
    positive, negative, i = [], [], 0
    while i < len(query):
        if query[i].isspace():
            i += 1
            continue
        minus = query[i] == "-" and i + 1 < len(query) and not query[i + 1].isspace()
        i += minus
        close = query.find(query[i], i + 1) if query[i] in "\"'" else -1
        if close > 0:
            term, i = query[i + 1 : close], close + 1
        else:
            end = next((j for j in range(i, len(query)) if query[j].isspace()), len(query))
            term, i = query[i:end], end
        if term:
            (negative if minus else positive).append(term.lower())
    return positive, negative


def matches(haystack: Column, positive: list[str], negative: list[str], operator: str = "AND") -> Column:
    """haystack is lower case. AND without positive terms is true where no negative one occurs; OR without them is false."""
    op = operator.upper()
    if op not in ("AND", "OR", "NOT"):
        raise ValueError(f"operator must be AND, OR or NOT, not {operator!r}")
    has = [F.contains(haystack, F.lit(t)) for t in positive]
    none = F.lit(True)
    for t in negative + (positive if op == "NOT" else []):
        none = none & ~F.contains(haystack, F.lit(t))
    if op == "NOT":
        return none
    some = F.lit(op == "AND")
    for h in has:
        some = some & h if op == "AND" else some | h
    return some & none


def tokenise(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """rows with a score; the corpus is these rows. Those without a query term keep 0, as do all for a query without tokens.

    Each row counts its own query terms, so nothing but the statistics of the terms is shuffled.
    """
    import re

    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    out = rows.withColumn("_tokens", tokenise(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_len", F.size("_tokens"))
    for i, t in enumerate(terms):
        out = out.withColumn(f"_tf{i}", F.size("_tokens") - F.size(F.array_remove("_tokens", t)))
    out = out.drop("_tokens")
    stats = out.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    out = out.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"_tf{i}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    return out.withColumn("score", score).select(*rows.columns, "score")


def haystacks(messages: DataFrame, thinking: bool = False, most_messages: int = 1000, most_chars: int = 1_000_000) -> DataFrame:
    """(agent, session_id, haystack): the lower-cased texts, inputs and results of a session's first messages, up to a length."""
    parts = F.concat_ws("\n", F.nullif("text", F.lit("")), *([F.nullif("thinking", F.lit(""))] if thinking else []), F.filter(F.transform("tool_use", lambda t: t["input"]), lambda x: x != ""), F.filter(F.transform("tool_result", lambda r: r["content"]), lambda x: x != ""))
    w = Window.partitionBy(*SESSION).orderBy("message_index")
    rows = messages.select(*SESSION, "message_index", parts.alias("part")).withColumn("n", F.row_number().over(w)).where((F.col("n") <= most_messages) & (F.col("part") != ""))
    rows = rows.withColumn("read", F.coalesce(F.sum(F.length("part") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("read") < most_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "part"))), lambda x: x["part"]), "\n")
    return rows.groupBy(*SESSION).agg(F.left(F.lower(joined), F.lit(most_chars)).alias("haystack"))


def spawned() -> Column:
    """Whether a session was started by another one."""
    return F.coalesce(F.col("kind") == "subagent", F.lit(False)) | F.col("parent_uuid").isNotNull()


def search_sessions(sessions: DataFrame, hay: DataFrame, query: str, scope: str = "all", operator: str = "AND", limit: int = 50, noise: str = "include", sort: str = "relevance", embed: Callable | None = None, pool: int = 50) -> DataFrame:
    """Sessions that match, with score and a snippet. scope: title, body or all.

    noise: with sub-sessions, without (exclude) or those only. sort: relevance, that is by score, then date; date; or semantic, by which
    the first ``pool`` by score go by a blend with the likeness of their titles to the query (without ``embed``: relevance).
    """
    for name, value, allowed in (("scope", scope, ("title", "body", "all")), ("noise", noise, ("include", "exclude", "only")), ("sort", sort, ("relevance", "date", "semantic"))):
        if value not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    positive, negative = parse(query)
    if noise != "include":
        sessions = sessions.where(spawned() if noise == "only" else ~spawned())
    rows = sessions if scope == "title" else sessions.join(hay, list(SESSION), "left")
    title = F.lower(F.coalesce("title", F.lit("")))
    text = title if scope == "title" else F.coalesce("haystack", F.lit("")) if scope == "body" else F.concat_ws("\n", title, F.coalesce("haystack", F.lit("")))
    found = rows.withColumn("hay", text).where(matches(F.col("hay"), positive, negative, operator))
    scored = bm25(found, "session_id", "hay", query).withColumn("snippet", snippet(F.col("hay"), positive)).drop("haystack", "hay")
    newest = [F.desc_nulls_last("date"), F.asc("session_id")]
    order = newest if sort == "date" else [F.desc("score"), *newest]
    if sort == "semantic" and embed is not None:
        keyed = scored.withColumn("id", F.concat_ws("\x1f", *SESSION)).withColumn("text", F.col("title"))
        scored = semantic(keyed, query, embed, order, pool).drop("id", "text")
        order = [F.asc_nulls_last("position"), *order]
    out = scored.orderBy(*order)
    return out.limit(limit) if limit else out


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rerank(rows: DataFrame, similarity: str, score: str = "score", tie: str = "id", pool: int = 50, weight: float = 0.75) -> DataFrame:
    """The best rows by score, put in order of a blend of similarity and score, each scaled to 0..1 over this pool (0.5 if
    all are equal). position numbers the pool; rows beyond it have none and keep their score's order behind it."""
    best = rows.orderBy(F.desc(score), tie).limit(pool)
    whole = Window.partitionBy()  # the pool: at most `pool` rows
    part = lambda x: F.when(F.max(x).over(whole) > F.min(x).over(whole), (F.col(x) - F.min(x).over(whole)) / (F.max(x).over(whole) - F.min(x).over(whole))).otherwise(0.5)
    best = best.withColumn("blended", weight * part(similarity) + (1 - weight) * part(score))
    best = best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("blended"), F.desc(score), tie)))
    return rows.join(F.broadcast(best.select(tie, "blended", "position")), tie, "left").orderBy(F.asc_nulls_last("position"), F.desc(score), tie)


def similar(rows: DataFrame, text: str, embed: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "similarity") -> DataFrame:
    """rows with the cosine of their text's vector and the given text's, null where there is no text.

    ``embed`` loads a model and returns a function from texts to vectors; each task calls it once, for all of its batches.
    """

    @F.pandas_udf("double")
    def likeness(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = embed()
        wanted = np.asarray(vectors([text])[0], float)
        for texts in batches:
            known = texts.notna()
            out = pd.Series(np.nan, index=texts.index, dtype=float)
            if known.any():
                m = np.asarray(vectors(texts[known].tolist()), float)
                scale = np.linalg.norm(m, axis=1) * np.linalg.norm(wanted)
                out[known] = np.divide(m @ wanted, scale, out=np.zeros(len(m)), where=scale > 0)
            yield out

    return rows.withColumn(name, F.nanvl(likeness("text"), F.lit(None).cast("double")))


def semantic(rows: DataFrame, text: str, embed: Callable, order: Sequence[Column], pool: int = 50, weight: float = 0.75) -> DataFrame:
    """Scored events (id, score, text, ...) with similarity, blended and position; null for all but the first ``pool`` in the given
    order, which alone are embedded. They are few: at most ``pool`` rows are cut out and joined back."""
    first = cut(similar(rows.orderBy(*order).limit(pool).select("id", "score", "text"), text, embed).select("id", "score", F.coalesce("similarity", F.lit(0.0)).alias("similarity")))
    ranked = rerank(first, "similarity", "score", "id", pool, weight).select("id", "similarity", "blended", "position")
    return rows.join(F.broadcast(ranked), "id", "left")
