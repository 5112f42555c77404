"""Closest titles against all ratios, exports as files, semantic order over its pool, pages with totals."""

import difflib
import random

from pyspark.sql import functions as F

from loomlog.operators import brief, query, search, sessions
from loomlog.schema import MESSAGES, SESSIONS, conform


def test_closest_titles_equal_all_ratios(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    titles = sorted({" ".join(word() for _ in range(r.randint(1, 6))).capitalize() for _ in range(3_000)} | {"Fix the parser", "fix the parsers", "Fix teh parser", ""})
    df = spark.createDataFrame([(t,) for t in [*titles, *titles[:50], None]], "title string")
    for needle in ("fix the parser", "abc abd", "zzz", "Fix"):
        ratio = lambda t: difflib.SequenceMatcher(None, needle.lower(), t.lower()).ratio()
        want = sorted(((-ratio(t), t) for t in titles if ratio(t) >= 0.5))[:3]
        assert [(-x.ratio, x.title) for x in sessions.closest_titles(df, needle).collect()] == want
    bound = df.select(sessions._likeness_bound(F.lower(F.coalesce("title", F.lit(""))), "abc abd").alias("b"), "title").collect()
    assert all(x.b >= difflib.SequenceMatcher(None, "abc abd", (x.title or "").lower()).ratio() - 1e-9 for x in bound)


def test_few_titles_reach_python(spark):
    """Of many titles fewer than a tenth have their ratio worked out."""
    r = random.Random(4)
    rows = [("".join(r.choice("abcdefghijklmnop ") for _ in range(30)),) for _ in range(4_000)] + [("the quick brown fox",), ("the quick brown box",), ("a quick brown fox",)]
    df = spark.createDataFrame(rows, "title string")
    needle = "the quick brown fox"
    least = sorted((x.ratio for x in sessions.closest_titles(df, needle).collect()))[0]
    assert df.where(sessions._likeness_bound(F.col("title"), needle) >= least).count() < 400


def messages(spark, rows):
    tool = "array<struct<ord:int,name:string,input:string,tool_use_id:string,ts:timestamp>>"
    return conform(spark.createDataFrame(rows, f"agent string, session_id string, message_index long, role string, text string, tool_use {tool}"), MESSAGES)


def test_export(spark, tmp_path):
    call = lambda name, given: [(0, name, given, "t", None)]
    rows = [
        ("claude", "a/b", 0, "user", " Build it\nnow ", None),
        ("claude", "a/b", 1, "assistant", "We decided to use the parser.py module because the API needs it.", call("Edit", '{"file_path": "x.py"}')),
        ("claude", "a/b", 2, "assistant", "", call("Read", '{"path": "y.py", "file_path": ""}')),
        ("claude", "a/b", 3, "assistant", "", call("Write", '{"file_path": "x.py"}') + [(1, "Bash", '{"path": "no"}', "u", None)]),
        ("claude", "a/b", 4, "user", "z" * 300, None),
    ]
    s = spark.createDataFrame([("claude", "a/b", "Title", {"tokens": "0", "total_tokens": "12.0"}), ("pi", "a_b", None, None)], "agent string, session_id string, title string, extra map<string,string>")
    docs = brief.rounds(conform(s, SESSIONS), messages(spark, rows))
    got = {x.session_id: x.document for x in docs.collect()}
    assert got["a_b"] == "# Session: (untitled)\n\n**UUID**: a_b · **Agent**: pi · **Date**: None\n\n- None — pi — (untitled) [non-actionable]\n"
    head, body = got["a/b"].split("## Round: ")
    assert head.endswith("- None — claude — Title\n\n")
    parts = dict(p.split("\n", 1) for p in body.split("### ")[1:])
    assert {k: v.strip() for k, v in parts.items()} == {
        "Goal": "Build it", "Status": "in-progress", "Files touched": "- `x.py`\n- `y.py`", "Open": "z" * 199 + "…", "Next actions": "n/a", "Snapshot": "tokens: 12",
        "Decisions": parts["Decisions"].strip(),
    }
    done = brief.export(docs, str(tmp_path)).collect()
    names = {x.file for x in done}
    assert len(names) == 2 and "pi/a_b.md" in names and next(n for n in names if n != "pi/a_b.md").startswith("claude/a_b-")
    assert {(tmp_path / n).read_text() for n in names} == set(got.values())


def test_semantic_order(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed():
        def vectors(texts):
            calls.add(len(texts))
            return [[float("cat" in t), float("dog" in t)] for t in texts]

        return vectors

    texts = [f"{'cat' if i % 2 else 'dog'} sat {i}" for i in range(100)]
    e = spark.createDataFrame([(f"s:{i}", i, t) for i, t in enumerate(texts)], "id string, seq long, text string")
    scored = e.withColumn("score", 100.0 - F.col("seq"))
    out = search.semantic(scored, "a cat", embed, [F.desc("score")], pool=10).orderBy(F.asc_nulls_last("position"), F.desc("score")).collect()
    assert calls.value <= 10 + 1 * 20  # the pool once, the wanted text once a task
    assert [x.seq for x in out[:10]] == sorted(range(10), key=lambda i: (-(0.75 * (i % 2) + 0.25 * (9 - i) / 9), i)) and [x.seq for x in out[10:]] == list(range(10, 100))
    m = messages(spark, [("g", "s", i, "user", t, None) for i, t in enumerate(texts)])
    from loomlog.operators import normalise

    events = normalise.events(m)
    plain = [x.seq for x in query.query(events, text="cat", sort="relevance", mask=False).collect()]
    assert [x.seq for x in query.query(events, text="cat", sort="semantic", mask=False).collect()] == plain
    assert len(query.query(events, text="cat", sort="semantic", embed=embed, mask=False, limit=5).collect()) == 5


def test_walk_at_the_edges(spark):
    """Anchors that are steps themselves, that aren't events, and that have fewer steps than asked for."""
    rows = [("g", "s", i, "user_turn" if i % 3 == 0 else "assistant_turn") for i in range(10)] + [("g", "t", 0, "assistant_turn")]
    e = spark.createDataFrame(rows, "agent string, session_id string, seq long, type string")
    anchors = spark.createDataFrame([("g", "s", 3), ("g", "s", 4), ("g", "s", 99), ("g", "s", -1), ("g", "t", 0)], "agent string, session_id string, seq long")
    for direction in ("prev", "next"):
        for n in (0, 1, 2, 5):
            want = set()
            for _, s, a in [("g", "s", 3), ("g", "s", 4), ("g", "s", 99), ("g", "s", -1), ("g", "t", 0)]:
                near = sorted((abs(i - a), i) for _, s2, i, t in rows if s2 == s and t == "user_turn" and (i < a if direction == "prev" else i > a))
                want |= {(s, a, i, d) for d, (_, i) in enumerate(near[: n or None], 1)}
            got = query.walk(e, anchors, "user_turn", direction, n).collect()
            assert {(x.session_id, x.anchor_seq, x.seq, x.distance if n else None) for x in got} == {(s, a, i, d if n else None) for s, a, i, d in want} and len(got) == len(want)


def test_search_filters_and_semantic_titles(spark):
    s = conform(spark.createDataFrame([("g", str(i), "cat house" if i % 2 else "dog house", f"2025-01-{i + 1:02d}", "subagent" if i == 4 else None) for i in range(6)], "agent string, session_id string, title string, date string, kind string"), SESSIONS)
    hay = spark.createDataFrame([], "agent string, session_id string, haystack string")
    ids = lambda **kw: [x.session_id for x in search.search_sessions(s, hay, "house", scope="title", **kw).collect()]
    assert ids(sort="date") == ["5", "4", "3", "2", "1", "0"] and ids(sort="date", noise="exclude") == ["5", "3", "2", "1", "0"] and ids(noise="only") == ["4"]

    def embed():
        return lambda texts: [[float("cat" in t or t == "house"), 1.0] for t in texts]

    assert ids(sort="semantic", embed=embed)[:3] == ["1", "3", "5"] and ids(sort="semantic") == ids(sort="relevance")
