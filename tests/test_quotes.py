"""Quotations against a search of all runs, closures of deep trees, deep pages and budgets."""

import random

from pyspark.sql import functions as F

from loomlog.operators import query, quotes, sessions


def longest(a, b):
    """(length, start in a, start in b), the first of the longest equal runs."""
    best, row = (0, 0, 0), {}
    for i, x in enumerate(a):
        new = {}
        for j, y in enumerate(b):
            if x == y:
                n = new[j] = row.get(j - 1, 0) + 1
                if (-n, i - n + 2, j - n + 2) < (-best[0], best[1], best[2]):
                    best = (n, i - n + 2, j - n + 2)
        row = new
    return best


def test_quotes_against_all_runs(spark):
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abé 😀") for _ in range(n))
    rows = []
    for s in range(12):
        told = []
        for i in range(14):
            if r.random() < 0.5:
                told.append(say(r.choice([0, 30, 90])) + r.choice(["", "xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy", "z" * 60]))
                rows.append(("g", f"s{s}", i, "assistant", told[-1]))
            else:
                x = r.choice(told or [""])
                lo = r.randrange(len(x) + 1)
                rows.append(("g", f"s{s}", i, r.choice(["user", "user", "system"]), say(5) + x[lo : lo + r.choice([10, 19, 20, 21, 45])] + say(r.choice([0, 8]))))
    df = spark.createDataFrame(rows, "agent string, session_id string, message_index long, role string, text string")
    want = set()
    for agent, s, i, role, text in rows:
        if role == "user" and text.strip():
            before = [(j, t) for _, s2, j, r2, t in rows if s2 == s and r2 == "assistant" and j < i and t.strip()][-3:]
            found = min(((-n, -j, x, y) for j, t in before for n, x, y in [longest(t, text)] if n >= 20), default=None)
            if found:
                n, j, _, y = found
                want.add((agent, s, i, -j, text[y - 1 : y - 1 - n], -n))
    got = {(x.agent, x.session_id, x.message_index, x.source_index, x.quote, x.length) for x in quotes.quotes(df, least=20, back=3).collect()}
    assert len(want) > 15 and got == want


def test_kept_pieces_meet_in_every_run():
    r = random.Random(2)
    for _ in range(300):
        run = "".join(r.choice("ab") for _ in range(40))
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 60))) + run + "".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(2))
        at, bt = a.index(run), b.index(run)
        (pa, ha), (pb, hb) = (quotes.kept_pieces(t, 40) for t in (a, b))
        inside = lambda p, h, lo: {(int(x) - lo, int(y)) for x, y in zip(p, h, strict=True) if lo <= x <= lo + 20}
        assert inside(pa, ha, at) & inside(pb, hb, bt)
        assert len(pa) < len(a) / 2 + 2


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    """Ten thousand levels; two agents with the same ids; a cycle; a child with two parents."""
    cuts, real = [], sessions.cut
    monkeypatch.setattr(sessions, "cut", lambda df: cuts.append(1) or real(df))
    edges = [("x", i, i + 1) for i in range(10_000)] + [("y", 1, 2), ("y", 2, 1), ("y", 1, 3), ("y", 4, 3), ("y", None, 5), ("y", 6, None)]
    df = spark.createDataFrame(edges, "agent string, parent long, child long").repartition(8)
    roots = spark.createDataFrame([("x", 0), ("x", 9_990), ("y", 1), ("y", 4), ("y", 77), ("y", None)], "agent string, id long")
    got = sessions.descendants(df, roots, ["agent"])
    assert {(r.agent, r.root): r.n for r in got.groupBy("agent", "root").agg(F.count("*").alias("n")).collect()} == {("x", 0): 10_000, ("x", 9_990): 10, ("y", 1): 2, ("y", 4): 1}
    assert {(r.root, r.id) for r in got.where("agent = 'y'").collect()} == {(1, 2), (1, 3), (4, 3)}
    assert (len(cuts) - 2) / 2 <= 20


def test_deep_pages_and_whole_budgets(spark):
    df = spark.range(60_000).select(F.col("id"), (F.col("id") * 7_919 % 60_000).alias("x"))
    assert [r.x for r in query.page(df, [F.col("x").desc()], 50_000, 5).collect()] == [9_999, 9_998, 9_997, 9_996, 9_995]
    assert [r.x for r in query.page(df, [F.col("x").asc()], 10, 3).collect()] == [10, 11, 12]
    rows = query.byte_budget(df, ["x"], 30_000)
    n, size = 0, 0
    for x in range(60_000):
        size += len(f'{{"id":{pow(7919, -1, 60_000) * x % 60_000},"x":{x}}}')
        if size > 30_000:
            break
        n += 1
    assert rows.count() == n and rows.agg(F.max("x")).head()[0] == n - 1
    assert query.byte_budget(df, ["x"], 1).count() == 1
