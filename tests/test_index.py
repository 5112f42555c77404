"""The text index and the rollups."""

import random

from pyspark.sql import functions as F

from loomlog.operators import rollups, text_index


def test_index_changes_no_result(spark, tmp_path):
    r = random.Random(8)
    words = ["alpha", "Beta", "gämma", "delta-x", "eps", "zeta"]
    rows = [("g", f"s{i}", " ".join(r.choice(words) for _ in range(r.randint(0, 12))) + (" rare needle Here" if i in (7, 70) else ""), r.choice([None, "", "BODY alpha"])) for i in range(200)] + [("g", "none", None, None)]
    e = spark.createDataFrame(rows, "agent string, session_id string, text string, body string")
    spark.sql("drop table if exists grams_of_texts")
    text_index.save(text_index.index(e.where("session_id < 's5'")), "grams_of_texts", 4)
    text_index.save(text_index.index(e.where("session_id >= 's5' and session_id <> 's70'")), "grams_of_texts", 4)
    grams = spark.table("grams_of_texts")
    known = e.where("session_id <> 's70'")
    for needle in ("rare needle h", "GÄMMA", "beta alpha", "y a", "al", "nowhere at all", "body ALPHA"):
        holds = F.contains(F.lower("text"), F.lit(needle.lower())) | F.coalesce(F.contains(F.lower("body"), F.lit(needle.lower())), F.lit(False))
        want = sorted(x.session_id for x in e.where(holds).collect())
        near = text_index.narrowed(e, grams, needle, known)
        assert sorted(x.session_id for x in near.where(holds).collect()) == want
        if needle == "rare needle h":
            assert want == ["s7", "s70"] and near.count() < 20
    assert text_index.candidates(grams, "ab") is None
    spark.sql("drop table grams_of_texts")


def test_index_moves_lists(spark):
    """Each trigram of a session once, of all its rows and columns; what is shuffled are lists, not a row for each trigram."""
    r = random.Random(3)
    rows = [("g" if i % 9 else None, f"s{i % 7}", "".join(r.choice("abCÄ\U0001f600 \n") for _ in range(r.randint(0, 60))), r.choice([None, "", "ab", "Body"])) for i in range(90)]
    e = spark.createDataFrame(rows, "agent string, session_id string, text string, body string")
    made = text_index.index(e.repartition(5))
    want = {(x[i : i + 3], a, s) for a, s, *texts in rows for t in texts if t for x in [t.lower()] for i in range(len(x) - 2)}
    got = [tuple(x) for x in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rollups_merge(spark):
    rows = [(f"2025-01-{1 + i % 9:02d} 10:00:00" if i % 50 else None, ["a", "b", "", None][i % 4], f"u{i % 3_000}", " " if i % 7 else f"f{i}", i) for i in range(20_000)]
    e = spark.createDataFrame(rows, "ts string, label string, user string, file string, v long").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.col("v") < 8_000
    rolled = rollups.rollup(e.where(half), ["label"], ["user", "file"], ["v"]).unionByName(rollups.rollup(e.where(~half), ["label"], ["user", "file"], ["v"]))
    exact = rollups.exact_rollup(e.where(half), ["label"], ["user", "file"]).unionByName(rollups.exact_rollup(e.where(~half), ["label"], ["user", "file"]))
    for by in ([], ["label"], ["day"], ["day", "label"]):
        groups = {}
        for ts, label, user, file, v in rows:
            g = groups.setdefault(tuple({"day": ts and ts[:10], "label": label or "(unknown)"}[k] for k in by), [0, set(), set(), 0])
            g[0] += 1
            g[1].add(user)
            g[2] |= {file} if file.strip() else set()
            g[3] += v
        key = lambda x: tuple(None if x[k] is None else str(x[k]) for k in by)  # noqa: E731, B023
        for x in rollups.merged(rolled, by).collect():
            n, users, files, total = groups[key(x)]
            assert (x["rows"], x.sum_v) == (n, total)
            assert all(abs(a - len(b)) <= 5 * rollups.error() * len(b) + 1 for a, b in ((x.user, users), (x.file, files)))
        got = {}
        for x in rollups.merged_exact(exact, by).collect():
            got.setdefault(key(x), {})[x.metric] = x.n
        assert got == {k: {"rows": g[0], "user": len(g[1]), "file": len(g[2])} for k, g in groups.items()}
    assert rollups.merged(rolled.limit(0), ["label"]).count() == 0
