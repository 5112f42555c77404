"""The Jaccard join against all pairs."""

import random
import re

import pytest

from loomlog.llm import jaccard_join as J


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 or not out:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 8, 9, 12, 14, 20, 60, 150]))))
        else:
            words = (r.choice(out) or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    i = r.randrange(len(words))
                    words[i : i + 1] = r.choice([[], [r.choice(vocabulary)], [words[i].upper()], [words[i], "x"]])
            out.append(r.choice([" ", "\n "]).join(words))
    return [*out, None, "", " \t", "Same same SAME same same same"]


def brute(rows, similarity=80, size=5):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i), d))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (None, "alone with no id at all here")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, root int")
    got = J.near_duplicates(df).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(120)] = f"u{i}"
        w[r.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.near_duplicates(df).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_large_centres_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_ROWS", 3)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: 3 * i], f"u{i}", *base[3 * i + 1 :]])) for i in range(40)] + list(enumerate(corpus(7), 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.near_duplicates(df).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)
    sets = spark.createDataFrame([(c, 2, b"".join(h.to_bytes(8, "little") for h in (1, c))) for c in range(2, 22)], "c long, n int, hs binary")
    pairs = spark.createDataFrame([(2, c) for c in range(3, 22)] + [(3, 4)], "a long, b long")
    told = sorted((x.a, x.b, x.linked, round(x.d, 6)) for x in J.verify(pairs, sets, 0.8).collect())
    assert told == sorted((a, b, False, round(2 / 3, 6)) for a, b in [*((2, c) for c in range(3, 22)), (3, 4)])


def test_components_of_a_long_chain(spark):
    r = random.Random(6)
    keys = r.sample(range(1, 10**15), 1000)
    links = spark.createDataFrame(list(zip(keys, keys[1:])), "a long, b long")
    got = {x.c: x.root for x in J.components(links).collect()}
    assert got == dict.fromkeys(keys, min(keys))


def test_components_of_stars_take_few_stages(spark):
    # three rounds at most, each of which deals the labels once
    stars = [(1000 + i, [*range(10 * i, 10 * i + 5), *range(2000 + 10 * i, 2005 + 10 * i)]) for i in range(20)]
    links = spark.createDataFrame([(a, b) for a, bs in stars for b in bs], "a long, b long")
    spark.sparkContext.setJobGroup("stars", "components of stars")
    got = {x.c: x.root for x in J.components(links).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {c: min(bs) for a, bs in stars for c in [a, *bs]}
    tracker = spark.sparkContext.statusTracker()
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("stars")) <= 24


def test_chain_of_revisions(spark):
    # each text shares 9 of 11 shingles with its neighbours, and too few with any other
    rows = [(i, " ".join(f"t{j}" for j in range(i, i + 14))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.near_duplicates(df).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_light_boundary_changes_nothing(spark, monkeypatch):
    rows = list(enumerate(corpus(4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for light in (0, 9, 14):
        monkeypatch.setattr(J, "boundary", lambda *_, light=light: light)
        got = J.near_duplicates(df).collect()
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_keep_one(spark):
    texts = corpus(5)
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3), (100, None, 0), (100, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    full = {int(c) for _, n, c in brute([(d, t) for d, t, _ in rows]) if n}
    got = [x.doc_id for x in kept.collect() if (x.text or "").strip()]
    assert sorted(got) == sorted(full)
    assert sum(1 for x in kept.collect() if not (x.text or "").strip()) == sum(1 for _, t, _ in rows if not (t or "").strip())


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
