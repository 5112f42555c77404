"""Collocations against brute force, with shards of a few words so that local supports, the union and the map all matter."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import collocations as C

SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    return f, n


def brute(rows, support, top):
    f, n = counts(rows)
    out = set()
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return out


def text_rows(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "e", "F", "g-h", "it's"]
    said = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", " ? ", "!"]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "en", "de", None, "und"]), said()) for _ in range(n)]
    fixed = "Once upon a time there was one more"
    return rows + [("en", fixed)] * 40 + [("de", fixed + ". " + fixed.upper())] * 9 + [("en", None), (None, None), ("fr", ""), ("en", "x " * 3_000)]


@pytest.mark.parametrize(("support", "shard", "bits"), [(12, 1 << 22, 27), (12, 200, 27), (12, 900, 8), (15, 40, 20)])
def test_brute_force(spark, support, shard, bits):
    rows = text_rows(support, 400)
    docs = spark.createDataFrame([(i, *x, 1, 2) for i, x in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase int").repartition(5)
    got = C.mine_collocations(docs, support, 30, shard, bits).collect()
    assert len(got) > 20 and {tuple(r) for r in got} == brute(rows, support, 30)


def test_frequent_phrases_and_counts(spark):
    """Every phrase up to five words, on real rows, over shards that see little of it each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    f, n = counts([(r.lang, r.text) for r in docs.collect()])
    found, sizes = C.frequent(docs, 20, 20_000)
    assert {r.lang: r.n for r in sizes.collect()} == n
    got = {(r.lang, r.phrase): r.f for r in found.collect()}
    assert got == {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 20}


def test_local_support_loses_nothing():
    """A phrase is reported by some shard, whatever its spread."""
    r = np.random.default_rng(4)
    hashes = r.integers(0, 30, 5_000).astype(np.uint64)
    piece = np.zeros(5_000, np.int64)
    whole, _ = C.mine(hashes, piece, "en", 10)
    parts = [hashes[i : i + 500] for i in range(0, 5_000, 500)]
    seen = set()
    for p in parts:
        seen |= set(C.mine(p, piece[: len(p)], "en", 1)[0].tolist())
    assert len(whole) > 30 and set(whole.tolist()) <= seen


def test_wide_products(spark):
    """Counts near 10**12: products pass 64 bits and must stay exact."""
    big = {"x": 2 * 10**12 + 7, "y": 3 * 10**12 + 11, "x y": 10**12 + 3, "x y x": 10**12 + 3}
    found = spark.createDataFrame([("en", p, f) for p, f in {**big, "y x": 10**12 + 9}.items()], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 9 * 10**13 + 1)], "lang string, n long")
    got = {r.phrase: r for r in C.scored(found, sizes).collect()}
    n = 9 * 10**13 + 1
    assert got["x y"].score == 1000 * big["x y"] * n // (big["x"] * big["y"])
    assert got["x y x"].score == min(1000 * big["x y x"] * n // (big["x"] * (10**12 + 9)), 1000 * big["x y x"] * n // (big["x y"] * big["x"]))
    assert {r.phrase for r in C.swallowed(found).collect()} == {"x y"}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, None)], "lang string, text string")
    assert C.mine_collocations(docs).count() == 0 and C.mine_collocations(docs.limit(0)).count() == 0
    rows = [("en", "w v " * 20_000), ("en", "u" * 400_000)]
    long = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit(1))
    assert {tuple(r) for r in C.mine_collocations(long, shard_words=1_000).collect()} == brute(rows, 100, 2_000)
