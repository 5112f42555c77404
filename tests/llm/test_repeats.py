"""The two exact substring operators against brute force."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from loomlog.llm import substring_dedup, suffix_array_dedup

SCHEMA = "doc_id long, text string, ps string"


def texts(seed):
    r = random.Random(seed)
    vocabulary = ["alpha", "be", "cé", "dog,", "e", "ff", "Gee", "日本"]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [line(r.randint(5, 30)) for _ in range(6)]
    out = []
    for _ in range(40):
        out.append(r.choice([" ", "\n", "\t "]).join(r.choice([line(r.randint(0, 25)), r.choice(shared), "run " * r.randint(0, 40)]) for _ in range(r.randint(0, 6))))
    out += [None, "", "   ", out[3], out[3], "x" * 500, "aa " * 300, "\x1f one two"]
    return out


def brute_words(rows, length):
    import re

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for i, x in enumerate(b) if not gone[i])
        spans = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 12, 64), (2, 9, 3), (3, 20, 2)])
def test_words_against_brute_force(spark, seed, length, limit):
    rows = [(i, t) for i, t in enumerate(texts(seed))] + [(None, "a null id"), (3, texts(seed)[3])]
    df = spark.createDataFrame([(*x, "extra") for x in rows], SCHEMA)
    got = substring_dedup.remove_repeats(df, length, limit).collect()
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got], key=str) == brute_words(rows, length)
    assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in got)


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 60, 64), (2, 90, 3), (3, 70, 400)])
def test_bytes_against_brute_force(spark, seed, length, limit):
    rows = [(i, t) for i, t in enumerate(texts(seed))] + [(None, "a null id"), (3, texts(seed)[3])]
    df = spark.createDataFrame([(*x, "extra") for x in rows], SCHEMA)
    got = suffix_array_dedup.remove_repeats(df, length, limit).collect()
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got], key=str) == brute_bytes(rows, length)


def test_full_length_and_shorter_passages(spark):
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    long, short, copy = line(900), line(320), line(3000)
    rows = [(i, line(r.randint(0, 2500)) + (long[r.randint(0, 300) :] if i % 3 == 0 else "") + (short if i % 4 == 1 else "") + line(r.randint(0, 900))) for i in range(30)]
    rows += [(40, copy), (41, copy), (42, copy[:1500] + "X" + copy[1500:]), (43, line(100_000)), (44, "y" * 5000), (45, line(399)), (46, short[:191])]
    for limit in (400, 3):
        got = suffix_array_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_limit=limit).collect()
        assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got], key=str) == brute_bytes(rows, 400)
        told = {x.doc_id: x.n_shared for x in got}
        assert all(told[i] > 0 for i in range(30) if i % 4 == 1 or i % 3 == 0)
        assert told[43] == told[45] == told[46] == 0 and sum(told[i] > 0 for i in range(30) if i % 4 != 1 and i % 3) == 0


@pytest.mark.parametrize("n", [70, 1500])
def test_rows_equal_in_all_cost_in_proportion(spark, n):
    text = texts(4)[1] + " ".join(f"w{i}" for i in range(400))
    rows = [(None, text)] * n + [(1, "other words"), (None, "x " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == n + 2 and sum(x.n_removed == x.n_words for x in got) == n + 1
    got = suffix_array_dedup.remove_repeats(df).collect()
    assert len(got) == n + 2 and sum(x.n_removed == x.n_bytes for x in got) == n + 1
    assert time.time() - began < 60


def test_internal_nodes():
    # leaves: aab aab aac b -> (aab), (aa), and nothing above depth 1
    nodes = substring_dedup.internal_nodes(np.array([0, 3, 2, 0]), 1)
    assert nodes.tolist() == [[0, 1, 3, 2], [0, 2, 2, 0]]
    assert substring_dedup.internal_nodes(np.array([0, 3, 2, 0]), 3).tolist() == [[0, 1, 3, 2]]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(df).count() == 0
    assert suffix_array_dedup.remove_repeats(df).count() == 0
