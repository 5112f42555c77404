"""The weighted hash tree: its law, shares, and what moves when weights change."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.llm import hash_tree as T
from loomlog.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(60_000).withColumnRenamed("id", "doc_id")


def places(keys, *trees):
    return [tuple(r) for r in keys.select("doc_id", *[T.descend(F.col("doc_id"), t).alias(f"t{i}") for i, t in enumerate(trees)]).collect()]


def test_growth_takes_rows_only_into_the_new_shard(keys):
    was = T.tree(16)
    for n in (16, 17, 18):
        now = T.grown(was, n)
        rows = places(keys, was, now)
        moved = [b for _, a, b in rows if a != b]
        assert set(moved) == {n} and abs(len(moved) - 60_000 / (n + 1)) < 6 * math.sqrt(60_000 / n)
        was = now


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(keys):
    plain, heavy = T.tree(8), T.tree(8, weights={3: 4.0, 6: 0.0})
    rows = places(keys, plain, heavy)
    share = Counter(b for _, _, b in rows)
    assert share[6] == 0
    for s in range(8):
        want = 60_000 * {3: 4.0, 6: 0.0}.get(s, 1.0) / 10
        assert abs(share[s] - want) <= 6 * math.sqrt(want + 1)
    # region 0 (0 to 3) grew, region 1 (4 to 7) shrank: nothing goes from the first to the second
    assert not [1 for _, a, b in rows if a < 4 <= b]
    # within region 0 rack 1 (2, 3) grew: rack 0 only loses
    assert not [1 for _, a, b in rows if a in (2, 3) and b in (0, 1)]


def test_draws_against_plain_python(spark):
    """The same descent in Python, from hashes that Spark gives for each (node, key)."""
    t = T.tree(6, weights={0: 2.5, 5: 0.5})
    keys = [*range(300), None]

    def nodes(n, path=""):
        here = f"{path}/{n.name}"
        for c in n.children:
            yield f"{here}/{c.name}", c
            yield from nodes(c, here)

    named = list(nodes(t))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    hashed = {r[0]: dict(zip([p for p, _ in named], r[1:], strict=True)) for r in df.select("k", *[F.xxhash64(F.lit(p), "k") for p, _ in named]).collect()}

    def walk(k, n, path=""):
        if not n.children:
            return n.shard
        here = f"{path}/{n.name}"
        u = lambda c: ((hashed[k][f"{here}/{c.name}"] % 2**64 >> 11) + 0.5) / 2**53
        return walk(k, min(n.children, key=lambda c: -math.log(u(c)) / c.weight), here)

    got = {r.k: r.s for r in df.select("k", T.descend(F.col("k"), t).alias("s")).collect()}
    assert got == {k: walk(k, t) for k in keys}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op11_hash_tree(spark, SF).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    slots = Counter()
    for r in out:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard] += 1
    for s, n in slots.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert len(slots) == 16


def test_defined_cases(spark):
    rows = [(None, None, 1, 2), (None, None, 1, 2), (7, "", 3, 4), (7, "x" * 200_000, 3, 4), (8, "é", 0, 0), (8, "é", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")
    got = T.assign(df).collect()
    assert len(got) == 6 and {r.doc_id: r.size for r in got if r.doc_id != 7} == {None: 1, 8: 3}
    for i in (None, 7, 8):
        same = [r for r in got if r.doc_id == i]
        assert len({r.shard for r in same}) == 1 and len({r.slot for r in same}) == 2
    assert T.assign(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.descend(F.col("doc_id"), T.tree(2, weights={0: 0.0, 1: 0.0}))
