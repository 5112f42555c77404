"""The prefix trie against a plain trie, with pieces and shards small enough that every merge happens."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomlog.llm import prefix_trie as T
from loomlog.llm import queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    below = defaultdict(set)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(below[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def talks(seed, n=220, longest=9, texts=3):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(3 * n), n):
        for t in range(r.randint(1, longest)):
            out.append((c, r.choice([t, t, t, t]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", None, "d e  f"][: texts + 1]) if r.random() < 0.97 else f"once {c}"))
    return out


@pytest.mark.parametrize(("seed", "piece", "shard_turns"), [(1, 128, 1 << 19), (2, 128, 30), (3, 2, 25), (4, 3, 1 << 19)])
def test_brute_force(spark, seed, piece, shard_turns):
    rows = talks(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert found(T.nodes(df, piece=piece, shard_turns=shard_turns)) == brute(rows)


def test_long_shared_chains_and_copies(spark):
    """A group of copies, a hot first turn, and conversations that share 300 turns."""
    rows = [(c, t, "user", f"w{t} x") for c in range(1_000, 1_060) for t in range(5)]
    rows += [(c, t, "user", "hot start" if not t else f"{c} {t}") for c in range(2_000, 2_100) for t in range(3)]
    rows += [(c, t, "user", f"line {t}" if t < 300 else f"own {c}") for c in (3_021, 3_022, 3_041) for t in range(305 if c == 3_021 else 299 + c % 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(T.nodes(df, shard_turns=60)) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_prefix_trie(spark, SF)) == brute(rows)


def test_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string, depth int, at int, n int"
    rows = [(None, None, None, None, 1, 1, 1), (None, 0, "user", "x", 1, 1, 1), (5, 1, "a", "w " * 60_000, 0, 0, 0), (5, None, None, "", 0, 0, 0), (5, 1, "a", "w " * 60_000, 0, 0, 0)]
    got = T.nodes(spark.createDataFrame(rows, schema)).collect()
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 2 and root.conv_id == 5 and root.parent_conv_id is None
    # the conversation without id keeps its own turns; of conversation 5 the first h are gone, as there is no conversation 0
    assert sorted(r.depth for r in got if r.conv_id is None) == [1, 2]
    assert sorted(r.depth for r in got if r.conv_id == 5) == list(range(4 - min(3, zlib.crc32(b"5") % 4)))
    assert T.nodes(spark.createDataFrame([], schema)).count() == 0
    # turnless: crc32 decides how many turns go, and the first of the twenty has none of its own
    gone = [c for c in range(1, 2_000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 1][:3]
    lone = [(c, 0, "u", "t") for c in gone]
    assert found(T.nodes(spark.createDataFrame(lone, "conv_id long, turn long, role string, text string"))) == brute(lone)


def test_median_order_balances():
    order = list(T.median_order(1_000))
    assert sorted(order) == list(range(1_000))
    tree = T.Tree()
    for i in order:
        tree.insert([i], 1, i, i)

    def height(at):
        return 1 + max(height(tree.low[at]), height(tree.high[at])) if at else 0

    assert height(tree.down[0]) <= 11
