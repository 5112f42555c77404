"""The prefix trie of conversations: which first turns are shared, by whom, and what sharing them would save.

1. *Sequences.* Turns are named by two hashes and numbered within their conversation (``ranks.running``), then gathered
   into pieces of at most ``PIECE`` turns. A piece is known by the turns before it, summed up in a key, and its own; equal
   pieces are counted once, so a group of copies is one sequence, whatever its size. A node is a key: the turns up to it.
2. *Range shards.* Sequences are sorted and dealt by ranges. A task encodes its turns as small numbers (a dictionary of its
   shard) and inserts the distinct sequences into a ternary search tree, the median first, then those of both halves,
   so the tree is balanced. An iterative walk sums up members, children, leaves and savings from the bottom.
3. *Boundary nodes.* Only the nodes on the first and the last path of a shard can lie in other shards too. Of these a shard
   reports what hangs below apart from other boundary nodes; the reports are added up by key, and each boundary node is
   added to those above it.
4. Pieces further down are done first; the sums of their roots enter at the ends of the pieces above. Conversations of up
   to ``PIECE`` turns take one round.

Defined cases: rows of one turn stand by role and then by a hash of their text; null turns come first; null roles and
texts are empty; rows without a conversation id form one conversation, which is last among members, has the empty string
in the digest, and whose rebuilt form is its own; repeated rows are turns of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running
from .tables import cut

PIECE = 128
#: Turns that a shard's tree is built from, at most (one sequence more).
SHARD_TURNS = 1 << 19
STEP, HEAD = 20, 4
NOBODY = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"
_M = (1 << 64) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id (null: NOBODY), x and y (two hashes of role and text), words of the text and at, the turn's number from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("x"),
        F.xxhash64(F.lit(1), text, role).alias("y"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    return running(rows, [F.col("turn").asc_nulls_first(), "role", "x"], ["conv_id"], "at").select("conv_id", "at", "x", "y", "words")


def rebuilt(turns: DataFrame, step: int = STEP, head: int = HEAD) -> DataFrame:
    """Every conversation c with the first h turns of c - c % step for its own first h; h = crc32(c) % head. Without any turn left, no rows."""
    own = F.col("conv_id") != NOBODY
    heads = turns.where(own & (F.col("conv_id") % step == 0) & (F.col("at") < head - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "words"))).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    ids = turns.where(own & (F.col("at") == 0)).select("conv_id", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), h.alias("h"))
    none = F.array().cast("array<struct<at:bigint,x:bigint,y:bigint,words:int>>")
    given = cut(ids.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("first", none), F.lit(1), F.col("h")).alias("first")))
    kept = turns.join(given.select("conv_id", "h", F.size("first").alias("had")), "conv_id", "left").where(~(F.col("at") < F.col("h")) | F.col("h").isNull())
    kept = kept.select("conv_id", F.coalesce(F.col("at") - F.col("h") + F.col("had"), F.col("at")).alias("at"), "x", "y", "words")
    return kept.unionByName(given.select("conv_id", F.inline("first")).select("conv_id", "at", "x", "y", "words"))


def pieces(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """At most ``piece`` turns in order: conv_id, level, k1 and k2 (the key of all pieces before), e1 and e2 (with this one),
    seq (pairs of hashes), words, and last: none follow."""
    rows = turns.groupBy("conv_id", F.floor(F.col("at") / piece).alias("level")).agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "words"))).alias("t"))
    rows = rows.select("conv_id", "level", F.transform("t", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"))).alias("seq"), F.col("t.words").alias("words"))
    order = Window.partitionBy("conv_id").orderBy("level")
    for i, seed in (("1", 11), ("2", 12)):
        # 48 bits, so that sums don't overflow
        own = F.shiftright(F.xxhash64(F.lit(seed), F.col("level"), F.col("seq")), 16)
        rows = rows.withColumn(f"e{i}", F.sum(own).over(order)).withColumn(f"k{i}", F.col(f"e{i}") - own)
    return rows.withColumn("last", F.lead("level").over(order).isNull())


class Tree:
    """A ternary search tree over sequences of small numbers. Node 0 is the empty sequence; ``of`` are the conversations that pass,
    ``least`` the smallest of them, ``ends`` which sequence ends here."""

    def __init__(self):
        self.unit, self.low, self.high, self.down = [-1], [0], [0], [0]
        self.up, self.depth, self.of, self.least, self.ends = [-1], [0], [0], [NOBODY], [-1]

    def child(self, node: int, unit: int) -> int:
        """The node below with this unit, made where there is none."""
        links, of = self.down, node
        while at := links[of]:
            if unit == self.unit[at]:
                return at
            links, of = (self.low if unit < self.unit[at] else self.high), at
        links[of] = new = len(self.unit)
        for column, value in ((self.unit, unit), (self.low, 0), (self.high, 0), (self.down, 0), (self.up, node), (self.depth, self.depth[node] + 1), (self.of, 0), (self.least, NOBODY), (self.ends, -1)):
            column.append(value)
        return new

    def path(self, sequence) -> list[int]:
        out = [0]
        for unit in sequence:
            out.append(self.child(out[-1], unit))
        return out

    def insert(self, sequence, n: int, least: int, i: int) -> None:
        way = self.path(sequence)
        for at in way:
            self.of[at] += n
            self.least[at] = min(self.least[at], least)
        self.ends[way[-1]] = i

    def walk(self) -> list[int]:
        """Every node, those below before the one above, along the tree's own links and without recursion."""
        stack, out = [0], []
        while stack:
            at = stack.pop()
            out.append(at)
            stack.extend(x for x in (self.low[at], self.high[at], self.down[at]) if x)
        # a node is reached from its siblings, too, so order by depth
        return sorted(out, key=self.depth.__getitem__, reverse=True)


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle one first, then those of both halves."""
    spans = [(0, n)]
    for lo, hi in spans:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(lo, mid), (mid + 1, hi)]


def _signed(x: int) -> int:
    x &= _M
    return x - (1 << 64) if x >> 63 else x


def _below(k1: int, k2: int, x: int, y: int) -> tuple[int, int]:
    """The key of the turns so far and one more."""
    a = ((k1 ^ x) * 0x9E3779B97F4A7C15 + y) & _M
    b = ((k2 + y) * 0xC2B2AE3D27D4EB4F ^ x) & _M
    return _signed(a ^ a >> 29), _signed(b ^ b >> 31)


#: A node as a shard sees it. k is its key, u the key above, e the key of the sequence that ends here (null: none); for nodes on the
#: border, children, leaves and saved are those of what isn't on the border.
NODES = pa.schema([(c, pa.int64()) for c in "shard k1 k2 u1 u2 e1 e2 depth words n least children leaves saved uleast".split()] + [(c, pa.bool_()) for c in ("border", "uborder")])
_NODES = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in NODES)


def tree_nodes(shard: int, root: tuple[int, int], rows: list[dict]) -> Iterator[tuple]:
    """Rows of NODES for sorted, distinct sequences below one root."""
    dictionary = {pair: i for i, pair in enumerate(sorted({(t["x"], t["y"]) for r in rows for t in r["seq"]}))}
    pairs = list(dictionary)
    coded = [[dictionary[t["x"], t["y"]] for t in r["seq"]] for r in rows]
    words = {unit: w for r, c in zip(rows, coded, strict=True) for unit, w in zip(c, r["words"], strict=True)}
    tree = Tree()
    for i in median_order(len(rows)):
        tree.insert(coded[i], rows[i]["n"], rows[i]["least"], i)
    border = {*tree.path(coded[0]), *tree.path(coded[-1])}
    size = len(tree.unit)
    keys = [root] * size
    for at in range(1, size):
        # a node is made after the one above it
        keys[at] = _below(*keys[tree.up[at]], *pairs[tree.unit[at]])
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at in tree.walk():
        end = rows[tree.ends[at]] if tree.ends[at] >= 0 else None
        if end and end["children"]:
            children[at] += end["children"]
            leaves[at] += end["leaves"]
            saved[at] += end["saved"]
        up, inner = max(tree.up[at], 0), at not in border
        w = words[tree.unit[at]] if at else 0
        if inner:
            leaves[at] += not children[at]
            saved[at] += (tree.of[at] - 1) * w
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
        ends = (end["e1"], end["e2"]) if end else (None, None)
        yield (shard, *keys[at], *keys[up], *ends, tree.depth[at], w, tree.of[at], tree.least[at], children[at], leaves[at], saved[at], tree.least[up], not inner, up in border)


def shard_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """NODES of a table (k1, k2, seq, words, e1, e2, n, least, children, leaves, saved) sorted by k1, k2, seq. A tree ends with its root, with
    its task, or when it has enough turns."""

    def run(batches):
        shard, held, size, out = None, [], 0, []

        def batch_of(rows):
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODES, strict=True)], schema=NODES)

        for batch in batches:
            for r in batch.to_pylist():
                shard = r["part"] << 32 if shard is None else shard
                if held and ((r["k1"], r["k2"]) != (held[0]["k1"], held[0]["k2"]) or size >= shard_turns):
                    out += tree_nodes(shard, (held[0]["k1"], held[0]["k2"]), held)
                    held, size, shard = [], 0, shard + 1
                held.append(r)
                size += len(r["seq"])
                if len(out) > 100_000:
                    yield batch_of(out)
                    out = []
        if held:
            out += tree_nodes(shard, (held[0]["k1"], held[0]["k2"]), held)
        if out:
            yield batch_of(out)

    return sequences.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _NODES)


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in names.items()])


def merged_border(nodes: DataFrame) -> DataFrame:
    """Border nodes of all shards, each once, with sums over all that lies below them and uleast of the merged node above."""
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    own = nodes.where("border").groupBy("k1", "k2").agg(*[first(c) for c in ("u1", "u2", "e1", "e2", "depth", "words")], F.sum("n").alias("n"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    own = cut(own)
    linked = own.where("depth > 0")
    outer = linked.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("outer"))
    own = own.join(outer, ["k1", "k2"], "left").withColumn("children", F.col("children") + F.coalesce("outer", F.lit(0))).drop("outer")
    own = own.withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
    own = own.join(_renamed(linked, k1="k1", k2="k2", v1="u1", v2="u2"), ["k1", "k2"], "left")
    own = cut(own.join(_renamed(own, v1="k1", v2="k2", uleast="least"), ["v1", "v2"], "left").drop("v1", "v2"))
    # Sums over the levels 0 to s - 1 below each node; those of the nodes s levels below make it 2 s.
    deepest = own.agg(F.max("depth")).head()[0] or 0
    sums, jump, step = own.select("k1", "k2", "leaves", "saved"), _renamed(own.where("depth > 0"), k1="k1", k2="k2", v1="u1", v2="u2"), 1
    while step <= deepest:
        lifted = sums.join(jump, ["k1", "k2"]).select(F.col("v1").alias("k1"), F.col("v2").alias("k2"), "leaves", "saved")
        sums = cut(sums.unionByName(lifted).groupBy("k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        step *= 2
        if step <= deepest:
            jump = cut(jump.join(_renamed(jump, v1="k1", v2="k2", w1="v1", w2="v2"), ["v1", "v2"]).select("k1", "k2", F.col("w1").alias("v1"), F.col("w2").alias("v2")))
    return own.drop("leaves", "saved").join(sums, ["k1", "k2"])


def _digests(ends: DataFrame, most: int = 4_096) -> DataFrame:
    """(e1, e2, conv_id) -> (e1, e2, digest of the ids in order). Ids are joined by range first, so that one task
    hashes few long strings where most conversations end in one node."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches):
        key, ids, out, at = None, [], [], 0
        for batch in batches:
            for e1, e2, conv, part in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "conv_id", "part")), strict=True):
                if ids and ((e1, e2) != key or len(ids) >= most):
                    out.append((*key, at, ",".join(ids)))
                    ids, at = [], at + 1
                at = at or part << 32
                key = (e1, e2)
                ids.append("" if conv == NOBODY else str(conv))
            if len(out) > 10_000:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), names=["e1", "e2", "at", "ids"])
                out = []
        if ids:
            out.append((*key, at, ",".join(ids)))
        if out:
            yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), names=["e1", "e2", "at", "ids"])

    def hash_(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for e1, e2, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "ids")), strict=True):
                if (e1, e2) != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), names=["e1", "e2", "ends_sha256"])
        if state:
            yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], names=["e1", "e2", "ends_sha256"])

    joined = ends.select("e1", "e2", "conv_id").repartitionByRange(n, "e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id").withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(join, "e1 long, e2 long, at long, ids string")
    return joined.repartition(n, "e1", "e2").sortWithinPartitions("e1", "e2", "at").mapInArrow(hash_, "e1 long, e2 long, ends_sha256 string")


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(turns: DataFrame, everyone: DataFrame, piece: int = PIECE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """OUT for each node. turns: (conv_id, at, x, y, words); everyone: (conv_id), those without turns too."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(pieces(turns, piece))
    total, least = everyone.agg(F.count(F.lit(1)), F.min("conv_id")).head()
    ends = rows.where("last").select("e1", "e2", "conv_id")
    ends = ends.unionByName(everyone.join(rows.where("level = 0").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"), "conv_id"))
    distinct = cut(rows.groupBy("level", "k1", "k2", "e1", "e2", "seq", "words").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
    deepest = rows.agg(F.max("level")).head()[0]
    sums, done = ("children", "leaves", "saved"), []
    below, above_first = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = distinct.where(F.col("level") == level)
        here = here.join(below, ["e1", "e2"], "left") if below is not None else here.withColumns({c: F.lit(None).cast("long") for c in sums})
        here = here.repartitionByRange(n, "k1", "k2", F.slice("seq", 1, 16)).sortWithinPartitions("k1", "k2", "seq")
        nodes = cut(shard_nodes(here, shard_turns))
        border = cut(merged_border(nodes))
        # a node inside whose upper neighbour is on the border learns that one's least member by shard
        told = nodes.where("border").select("shard", "k1", "k2").join(border.select("k1", "k2", F.col("least").alias("uleast")), ["k1", "k2"])
        inside = nodes.where("not border")
        columns = ["k1", "k2", "u1", "u2", "e1", "e2", "depth", "n", "least", "uleast", *sums]
        level_nodes = inside.where("not uborder").select(*columns)
        level_nodes = level_nodes.unionByName(inside.where("uborder").drop("uleast").join(_renamed(told, shard="shard", u1="k1", u2="k2", uleast="uleast"), ["shard", "u1", "u2"]).select(*columns))
        level_nodes = level_nodes.unionByName(border.where("depth > 0").select(*columns))
        if above_first is not None:
            # the roots of the level below are ends of this one
            done.append(above_first.join(_renamed(level_nodes.where("e1 is not null"), u1="e1", u2="e2", uleast="least"), ["u1", "u2"]).select(*columns))
        level_nodes = cut(level_nodes.withColumn("first", F.col("depth") == 1).withColumn("depth", F.col("depth") + level * piece))
        done.append(level_nodes.where("not first").select(*columns))
        above_first = level_nodes.where("first").drop("uleast") if level else level_nodes.where("first").withColumn("uleast", F.lit(least))
        below = border.where("depth = 0").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), *sums)
    if deepest is not None:
        done.append(above_first.select(*columns))
    root = everyone.sparkSession.range(1 if total else 0)
    root = root.select(*[F.lit(v).cast("long").alias(c) for c, v in (("e1", 0), ("e2", 0), ("depth", 0), ("n", total), ("least", least), ("uleast", None))])
    if deepest is not None:
        root = root.join(below.drop("e1", "e2"), how="left")
    else:
        root = root.select("*", F.lit(0).alias("children"), F.lit(1).alias("leaves"), F.lit(0).alias("saved"))
    kept = ["e1", "e2", "depth", "n", "least", "uleast", *sums]
    out = root.select(*kept)
    for x in done:
        out = out.unionByName(x.select(*kept))
    ended = out.where("e1 is not null").join(_digests(ends), ["e1", "e2"], "left").select(*kept, "ends_sha256")
    out = ended.unionByName(out.where("e1 is null").withColumn("ends_sha256", F.lit(None).cast("string")))
    name = lambda c: F.when(F.col(c) != NOBODY, F.col(c))
    values = (name("least"), F.col("depth"), name("uleast"), F.col("n"), F.col("children"), F.col("leaves"), F.col("saved"))
    return out.select(*[v.cast("long").alias(c) for v, c in zip(values, OUT, strict=False)], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def nodes(conversations: DataFrame, step: int = STEP, head: int = HEAD, piece: int = PIECE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = cut(turns_of(conversations))
    return trie(rebuilt(turns, step, head), turns.where("at = 0").select("conv_id"), piece, shard_turns)
