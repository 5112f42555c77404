"""Sharding by a hierarchical weighted hash tree.

A row goes down from region to rack to shard. At each node every child draws -ln(u) / weight, where u comes from a hash
of the row's key and the child's name, and the least draw wins; a child is then chosen in proportion to its weight. The
draws of a child depend on nothing but the key, its name and its weight. So a child that grows only gains rows, a child
that shrinks only loses some, and rows never move between two children whose weights stay.

``grown`` adds a shard as a region of its own: the weights of all that was there stay, so the new shard takes rows, and
no row moves anywhere else.

Where a row goes is known from its key alone (law ``key``): no counts, no exchange. Only the slots of a shard are
numbered over the whole table, by one small row for each file split and shard.

Defined cases: a null text has size 1 and the checksum of nothing; rows with equal keys share a shard, in slots of
their own, null keys too; a weight of 0 gets no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running

SHARDS = 16
SHARDS_A_RACK, RACKS_A_REGION = 2, 2
LAW = "key"


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard. ``name`` is unique among its siblings; only leaves have a weight of their own."""

    name: str
    children: tuple[Node, ...] = ()
    own: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int = SHARDS, rack: int = SHARDS_A_RACK, region: int = RACKS_A_REGION, weights: dict[int, float] | None = None) -> Node:
    """Shards 0, 1, ... in racks of ``rack`` shards and regions of ``region`` racks."""
    leaf = lambda s: Node(f"shard{s}", own=(weights or {}).get(s, 1.0), shard=s)
    racks = [Node(f"rack{i // rack}", tuple(leaf(s) for s in range(i, min(i + rack, shards)))) for i in range(0, shards, rack)]
    return Node("all", tuple(Node(f"region{i // region}", tuple(racks[i : i + region])) for i in range(0, len(racks), region)))


def grown(before: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    added = Node(f"added{shard}", (Node(f"rack of {shard}", (Node(f"shard{shard}", own=weight, shard=shard),)),))
    return Node(before.name, (*before.children, added))


def _draw(key: Column, path: str, child: Node) -> Column:
    # 53 bits of the hash, never 0
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{path}/{child.name}"), key), 11) + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(child.weight))


def descend(key: Column, node: Node, path: str = "") -> Column:
    """The shard that the key's draws lead to. Only the branch that was drawn is worked out for a row."""
    if not node.children:
        return F.lit(node.shard)
    here = f"{path}/{node.name}"
    alive = [c for c in node.children if c.weight > 0]
    if not alive:
        raise ValueError(f"no weight below {here}")
    if len(alive) == 1:
        return descend(key, alive[0], here)
    won = F.array_min(F.array(*[F.struct(_draw(key, here, c).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(alive)]))["i"]
    out = F.when(won == 0, descend(key, alive[0], here))
    for i, c in enumerate(alive[1:-1], 1):
        out = out.when(won == i, descend(key, c, here))
    return out.otherwise(descend(key, alive[-1], here))


def assign(docs: DataFrame, where: Node | None = None, more: Node | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot within the shard and grown_shard, the shard in the tree with one more."""
    where = where or tree()
    more = more or grown(where, SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        descend(F.col(key), where).cast("int").alias("shard"),
        descend(F.col(key), more).cast("int").alias("grown_shard"),
    )
    return running(placed, by=["shard"], rank="slot").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
