"""N-gram Jaccard join: a size-aware heavy-light set join.

A document's set holds the hashes of its distinct 5-word shingles. Two sets link when
their intersection has at least ``similarity`` of their union. Equal sets are one class;
everything below works on classes.

1. *Rare shingles out.* Linked sets share most of any fixed sample of their union, so of
   the 40 % least hashes of a set at least an eighth part of the set's size must occur in
   another set. These hashes are packed by hash range and counted; classes under the
   bound link with nothing. The rest send all their hashes the same way and keep those
   that occur in another class; a class keeping less than the share needed is out.
2. *Light sets* (few shingles) list all subsets of the fixed sizes that a link needs;
   linked sets have such a subset in common. *Heavy sets* are listed under the rarest
   hashes of their prefix; linked sets meet in one of these inverted lists. The boundary
   is the size with the least total cost, counted from the sets themselves.
3. *Lists to links.* In each list, all members are first compared with a centre, and those
   outside the largest component with a few members of it, as long as this joins many, which
   joins groups of near copies in linear time; then members of different components are
   compared, but for those that their distances to the centre tell apart. Comparison is exact,
   on the kept hashes.

Nothing is capped: each list is read as a whole, and pairs are only skipped when both
ends are already known to be connected.

Defined cases: a null text, an empty one or one of blanks has an empty set and its own
id as component; fewer words than five make one shingle; repeated rows are one class; a
null id takes part but never names a component unless it's alone; other columns are
ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names; an empty
table gives no rows; very long texts are read whole. Words are what stands between blanks, A-Z lowered.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from .tables import cut, unused

SHINGLE = 5
SIMILARITY = 0.8
SAMPLE = 0.4
LIGHT_MOST = 14
ROUNDS = 4
BROADCAST_KEYS = 1_000_000
BROADCAST_PAIRS = 200_000
#: So many members of a list's largest component are compared with those outside in one round.
PICKS = 4
#: There is another round if one in so many comparisons found a link; else the last step would hardly get shorter.
WORTH = 32
SEND = 500_000
#: So many sets at most are compared with one other in one part.
PART_ROWS = 1_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the bounds of the texts."""
    n = len(offs) - 1
    starts, ends, bounds = K.words(buf, offs)
    roll = K.Rolling(K.word_hashes(buf, starts, ends, lower=True))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    first = np.arange(len(starts))
    last = bounds[1:][doc] if n else first
    whole = first + size <= last
    short = (first == bounds[:-1][doc]) & ~whole if n else whole
    use = np.flatnonzero(whole | short)
    h = roll.slices(use, np.minimum(use + size, last[use]))
    d = doc[use]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))


def class_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set, 0 for the empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h + np.uint64(0x1234567)))])
    size = np.diff(bounds)
    key = K.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    return np.where(size > 0, (key >> np.uint64(1)).astype(np.int64) | 1, 0)


def sets_of(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, k (a hash of the row), c (class key) and n (set size) of each row."""
    rows = documents.select("doc_id", "text").withColumn("k", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))

    def run(batches):
        for batch in batches:
            for at, buf, offs in K.chunks(batch.column("text")):
                h, bounds = shingle_sets(buf, offs, size)
                m = len(offs) - 1
                yield pa.record_batch([batch.column("doc_id").slice(at, m), batch.column("k").slice(at, m), pa.array(class_keys(h, bounds)), pa.array(np.diff(bounds))], names=["doc_id", "k", "c", "n"])

    return rows.mapInArrow(run, "doc_id long, k long, c long, n long")


def _send(documents: DataFrame, part: float, ranges: int, size: int) -> DataFrame:
    """Each text's least hashes (the given part of them) with its class, packed by hash.

    A hash that several classes of a buffer share is sent with two of them; the others are
    told at once (with hash 0 and dealt by class).
    """

    def send(held):
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        h, c = _distinct(h, c)
        _, first = packed.groups(h)
        counts = np.diff(first)
        place = np.arange(len(h)) - np.repeat(first[:-1], counts)
        told = c[place >= 2]
        h, c = h[place < 2], c[place < 2]
        yield packed.pack(np.concatenate([h, K.mix(told.view(np.uint64))]), ranges, np.concatenate([h, np.zeros(len(told), np.uint64)]), np.concatenate([c, told]))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, buf, offs in K.chunks(batch.column("text")):
                h, bounds = shingle_sets(buf, offs, size)
                keys, sizes = class_keys(h, bounds), np.diff(bounds)
                rank = np.arange(len(h)) - np.repeat(bounds[:-1], sizes)
                use = rank < np.repeat(np.minimum(sizes, np.ceil(part * sizes).astype(np.int64) + 1), sizes)
                held.append((h[use], np.repeat(keys, sizes)[use]))
                n += int(use.sum())
                if n >= SEND:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return documents.select("text").mapInArrow(run, packed.schema(2))


def _distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (h, c), sorted, each once."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h[new], c[new]


def _frequency(h: np.ndarray) -> np.ndarray:
    """How often each of the sorted values occurs."""
    _, first = packed.groups(h)
    counts = np.diff(first)
    return np.repeat(counts, counts)


def _join(rows) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def shared_counts(sent: DataFrame) -> DataFrame:
    """(c, shared): how many of a class's hashes another class has too; never too few."""
    n = packed.partitions_of(sent)

    def judge(rows):
        h, c = _join(rows)
        told = c[h == 0]
        h, c = _distinct(h[h != 0], c[h != 0])
        return np.unique(np.concatenate([told, c[_frequency(h) > 1]]), return_counts=True)

    def finish(kept):
        c, counts = _join(kept)
        if len(c):
            yield packed.pack(K.mix(c.view(np.uint64)), n, c, counts.astype(np.int64))

    def add(rows):
        c, counts = _join(rows)
        order, bounds = packed.groups(c)
        yield pa.record_batch([pa.array(c[order][bounds[:-1]]), pa.array(np.add.reduceat(counts[order], bounds[:-1]))], names=["c", "shared"])

    told = packed.by_range(sent, [np.uint64, np.int64], judge, packed.schema(2), n, finish)
    return packed.by_range(told, [np.int64, np.int64], add, "c long, shared long", n)


def _check(similarity: float) -> None:
    if not 0.5 < similarity <= 1:
        raise ValueError(f"similarity must be above 0.5 and at most 1, not {similarity}")


def least_overlap(n: int, similarity: float) -> int:
    """The least intersection of a link of a set of n."""
    return ceil(round(similarity * n, 9))


def reduced_sets(documents: DataFrame, sizes: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(c, n, hs, fs): the classes that may have links, with their hashes that other such classes have, and how many have each.

    sizes: (c, n, k) of every class, once. hs is packed uint64, fs int32.
    """
    ranges = packed.ranges_of(documents)
    # of the least SAMPLE * n + 1 hashes, this share of n at least is common to both sides of a link
    least = max(0.0, min(similarity * SAMPLE - (1 - similarity), SAMPLE - (1 - similarity) / similarity))
    counts = shared_counts(_send(documents, SAMPLE, ranges, size))
    some = cut(sizes.join(counts, "c").where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * least, 6)))).select("c", "n"))
    keys = some.select("c")
    members = documents.select("doc_id", "text")
    # the chosen classes' first documents, found by key
    heads = cut(sizes.join(keys, "c", "left_semi").select("c", "n", "k"))
    rows = members.withColumn("k", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    few = F.broadcast if heads.count() <= BROADCAST_KEYS else lambda df: df
    own = rows.join(few(heads.select("k")), "k", "left_semi")

    n = packed.partitions_of(documents)

    def judge(rows):
        h, c = _distinct(*_join(rows))
        f = _frequency(h)
        return h[f > 1], c[f > 1], f[f > 1].astype(np.int32)

    def finish(kept):
        h, c, f = _join(kept)
        if len(h):
            yield packed.pack(K.mix(c.view(np.uint64)), n, h, c, f)

    def sets(rows):
        h, c, f = _join(rows)
        order = np.lexsort((h, c))
        h, c, f = h[order], c[order], f[order]
        _, bounds = packed.groups(c)
        yield pa.record_batch([pa.array(c[bounds[:-1]]), K.packed(h, bounds), K.packed(f, bounds)], names=["c", "hs", "fs"])

    told = packed.by_range(_send_all(own, ranges, size), [np.uint64, np.int64], judge, packed.schema(3), n, finish)
    lists = packed.by_range(told, [np.uint64, np.int64, np.int32], sets, "c long, hs binary, fs binary", n)
    enough = F.length("hs") >= 8 * F.ceil(F.round(F.col("n") * similarity, 6))
    return lists.join(few(heads.select("c", "n")), "c").where(enough).select("c", "n", "hs", "fs")


def _send_all(documents: DataFrame, ranges: int, size: int) -> DataFrame:
    """All hashes of each text with its class, packed by hash."""

    def run(batches):
        for batch in batches:
            for _, buf, offs in K.chunks(batch.column("text")):
                h, bounds = shingle_sets(buf, offs, size)
                if len(h):
                    yield packed.pack(h, ranges, h, np.repeat(class_keys(h, bounds), np.diff(bounds)))

    return documents.select("text").mapInArrow(run, packed.schema(2))


def subset_count(n: int, kept: int, similarity: float) -> int:
    return sum(comb(kept, c) for c in subset_sizes(n, similarity))


def subset_sizes(n: int, similarity: float) -> list[int]:
    """The subset sizes that links of a set of n can need: the least overlap of the larger side, for each size it may have."""
    return sorted({least_overlap(m, similarity) for m in range(n, floor(round(n / similarity, 9)) + 1)} & set(range(1, n + 1)))


def boundary(reduced: DataFrame, similarity: float) -> int:
    """The largest light size: least cost of subsets listed for light sets plus list entries read for heavy ones."""
    small = reduced.where(F.col("n") <= LIGHT_MOST)

    def cost(batches):
        for batch in batches:
            out = []
            for n, fs in zip(batch.column("n").to_pylist(), batch.column("fs").to_pylist(), strict=True):
                v = np.sort(np.frombuffer(fs, np.int32).astype(np.int64))
                p = max(0, n - least_overlap(n, similarity) + 1 - (n - len(v)))
                out.append((n, subset_count(n, len(v), similarity), int(v[:p].sum())))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([],) * 3)], names=["n", "light", "heavy"])

    rows = small.select("n", "fs").mapInArrow(cost, "n long, light long, heavy long").groupBy("n").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).collect()  # LIGHT_MOST rows at most
    best, least = 0, sum(r.heavy for r in rows)
    for b in range(1, LIGHT_MOST + 1):
        # sets near the boundary are listed on both sides
        total = sum(r.light for r in rows if r.n <= b) + sum(r.heavy for r in rows if r.n >= similarity * b)
        if total < least:
            best, least = b, total
    return best


def list_entries(reduced: DataFrame, light: int, similarity: float) -> DataFrame:
    """(key, c, n, q, w, i, p): each class under its subsets if light, and under its rarest hashes if it may meet a heavy one. q is
    how many hashes it shares with any other, w how common its hashes are on average. i marks the entries under which a
    set meets all its links of the same size or larger: these share more, so fewer of the rarest hashes do. p is the
    key's place among the set's shared hashes, rarest first."""

    def run(batches):
        for batch in batches:
            keys, owner, size, shared, weight, place, inner = [], [], [], [], [], [], []
            for c, n, hs, fs in zip(*(batch.column(x).to_pylist() for x in ("c", "n", "hs", "fs")), strict=True):
                h, f = np.frombuffer(hs, np.uint64), np.frombuffer(fs, np.int32)
                own = []
                if n <= light:
                    for s in subset_sizes(n, similarity):
                        if s <= len(h):
                            picks = np.array(list(combinations(range(len(h)), s)))
                            own.append((K.mix(K.mix(h)[picks].sum(axis=1) + np.uint64(s)), len(picks), 0))
                if floor(round(n / similarity, 9)) > light:
                    # the hashes that no other class has come first in a prefix by rarity
                    p = len(h) - least_overlap(n, similarity) + 1
                    larger = len(h) - least_overlap(n, 2 * similarity / (1 + similarity)) + 1
                    own.append((h[np.lexsort((h, f))[: max(0, p)]], larger, 1))
                for x, i, step in own:
                    inner.append(np.arange(len(x)) < i)
                    place.append(np.arange(len(x)) * step)
                    keys.append(x.view(np.int64))
                    owner.append(np.full(len(x), c, np.int64))
                    size.append(np.full(len(x), n, np.int64))
                    shared.append(np.full(len(x), len(h), np.int64))
                    weight.append(np.full(len(x), (int(f.sum()) << 10) // n, np.int64))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.record_batch([*(pa.array(cat(x)) for x in (keys, owner, size, shared, weight, place)), pa.array(cat(inner).astype(bool))], names=["key", "c", "n", "q", "w", "p", "i"])

    return reduced.mapInArrow(run, "key long, c long, n long, q long, w long, p long, i boolean")


def verify(pairs: DataFrame, reduced: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked, d) of pairs (a, b) of classes, d being their distance. The sets of all b travel to their a, which is read
    once; an a with more than PART_ROWS of them goes to several parts, each with a copy of its set. Pairs are read more than once,
    so they should be written; while they are counted to be few, they are broadcast to the sets."""
    sets = reduced.select("c", "n", "hs")
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda df: df
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    dealt = pairs.join(few(parts.where("parts > 1")), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part"))
    sides = sets.join(few(dealt), F.col("b") == F.col("c")).select("a", "part", "b", "n", "hs")
    own = sets.join(few(parts), F.col("a") == F.col("c")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "n", "hs")
    heads = own.select("a", "part", F.lit(None).cast("long").alias("b"), "n", "hs")
    n = packed.partitions_of(reduced)
    dealt = sides.unionByName(heads).repartition(n, "a", "part").sortWithinPartitions("a", "part", "b").drop("part")
    hundred = round(similarity * 100)

    def run(batches):
        at, own, size = None, None, 0
        for batch in batches:
            out = []
            for a, b, m, hs in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "n", "hs")), strict=True):
                h = np.frombuffer(hs, np.uint64)
                if b is None:
                    at, own, size = a, h, m
                elif at == a:
                    i = np.searchsorted(own, h)
                    both = int((own[np.minimum(i, len(own) - 1)] == h).sum()) if len(own) else 0
                    whole = size + m - both
                    out.append((a, b, 100 * both >= hundred * whole, 1.0 - both / whole))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([],) * 4, types, strict=True)], names=["a", "b", "linked", "d"])

    return dealt.mapInArrow(run, "a long, b long, linked boolean, d double")


def components(links: DataFrame) -> DataFrame:
    """(c, root): the least class reachable, for classes with links. While a link has different labels at its ends, both ends and both
    labels take the lesser one, then the label's own label. Labels only fall, to classes of the same component, so the loop ends, with
    the least. The rounds grow with the logarithm of a chain's length; each deals the labels once. While the links are counted
    to be few, labels are broadcast to them."""
    edges = cut(links.where("a <> b").select("a", "b"))
    # a link has two classes
    side = F.broadcast if 2 * edges.count() <= BROADCAST_KEYS else lambda df: df
    label = cut(edges.select(F.explode(F.array("a", "b")).alias("c"), F.least("a", "b").alias("root")).groupBy("c").agg(F.min("root").alias("root")))
    while True:
        ends = edges.join(side(label.alias("x")), F.col("a") == F.col("x.c")).join(side(label.alias("y")), F.col("b") == F.col("y.c"))
        apart = cut(ends.where("x.root <> y.root").select("a", "b", F.col("x.root").alias("x"), F.col("y.root").alias("y")))
        if apart.isEmpty():
            return label
        told = apart.select(F.explode(F.array("a", "b", "x", "y")).alias("c"), F.least("x", "y").alias("root"))
        step = label.unionByName(told).groupBy("c").agg(F.min("root").alias("root"))
        jump = label.select(F.col("c").alias("root"), F.col("root").alias("far"))
        label = cut(step.join(side(jump), "root", "left").select("c", F.least("root", F.coalesce("far", "root")).alias("root")))


def _may_link(n, q, m, r, similarity: float, at=None, place=None):
    """Whether sets of n and m, with q and r hashes shared with any other set, can link: what they share is in both counts.
    If a common hash has the given places among these, at most the lesser number before it and from it on is common."""
    hundred = round(similarity * 100)
    most = F.least(q, r) if at is None else F.least(at, place) + F.least(q - at, r - place)
    return most * (100 + hundred) >= (n + m) * hundred


def joined(reduced: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """(c, root): the least class reachable by links between classes, for classes with links.

    First all members of a list are compared with its centre, the one with the most common
    hashes; then, a few times while many links are found, members outside a list's largest
    component with some members of it, chosen by hash. Last, all members of different
    components are compared. Pairs are left out that can't link: by their sizes and numbers of
    shared hashes, and in the last step by the places of the common hash and by the triangle
    inequality on their distances to the centre.
    """
    entries = cut(list_entries(reduced, boundary(reduced, similarity), similarity))
    who = F.struct("c", "n", "q")
    centre = entries.groupBy("key").agg(F.max_by(who, F.struct("w", "c")).alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "a")
    entries = cut(entries.join(centre, "key").select("key", "c", "n", "q", "p", "i", "a"))
    may = _may_link(F.col("n"), F.col("q"), F.col("a.n"), F.col("a.q"), similarity)
    pairs = cut(entries.where(F.col("c") != F.col("a.c")).where(may).select(F.col("a.c").alias("a"), F.col("c").alias("b")).distinct())
    told = cut(verify(pairs, reduced, similarity))
    known = told.where("linked").select("a", "b")
    roots, late = components(known), False
    for i in range(rounds):
        seen = entries.join(roots, "c", "left").select("key", "c", "n", "q", F.coalesce("root", "c").alias("root"))
        picks = F.array(*(F.min_by(who, F.xxhash64("c", F.lit(PICKS * i + j))) for j in range(PICKS)))
        parts = seen.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), picks.alias("picks"))
        main = parts.groupBy("key").agg(F.max_by(F.struct("root", "picks"), F.struct("m", "root")).alias("x"), F.count(F.lit(1)).alias("p")).where("p > 1").select("key", F.col("x.root").alias("main"), F.col("x.picks").alias("picks"))
        outside = seen.join(main, "key").where("root <> main").select("c", "n", "q", F.explode("picks").alias("a"))
        pairs = cut(outside.where(may).select(F.col("a.c").alias("a"), F.col("c").alias("b")).distinct())
        new = cut(verify(pairs, reduced, similarity).where("linked").select("a", "b"))
        found = new.count()
        if not found:
            break
        known = known.unionByName(new)
        if found * WORTH < pairs.count():
            late = True  # these links aren't in roots, so the last step compares some pairs in vain
            break
        roots = components(known)
    # what is left: members of one list in different components
    far = entries.select("key", "c", "n", "q", "p", "i", F.col("a.c").alias("a")).join(told.select("a", F.col("b").alias("c"), "d"), ["a", "c"], "left").select("key", "c", "n", "q", "p", "i", F.when(F.col("c") == F.col("a"), 0.0).otherwise(F.col("d")).alias("d"))
    seen = far.join(roots, "c", "left").select("key", "c", "n", "q", "p", "i", "d", F.coalesce("root", "c").alias("root"))
    mixed = seen.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    seen = cut(seen.join(mixed, "key", "left_semi"))
    x, y = seen.alias("x"), seen.where("i").alias("y")  # y: the smaller set
    near = _may_link(F.col("x.n"), F.col("x.q"), F.col("y.n"), F.col("y.q"), similarity, F.col("x.p"), F.col("y.p")) & F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= 1 - similarity + 1e-9, F.lit(True))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y.n") <= F.col("x.n")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.root") != F.col("y.root")) & near)
    pairs = cut(pairs.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())
    new = cut(verify(pairs, reduced, similarity).where("linked").select("a", "b"))
    return components(known.unionByName(new)) if late or not new.isEmpty() else roots


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), root (the component's key) and k (the row's hash)."""
    _check(similarity)
    told = cut(sets_of(documents, size))
    classes = cut(told.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min("k").alias("k")))
    reduced = cut(reduced_sets(documents, classes.select("c", "n", "k"), similarity, size))
    roots = joined(reduced, similarity)
    named = classes.join(roots, "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("c", "root", "component_id")
    out = told.join(named, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", "k")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One document of each component, all columns kept: the least doc_id (nulls last), then the least hash. Empty sets all stay."""
    told = cut(near_duplicates(documents, similarity, size))
    key, one, place = (unused(documents, c) for c in ("key", "one", "place"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    kept = told.where("n_shingles > 0").groupBy("root").agg(F.min(rank).alias("m")).select(F.col("m.k").alias(key), F.lit(True).alias(one))
    kept = kept.unionByName(told.where("n_shingles = 0").select(F.col("k").alias(key), F.lit(False).alias(one)).distinct())
    rows = documents.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))).join(kept, key)
    # rows equal in id and text share a hash
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return rows.where((F.col(place) == 1) | ~F.col(one)).select(*documents.columns)
