"""Phrases whose words occur together more often than apart, by partitioned mining (SON).

1. *Shards.* The words of each language are counted. Files are then read as shards of a bounded number of words, and each
   shard is mined completely: a shard with w of a language's W words reports every phrase that occurs in it at least
   ceil(support * w / W) times, with its local count. Longer phrases are only looked for where both shorter parts were
   frequent in the shard. A phrase below the local support in every shard is below the support in all of them together,
   so no frequent phrase is missed.
2. *Union.* Reports meet by hash. A phrase can reach the support only if its reported counts, and one less than the local
   support for each shard that didn't report it, add up to the support. With so many shards that local supports are 1
   this leaves exactly the frequent ones. The survivors mark bits of one map of fixed size.
3. *Exact counts.* Every shard counts its phrases that the map knows, by text, and sends them packed by range of texts,
   where they are added up. False hits of the map cost an entry and change nothing.

Every part of a frequent phrase is frequent, so the counts of the parts of all cuts, and the longer phrases that swallow
a candidate, are found by joins among the frequent phrases. Products are decimals of 38 digits, so nothing overflows.

Defined cases: a null text is empty, a null language is ``und`` together with the real one; phrases don't cross pieces
or documents; ranks are made by score, count and phrase (bytes), so they have no ties; repeated rows count each time;
ids and other columns are ignored; an empty table gives no rows. In one task phrases of the same hash (64 bits) would be
taken for one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from .tables import cut

SUPPORT = 100
LONGEST = 5
TOP = 2_000
SCALE = 1_000
#: Words that a shard holds at most (one document may hold more).
SHARD_WORDS = 1 << 22
#: Bits of the map of phrases that may be frequent: 16 MiB.
MAP_BITS = 27
CHUNK = 2 << 20
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SALTS = 64
#: A word of any piece, as a pattern over whole texts.
WORD = r"[^\x09-\x0D\x20.,;:!?]+"

_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_OUTSIDE = _STOP.copy()
_OUTSIDE[list(BLANKS)] = True


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> np.uint64:
    raw = lang.encode()
    return K.mix(np.array([zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 1)], np.uint64))[0]


class Words:
    """The words of some texts: lower-cased bytes, bounds, hashes, and a number that is equal within a piece."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.text = K.LOWER[buf]
        self.starts, self.ends, first = K.words(buf, offs, _OUTSIDE)
        self.hashes = K.word_hashes(self.text, self.starts, self.ends)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        self.piece = (np.cumsum(_STOP[buf])[self.starts] + row if len(buf) else row).astype(np.int32)

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.text[self.starts[j] : self.ends[j]].tobytes() for j in range(i, i + n))


class Grams:
    """Phrases of 1, 2, ... words: ``at``, where they begin, and ``hashes``. Each step keeps those of which both shorter parts were kept."""

    def __init__(self, hashes: np.ndarray, piece: np.ndarray, lang: str):
        self.words, self.piece, self.n = hashes, piece, 1
        self.at = np.arange(len(hashes), dtype=np.int32)
        self.hashes = K.mix(hashes ^ _seed(lang))

    def longer(self, kept: np.ndarray) -> None:
        """On to one word more, from the phrases that are kept (a mask over ``at``)."""
        alive = np.zeros(len(self.words) + 1, bool)
        alive[self.at[kept]] = True
        kept = kept & alive[self.at + 1] & (self.at + self.n < len(self.words))
        self.at, h = self.at[kept], self.hashes[kept]
        same = self.piece[self.at] == self.piece[self.at + self.n]
        self.at, h = self.at[same], h[same]
        self.hashes = K.mix(h * _STEP + self.words[self.at + self.n])
        self.n += 1


def mine(hashes: np.ndarray, piece: np.ndarray, lang: str, least: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all phrases that occur at least so often here."""
    g, out_h, out_c = Grams(hashes, piece, lang), [], []
    while True:
        order, bounds = packed.groups(g.hashes)
        counts = np.diff(bounds)
        often = counts >= least
        out_h.append(g.hashes[order[bounds[:-1][often]]])
        out_c.append(counts[often])
        if g.n == longest:
            return np.concatenate(out_h), np.concatenate(out_c)
        kept = np.zeros(len(order), bool)
        kept[order[np.repeat(often, counts)]] = True
        del order
        g.longer(kept)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(language, its number of words in the whole table, texts) of a batch."""
    langs = batch.column("lang").to_pylist()
    sizes = batch.column("n").to_pylist()
    for lang in sorted(set(langs)):
        rows = [i for i, x in enumerate(langs) if x == lang]
        yield lang, sizes[rows[0]], batch.column("text").take(pa.array(rows))


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def shards(docs: DataFrame, support: int, ranges: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(r, lang, slack, a0, a1): phrases that are frequent in a shard, by hash range, each with its count less the slack, the most
    that the phrase could have had unreported. r = -1 tells of a shard's slack alone."""

    def run(batches):
        held: dict[str, list] = {}
        total: dict[str, int] = {}
        words = 0

        def flush():
            for lang in list(held):
                # a shard is let go language by language
                parts = held.pop(lang)
                if not parts:
                    continue
                h, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                del parts
                slack = max(1, _ceil(support * len(h), max(1, total[lang]))) - 1
                found, counts = mine(h, p, lang, slack + 1)
                dealt = packed.pack(found.view(np.int64), ranges, found, (counts - slack).astype(np.uint32))
                rows = dealt.num_rows
                yield pa.record_batch([pa.array([*dealt.column(0).to_pylist(), -1], pa.int32()), pa.array([lang] * (rows + 1)), pa.array([slack] * (rows + 1), pa.int64()), *(pa.concat_arrays([dealt.column(i), pa.array([b""], pa.binary())]) for i in (1, 2))], names=["r", "lang", "slack", "a0", "a1"])

        for batch in batches:
            for lang, n, texts in _by_lang(batch):
                total[lang] = n
                for _, buf, offs in K.chunks(texts, CHUNK):
                    w = Words(buf, offs)
                    parts = held.setdefault(lang, [])
                    if len(w.hashes):
                        parts.append((w.hashes, w.piece + np.int32(parts[-1][1][-1] + 1 if parts else 0)))
                    words += len(w.hashes)
                    if words >= shard_words:
                        yield from flush()
                        held, words = {}, 0
        yield from flush()

    return docs.mapInArrow(run, "r int, lang string, slack long, a0 binary, a1 binary")


def survivors(reported: DataFrame, support: int, partitions: int, bits: int = MAP_BITS) -> np.ndarray:
    """The map (packed bits, by the first bits of a hash) of phrases that may reach the support. Its size is fixed."""
    unreported = cut(reported.where("r < 0").groupBy("lang").agg((F.lit(support) - F.sum("slack")).alias("need")))
    rows = reported.where("r >= 0").join(unreported, "lang").select("r", "need", "a0", "a1")

    def run(batches):
        at, held = None, []

        def judge():
            h = np.concatenate([x[0] for x in held])
            c = np.concatenate([x[1] for x in held]).astype(np.int64)
            need = np.repeat([x[2] for x in held], [len(x[0]) for x in held])
            order, bounds = packed.groups(h)
            if not len(order):
                return
            ok = np.add.reduceat(c[order], bounds[:-1]) >= need[order[bounds[:-1]]]
            places = np.unique(h[order[bounds[:-1][ok]]] >> np.uint64(64 - bits)).astype(np.int64)
            if len(places):
                low = places[0] >> 3 << 3
                slice_ = np.zeros(places[-1] - low + 1, bool)
                slice_[places - low] = True
                yield pa.record_batch([pa.array([low >> 3]), pa.array([np.packbits(slice_).tobytes()])], names=["at", "bits"])

        for batch in batches:
            hs, hb = K.unpack(batch.column("a0"), np.uint64)
            cs, cb = K.unpack(batch.column("a1"), np.uint32)
            for i, (r, need) in enumerate(zip(batch.column("r").to_pylist(), batch.column("need").to_pylist(), strict=True)):
                if r != at and held:
                    yield from judge()
                    held = []
                at = r
                held.append((hs[hb[i] : hb[i + 1]].copy(), cs[cb[i] : cb[i + 1]].copy(), need))
        if held:
            yield from judge()

    out = np.zeros(1 << bits - 3, np.uint8)
    slices = rows.repartition(partitions, "r").sortWithinPartitions("r").mapInArrow(run, "at long, bits binary")
    for row in slices.toLocalIterator():
        piece = np.frombuffer(row["bits"], np.uint8)
        out[row["at"] : row["at"] + len(piece)] |= piece
    return out


def counted(docs: DataFrame, known, support: int, ranges: int, partitions: int, bits: int = MAP_BITS, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, f) of the phrases that the map (a broadcast) knows and that all shards together hold often enough.

    A shard sends its counts as one row for each range of texts, and a task adds up one range and language at a time.
    """

    def count(batches):
        bitmap, held, words = known.value, {}, 0

        def flush():
            for lang, found in held.items():
                dealt: dict[int, list[bytes]] = {}
                for p in found:
                    dealt.setdefault(zlib.crc32(p) * ranges >> 32, []).append(p)
                for r, part in dealt.items():
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([lang]), pa.array([part], pa.list_(pa.binary())), pa.array([[found[p] for p in part]], pa.list_(pa.int64()))], names=["r", "lang", "phrases", "counts"])

        for batch in batches:
            for lang, _, texts in _by_lang(batch):
                found = held.setdefault(lang, {})
                for _, buf, offs in K.chunks(texts, CHUNK):
                    w = Words(buf, offs)
                    g = Grams(w.hashes, w.piece, lang)
                    while True:
                        place = (g.hashes >> np.uint64(64 - bits)).astype(np.int64)
                        may = (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                        at = g.at[may]
                        order, bounds = packed.groups(g.hashes[may])
                        for i, c in zip(at[order[bounds[:-1]]].tolist(), np.diff(bounds).tolist(), strict=True):
                            p = w.phrase(i, g.n)
                            found[p] = found.get(p, 0) + c
                        if g.n == longest:
                            break
                        g.longer(may)
                    words += len(w.hashes)
                if words >= shard_words:
                    yield from flush()
                    held, words = {}, 0
        yield from flush()

    def add_up(batches):
        at, sums = None, {}

        def often():
            part = [(p, c) for p, c in sums.items() if c >= support]
            if part:
                yield pa.record_batch([pa.array([at[1]] * len(part)), pa.array([p for p, _ in part], pa.binary()).cast(pa.string()), pa.array([c for _, c in part], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for i, key in enumerate(zip(batch.column("r").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                if key != at:
                    yield from often()
                    at, sums = key, {}
                for p, c in zip(batch.column("phrases")[i].as_py(), batch.column("counts")[i].as_py(), strict=True):
                    sums[p] = sums.get(p, 0) + c
        yield from often()

    sent = docs.mapInArrow(count, "r int, lang string, phrases array<binary>, counts array<long>")
    return sent.repartition(partitions, "r").sortWithinPartitions("r", "lang").mapInArrow(add_up, "lang string, phrase string, f long")


def frequent(docs: DataFrame, support: int = SUPPORT, shard_words: int = SHARD_WORDS, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases up to the longest length that occur so often, words included; (lang, n) words of each language)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # written, so that its size is known when it is joined
    sizes = cut(texts.groupBy("lang").agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.lit(0)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    partitions = packed.partitions_of(docs)
    # no more tasks than shards, as small shards have low supports
    dealt = texts.join(sizes, "lang").coalesce(max(spark.sparkContext.defaultParallelism, total // shard_words + 1))
    reported = cut(shards(dealt, support, 8 * partitions, shard_words))
    known = spark.sparkContext.broadcast(survivors(reported, support, partitions, bits))
    return cut(counted(dealt, known, support, 8 * partitions, partitions, bits, shard_words=shard_words)), sizes


def _words(column) -> F.Column:
    return F.split(column, " ", -1)


def scored(found: DataFrame, sizes: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words or more, by its lowest cut (the first of equal ones)."""
    w = _words(F.col("phrase"))
    several = found.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), w.alias("w"))
    cuts = several.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left, right = (found.select("lang", F.col("phrase").alias(as_), F.col("f").alias(count)) for as_, count in (("first", "l"), ("rest", "r")))
    whole = lambda c, digits=19: F.col(c).cast(f"decimal({digits},0)")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    joined = joined.withColumn("over", F.lit(scale).cast("decimal(5,0)") * whole("a", 15) * whole("n", 15)).withColumn("under", whole("l") * whole("r", 18))
    joined = joined.withColumn("score", F.expr("over div under"))
    best = joined.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def swallowed(found: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases that never occur outside some longer frequent phrase.

    If one of two more words has the same count, then so has the one between, so one word more is enough.
    """
    w = _words(F.col("phrase"))
    longer = found.where(F.size(w) > 2).select("lang", "f", F.explode(F.array_distinct(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w)), " ")))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found.join(most, ["lang", "phrase"]).where(F.col("longer") >= F.col("f")).select("lang", "phrase")


def ranked(rows: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first rows of each language. A language's rows are first thinned by hash, so that no task sorts all of them."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(salts))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shard_words: int = SHARD_WORDS, bits: int = MAP_BITS) -> DataFrame:
    """Per language the first phrases of 2 to 5 words by score: lang, rank, phrase, a, l, r, n, score."""
    found, sizes = frequent(docs, support, shard_words, bits)
    rows = scored(found, sizes).join(swallowed(found), ["lang", "phrase"], "left_anti")
    return ranked(rows, top)
