"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the golden-ratio point frac((i + 1) * phi), which falls into one
source's share of [0, 1); any run of slots thus holds each source close to its share.
A source's documents are shuffled by hash and laid end to end, twice if its target needs
it, and cut into blocks of equal token counts; its r-th slot takes its r-th block, and a
block without slot isn't taken. A source stops within the block in which its target is
met, and slots go on until all have stopped. One whose share is too small for a slot takes
one block at the end of the mix.

What goes through windows without partitions is one row for each source, not one for each
document.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of
its own, weighed last; rows equal in all are separate documents; null ids are kept;
other columns are ignored; an empty table gives an empty result. All orders come from
hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
SLOTS = 65_536
BLOCK_WORDS = 4_096
GOLDEN = 0.6180339887498949
CELLS = 1_024
RUN = 16_384
BUCKETS = 1_024
SEED = 20


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the row's place in the shuffle of its source: h, and b, h's bucket."""
    h = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), F.col("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), h.alias("h"), F.shiftrightunsigned(h, 54).cast("int").alias("b"))


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) -> also sid, target, lo and hi, the source's part of [0, 1).

    Excess over repeats times a source's size is shared by weight among the others until
    none is above. The common level is found in order of capacity per weight. One row per
    source goes through these windows, not one per document.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    # binary order of UTF-8 is code point order
    ranked = sums.withColumn("sid", F.row_number().over(order).cast("long"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    up = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    below, above = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(whole)["level"])
    ranked = ranked.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))))
    run, all_of = F.sum("target").over(Window.orderBy("sid")), F.sum("target").over(whole)
    ranked = ranked.withColumn("mix_size", all_of).withColumn("hi", F.when(all_of > 0, run / all_of).otherwise(0.0))
    last = F.max("sid").over(whole)
    ranked = ranked.withColumn("hi", F.when((F.col("sid") == last) & (all_of > 0), 1.0).otherwise(F.col("hi")))
    return ranked.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))).select("sid", "source", "source_size", "target", "mix_size", "lo", "hi")


def block_words(mix_size: float, slots: int = SLOTS, most: int = BLOCK_WORDS) -> tuple[int, int]:
    """(number of slots, words of a block): at least so many slots, with at most so many words each."""
    n = max(slots, int(mix_size // most) + 1)
    block = max(1, int(mix_size / n + 0.999999))
    return max(1, int(round(mix_size / block))), block


def schedule(shares: DataFrame, n: int) -> DataFrame:
    """(sid, slot, rank): which source each slot takes from, and how many slots it had before."""
    i = F.col("id")
    # frac((i + 1) * phi) in two parts, so that large i keep their precision
    coarse, fine = F.floor((i + 1) / RUN), (i + 1) % RUN
    x = F.pmod(coarse * F.lit(GOLDEN * RUN % 1.0) + fine * F.lit(GOLDEN), F.lit(1.0))
    slots = shares.sparkSession.range(n).select(i.alias("slot"), x.alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    cells = shares.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    dealt = slots.join(cells, "cell").where("x >= lo and x < hi").select("sid", "slot", F.floor(F.col("slot") / RUN).alias("run"))
    before = dealt.groupBy("sid", "run").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    return inside.join(before.select("sid", "run", "before"), ["sid", "run"]).select("sid", "slot", (F.col("before") + F.col("at")).alias("rank"))


def _before(column: str, by: list[str], order: list) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, slots: int = SLOTS, most: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target of its source, taken, its words in the mix, first_slot, where the
    mix first takes it (null: never), and taken_early, its words in the first tenth of the slots.

    Running sums go by bucket of the shuffle first, so a source with most of the rows is
    spread over many tasks.
    """
    rows = cut(sized(docs))
    buckets = rows.groupBy("source", "b").agg(F.sum("size").alias("bucket_size"))
    shares = cut(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, repeats))
    head = shares.select("mix_size").head()
    n, block = block_words(float(head[0] or 0), slots, most) if head else (1, 1)
    buckets = buckets.withColumn("bucket_start", _before("bucket_size", ["source"], ["b"]))
    buckets = buckets.join(shares.select("sid", F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("bs"), F.col("b").alias("bb"), "sid", "source_size", "target", "bucket_start")
    placed = rows.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("bb"))).drop("bs", "bb")
    placed = placed.withColumn("start", F.col("bucket_start") + _before("size", ["sid", "b"], ["h", "size"]))
    passes = placed.where("size > 0").select("sid", "start", "size", "source_size", F.round("target").cast("long").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    passes = passes.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    passes = passes.where(F.col("from") < F.col("whole")).withColumn("to", F.least("to", "whole"))
    pieces = passes.select("sid", "start", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
    pieces = pieces.withColumn("words", F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block))
    # twice the slots, as some sources meet their targets a few slots late
    dealt = cut(schedule(shares, 2 * n))
    # a source that is short of its target takes one block more, at the end of the mix
    had = shares.select("sid", F.ceil(F.round("target") / block).alias("blocks")).join(dealt.groupBy("sid").agg(F.count(F.lit(1)).alias("slots")), "sid", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    last = had.where("slots < blocks").select("sid", (F.lit(2 * n) + F.col("sid") - 1).alias("slot"), F.col("slots").alias("rank"))
    words, early = F.col("words"), F.col("slot") < n // 10
    taken = pieces.join(dealt.unionByName(last), ["sid", "rank"]).groupBy("sid", "start").agg(F.sum(words).alias("taken"), F.min("slot").alias("first_slot"), F.sum(F.when(early, words).otherwise(0)).alias("taken_early"))
    taken = taken.select(F.col("sid").alias("tid"), F.col("start").alias("ts"), "taken", "first_slot", "taken_early")
    out = placed.join(taken, (F.col("sid") == F.col("tid")) & (F.col("start") == F.col("ts")) & (F.col("size") > 0), "left")
    nothing = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source", "source_size", "target", nothing("taken"), "first_slot", nothing("taken_early"))
