"""Benchmark decontamination by spaced-seed hashing.

A mask selects some positions of a short span of words and ignores the others. Test
items and documents are hashed under the same fixed masks and joined on the hash, so a
match survives substitutions at ignored positions. Around every hit the item is laid on
the document's words, and the words that agree are counted: an item counts as found
where, in some run of ``WINDOW`` of its words, ``MIN_SIMILARITY`` of them agree.

Words are compared after lower-casing; they are what stands between blanks. Only
DataFrame functions are used. The seeds of the test items, and the hits, are broadcast
while they are few (``BROADCAST_SEEDS``, counted first), and joined by shuffle beyond.

Defined cases: a null or empty text has no words; items under five words must agree in all
of them (``least_words`` leaves items out that chance would match); documents equal in id
and text are reported once, repeated items under each id; null ids of either table are
kept; other columns are ignored by ``find`` and kept by ``drop_contaminated``, whatever
their names; empty tables give no rows. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, unused

# From so many words of an item on, its masks: whichever words of a run of WINDOW (or of a shorter item) differ, as many as
# MIN_SIMILARITY allows, one of the masks fits between them. Each begins and ends with a word that counts, so that words which a
# document's edge cuts off are words that differ.
SEED_MASKS = {
    13: ("111011101", "1110100111", "1001110111"),
    12: ("11101011", "1111011", "11001111"),
    11: ("1110111", "11101011", "10110111", "11100111"),
    5: ("111", "11011"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
WINDOW = 13
MIN_SIMILARITY = 0.8
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")


def _hash(words: str, at: Column, mask: str, name: int) -> Column:
    picked = [F.element_at(words, (at + i + 1).cast("int")) for i, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(name), *picked)


def _fits(words: str, at: Column, mask: str) -> Column:
    return at + len(mask) <= F.size(words)


def seeds(texts: DataFrame, masks: dict[str, int]) -> DataFrame:
    """All columns, at (a word's position) and seed, the hash of each mask that fits there. Every word is a start."""
    at = F.col("at")
    spots = texts.where(F.size("words") >= min(map(len, masks))).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - min(map(len, masks)))))
    hashes = [F.when(_fits("words", at, m), _hash("words", at, m, i)) for m, i in masks.items()]
    return spots.withColumn("seed", F.explode(F.array(*hashes))).where("seed is not null")


def find(documents: DataFrame, benchmark: DataFrame, masks=SEED_MASKS, window: int = WINDOW, similarity: float = MIN_SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS, least_words: int = 1) -> DataFrame:
    """One row per document row k (see below) and item found in it.

    Columns: k (a hash of doc_id and text), doc_id, item_id, item_words, matched_words on
    the best alignment, best_run (agreeing words in the best run), first_word (where the
    item's first word falls in the document, which may be before its start).
    """
    items = benchmark.select("item_id", F.xxhash64(F.col("item_id").cast("string"), F.col("text")).alias("item_key"), F.filter(words_of(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") >= least_words)
    items = items.withColumn("n", F.size("words"))
    bounds = sorted(masks, reverse=True)
    groups = {lo: (F.col("n") >= lo) & (F.col("n") < hi) if hi else F.col("n") >= lo for lo, hi in zip(bounds, [None, *bounds], strict=False)}
    total, *held = items.agg(F.sum("n"), *[F.count_if(g) for g in groups.values()]).head()
    # the documents are hashed under the masks of those lengths that items have
    used, marked = {}, None
    for lo, own in ((lo, g) for (lo, g), m in zip(groups.items(), held, strict=True) if m or lo == bounds[0]):
        ids = {m: used.setdefault(m, len(used)) for m in masks[lo]}
        some = seeds(items.where(own), ids)
        marked = some if marked is None else marked.unionByName(some)
    probes = marked.select("seed", "item_key", F.col("at").alias("item_at")).distinct()
    if (total or 0) * len(used) <= broadcast_seeds:
        probes = F.broadcast(probes)
    docs = documents.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("k"), words_of(F.col("text")).alias("words"))
    # the words stay behind: with them, each position would carry a copy of its whole text
    spots = seeds(docs.select("k", "words"), used).select("k", "at", "seed")
    start = (F.col("at") - F.col("item_at")).cast("int")
    hits = cut(spots.join(probes, "seed").select("k", "item_key", start.alias("first_word")).distinct())
    if hits.count() <= broadcast_seeds:
        hits = F.broadcast(hits)
    skip = F.least(F.col("first_word"), F.lit(0))
    laid = docs.join(hits, "k").join(items.select("item_key", "item_id", F.col("words").alias("item")).distinct(), "item_key")
    laid = laid.select("k", "doc_id", "item_id", "item", "first_word", F.slice("words", F.greatest("first_word", F.lit(0)) + 1, F.size("item") + skip).alias("there"))
    agree = F.transform("item", lambda w, j: F.when((j + skip >= 0) & (F.try_element_at("there", F.greatest(j + skip + 1, F.lit(1)).cast("int")) == w), 1).otherwise(0))
    hits = laid.withColumn("agree", agree)
    run = F.least(F.lit(window), F.size("item"))
    runs = F.transform(F.sequence(F.lit(1), F.size("item") - run + 1), lambda s: F.aggregate(F.slice("agree", s, run), F.lit(0), lambda a, x: a + x))
    found = hits.withColumn("best_run", F.array_max(runs)).where(F.col("best_run") * 100 >= F.round(F.lit(similarity * 100)) * run)
    found = found.withColumn("matched_words", F.aggregate("agree", F.lit(0), lambda a, x: a + x))
    best = F.max_by(F.struct("matched_words", "best_run", "first_word"), F.struct("matched_words", "best_run", -F.col("first_word"))).alias("b")
    out = found.groupBy("k", "doc_id", "item_id", F.size("item").alias("item_words")).agg(best)
    return out.select("k", "doc_id", "item_id", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("item_words", "b.matched_words", "b.best_run", "b.first_word")])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    key = unused(documents, "key")
    bad = find(documents, benchmark, **how).select(F.col("k").alias(key)).distinct()
    rows = documents.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    return rows.join(bad, key, "left_anti").select(*documents.columns)
