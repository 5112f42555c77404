"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide
vector, and the document's fingerprint is the sum of these vectors modulo 2**32, so it
does not depend on their order, and a paragraph is added or taken away by adding or
subtracting its vector (``combine``). The vector has two parts: ``EXACT`` lanes from a
hash of the whole paragraph, for equality, and 65 lanes for likeness: how many pairs of
neighbouring words the paragraph has, and how many of these have each bit of their hash
set. The fingerprint as text holds all lanes, so likeness can be read from two of them
(``lanes``). Two texts' likeness is the cosine of the signed sums (2 * lane - count): near 1 for
the same pairs, near 0 for others.

Only DataFrame functions are used, and one exchange of the texts: rows are dealt by
ranges of doc_id, so that a row's successor is in its own range; the first rows of a range
are also sent to the range before. An id that has many rows (null, or repeated) is split
into ranges by a hash of the text, which is also what orders its rows.

Defined cases: a null text is empty; an empty text has one empty paragraph; a null id
comes first; rows with equal ids are ordered by a hash of their text, equal rows follow
each other; a lone document is its own successor; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

EXACT = 8
PAIR_BITS = 64
RANGES = 256
_LOW = 0xFFFFFFFF
_HALF = PAIR_BITS // 2
LANES = EXACT + 1 + PAIR_BITS


def _sums(first: Column, paragraph: str, pair: Column) -> list[Column]:
    """Aggregates over (paragraph, pair) rows; first marks one row of each paragraph."""
    out = []
    for i in range(EXACT // 2):
        h = F.xxhash64(F.lit(i), paragraph)
        out.append(F.sum(F.when(first, h.bitwiseAND(F.lit(_LOW))).otherwise(F.lit(0).cast("long"))).alias(f"e{2 * i}"))
        out.append(F.sum(F.when(first, F.shiftrightunsigned(h, 32)).otherwise(F.lit(0).cast("long"))).alias(f"e{2 * i + 1}"))
    for j in range(_HALF):
        # two bits of the hash in one sum, 31 bits apart
        low = F.shiftright(pair, j).bitwiseAND(F.lit(1).cast("long"))
        high = F.shiftleft(F.shiftright(pair, j + _HALF).bitwiseAND(F.lit(1).cast("long")), 31)
        out.append(F.sum(low.bitwiseOR(high)).alias(f"b{j}"))
    return [*out, F.count(F.lit(1)).alias("pairs")]


def _vector() -> Column:
    """The lanes in order, modulo 2**32."""
    exact = [F.pmod(F.col(f"e{i}"), F.lit(1 << 32)) for i in range(EXACT)]
    low = [F.col(f"b{j}").bitwiseAND(F.lit((1 << 31) - 1)) for j in range(_HALF)]
    high = [F.shiftrightunsigned(F.col(f"b{j}"), 31) for j in range(_HALF)]
    return F.array(*exact, F.pmod(F.col("pairs"), F.lit(1 << 32)), *low, *high)


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and v, the fingerprint's lanes; keys name a row. No exchange if rows are dealt by some of the keys."""
    parts = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p"))
    parts = parts.select(*keys, "p", F.split("p", r"[\x20\x09-\x0D]+").alias("w"))
    spots = parts.select(*keys, "p", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    pair = F.xxhash64(F.element_at("w", F.col("i")), F.when(F.col("i") < F.size("w"), F.element_at("w", F.least(F.col("i") + 1, F.size("w")))).otherwise(F.lit("")))
    spots = spots.select(*keys, "p", (F.col("i") == 1).alias("first"), pair.alias("pair"))
    return spots.groupBy(*keys).agg(*_sums(F.col("first"), "p", F.col("pair"))).select(*keys, _vector().alias("v"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint lanes of two multisets together, or (sign -1) of a without b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(1 << 32)))


def digest(v: Column) -> Column:
    """The fingerprint as text: all lanes in hex, eight digits each."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def lanes(fingerprint: Column) -> Column:
    """The lanes of a fingerprint given as text."""
    return F.transform(F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, 1 for equal vectors."""

    def signed(v):
        n = F.element_at(v, EXACT + 1)
        return F.transform(F.slice(v, EXACT + 2, PAIR_BITS), lambda x: (x * 2 - n).cast("double"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    x, y = signed(a), signed(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    cos = F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (text) and v (lanes) of every document."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return vectors(rows, ["row", "doc_id"], "text").select("doc_id", digest(F.col("v")).alias("fingerprint"), "v")


#: Ranges for each shuffle partition, so that partitions are about equal though ranges are dealt by hash.
EACH = 16


def _dealt(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, k, z (its range) of all rows; and the first (doc_id, k) of each range.

    Cells lie between RANGES quantiles of the ids and are split evenly by id, so that there are about EACH ranges for each
    shuffle partition. The rows of an id that holds several quantiles, or is null, are split by k instead.
    """
    spark = documents.sparkSession
    split = max(1, EACH * int(spark.conf.get("spark.sql.shuffle.partitions")) // RANGES)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 20 * RANGES), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).head()
    quantiles = [x for x in cuts[0] or [] if x is not None]
    bounds = sorted({*quantiles, *(x for x in cuts[1:3] if x is not None)})
    # how many ranges the rows of an id alone, or of null, are worth
    worth = lambda held: max(1, held * split)
    parts = [worth(quantiles.count(x)) if quantiles.count(x) > 1 else 0 for x in bounds]
    nulls = worth(RANGES * cuts[3] // max(1, cuts[4]))
    arrays = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs or [0]])
    edges, alone = arrays(bounds), arrays(parts)
    cell = F.size(F.filter(edges, lambda e: e <= F.col("doc_id")))
    low, own = (F.element_at(x, F.greatest(F.col("cell"), F.lit(1))) for x in (edges, alone))
    high = F.element_at(edges, F.least(F.col("cell") + 1, F.size(edges)))
    by_id = F.when(high > low, F.floor((F.col("doc_id") - low).cast("double") / (high - low).cast("double") * split)).otherwise(0)
    by_text = lambda n: F.floor((F.shiftright("k", 32) + F.lit(1 << 31)) * n / F.lit(1 << 32))
    inner = F.when(F.col("doc_id").isNull(), by_text(F.lit(nulls))).when((own > 0) & (F.col("doc_id") == low), by_text(own)).otherwise(own + F.least(by_id, F.lit(split - 1)))
    rows = rows.withColumn("cell", F.when(F.col("doc_id").isNull(), 0).otherwise(cell)).withColumn("z", (F.col("cell") * F.lit(1 << 32) + inner).cast("long")).drop("cell")
    firsts = rows.groupBy("z").agg(F.min(F.struct("doc_id", "k")).alias("f"))
    return rows, firsts


def compare(documents: DataFrame, part: int = 4) -> DataFrame:
    """Every document against its edited text and its successor.

    The edited text has its last n // part characters replaced by the successor's first
    as many. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows, firsts = _dealt(documents)
    # one row per range: the first rows of a range also go to the range before it, of the first range to the last
    w = Window.orderBy("z")
    edge = firsts.select("z", F.coalesce(F.lag("z").over(w), F.max("z").over(Window.partitionBy())).alias("guest_of"), F.col("f.doc_id").alias("fd"), F.col("f.k").alias("fk"))
    edge = cut(edge)
    if edge.count() <= 200_000:
        edge = F.broadcast(edge)
    here = F.struct(F.col("z"), F.lit(0).alias("guest"))
    rows = rows.join(edge.withColumnRenamed("z", "ez"), (F.col("z") == F.col("ez")) & F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("k") == F.col("fk")), "left")
    there = F.struct(F.col("guest_of").alias("z"), F.lit(1).alias("guest"))
    rows = rows.select("doc_id", "text", "k", F.explode(F.when(F.col("guest_of").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"))
    rows = rows.select(F.col("to.z").alias("z"), F.col("to.guest").alias("guest"), "doc_id", "k", "text")
    order = Window.partitionBy("z").orderBy("guest", "doc_id", "k")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.char_length("text")
    q = F.floor(n / part).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring(F.coalesce("next", F.lit("")), F.lit(1), q))
    rows = rows.select("z", "at", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["z", "at", "guest", "doc_id", "n_chars"]
    both = rows.select(*keys, F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("s"))
    both = both.select(*keys, "edited_sha256", F.col("s.kind").alias("kind"), F.col("s.t").alias("t"))
    v = vectors(both, [*keys, "edited_sha256", "kind"], "t")
    v = v.groupBy(*keys, "edited_sha256").agg(F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("v"), F.max(F.when(F.col("kind") == 1, F.col("v"))).alias("e"))
    v = v.withColumn("n", F.lead("v").over(Window.partitionBy("z").orderBy("at"))).where("guest = 0")
    return v.select("doc_id", "n_chars", "edited_sha256", digest(F.col("v")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.coalesce("n", "v")).alias("near_next"))
