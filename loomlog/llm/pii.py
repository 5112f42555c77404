"""PII by candidate gradient boosting.

High-recall patterns propose spans, which may overlap. Each candidate has yes-or-no
features of its format and of the words around it. Boosted trees of depth two learn from
planted spans (``examples``): values of each format, written after words that go with
personal data, with other data, or with neither, of which it is known what they stand
for. Trees are grown on one half of them; on the other half a threshold per kind is
calibrated, the lowest at which ``PRECISION`` of the selected spans are personal. The
trees become one column expression, so whether a span is selected depends on its own
document alone.

Four base kinds (email, ip, card, phone) are exact: what passes their checks is always a
span. The method adds spans of other kinds, which may overlap base spans and one another.

Only DataFrame functions run over the data. Patterns are possessive or bounded, so that
each takes linear time on any text. Positions count code points, ends are exclusive.

Defined cases: a null text is empty; each row is judged by itself, equal rows alike; a
null id is kept; other columns are ignored by ``report`` and kept by ``redact``, whatever
their names; an empty table gives no rows; without candidates nothing is added. Very long
texts are searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, unused

# The base formats, in the order in which kinds are listed, then the generators' formats.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\x20]{0,2}[:=][\x20]{0,2}[\"']?[A-Za-z0-9+/_=-]{8,}+",
    "hex": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "spelled": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}",
}
KINDS = tuple(PATTERNS)
GUARDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "secret": r"(?i)(?:key|token|secret|passw|pwd)[a-z]{0,2}[\x20]{0,2}[:=]",
    "hex": r"[0-9a-fA-F]{32}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "local": r"[0-9]{3}[.-][0-9]{4}",
    "spelled": r"(?i)[\[(]\x20?at\x20?[\])]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUES = r"(?i)(?:mail|phone|tel|call|fax|host|server|addr|card|visa|account|iban|ssn|token|key|secret|password|contact|user)[^A-Za-z0-9]{0,4}$"
_OTHERS = r"(?i)(?:order|ref|part|item|invoice|version|build|commit|sha|md5|checksum|serial|ticket|page|row|until)[^A-Za-z0-9]{0,4}$"

#: Planted spans that the trees learn from.
EXAMPLES = 24_000
PRECISION = 0.9
ROUNDS = 40
RATE = 0.3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass; null for none."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _iban(x: Column) -> Column:
    """The mod-97 check, letters counting from 10."""
    s = F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(r, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: Column, hit: Column) -> Column:
    """The check of each kind. For base kinds it decides; for others it is a feature."""
    n = F.length(_digits(hit))
    varied = F.size(F.array_distinct(F.split(hit, ""))) >= 10
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", hit.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind.isin("secret", "hex"), varied & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"))
        .when(kind == "ssn", ~hit.rlike("^(?:000|666|9)|-00-|0000$"))
        .when(kind == "iban", _iban(hit))
        .when(kind == "local", hit.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9]"))
        .otherwise(hit.rlike(r"(?i)(?:dot\x20?[\])]\x20?|\.)[a-z]{2,}$"))
    )


def _features(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(_digits(hit))
    return [
        _valid(kind, hit),
        before.rlike(_OTHERS),
        before.rlike(_CUES),
        (before == "") | before.rlike(r"[\s\"'(\[<:=]$"),
        (after == "") | after.rlike(r"^[\s\"')\]>.,;:!?]"),
        hit.rlike(r"[\x20().-]"),
        n >= 10,
        n == F.length(hit),
        hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
        F.size(F.array_distinct(F.split(hit, ""))) >= 12,
        before.rlike(r"[0-9$#.,/-]\x20?$"),
        F.length(hit) >= 16,
        hit.rlike(r"(.)\1{3}"),
    ]


N_FEATURES = 13


def _candidate(kind: int, pieces: str):
    """For hit j: its text, the length of the piece of text before it, and what stands around it."""

    def made(hit, j):
        before, after = F.element_at(pieces, j + 1), F.element_at(pieces, j + 2)
        return F.struct(F.lit(kind).alias("kind"), j.alias("i"), F.length(before).alias("gap"), hit.alias("hit"), F.right(before, F.lit(16)).alias("before"), F.left(after, F.lit(4)).alias("after"))

    return made


def candidates(documents: DataFrame) -> DataFrame:
    """One row per candidate, and one with a null kind per document: row, doc_id, kind, start, end, bits (of which bit 0 says that the check holds)."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        at = F.col("text").rlike(GUARDS[kind])
        rows = rows.withColumn(f"p_{kind}", F.when(at, F.split("text", pattern, -1))).withColumn(f"h_{kind}", F.when(at, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    lists = [F.coalesce(F.transform(f"h_{kind}", _candidate(i, f"p_{kind}")), F.array()) for i, kind in enumerate(KINDS)]
    found = rows.select("row", "doc_id", F.explode(F.concat(F.flatten(F.array(*lists)), F.array(F.lit(None)))).alias("c")).select("row", "doc_id", "c.*")
    found = found.repartition("row")
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(w)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    bits = F.lit(0)
    for i, f in enumerate(_features(name, F.col("hit"), F.col("before"), F.col("after"))):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    known = F.col("kind").isNotNull()
    return found.select("row", "doc_id", "kind", "start", "end", F.when(known, bits).alias("bits"))


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Planted spans: doc_id, which holds the id, the kind and whether the span is personal, and text. Made by rule from row numbers."""
    at = lambda i: F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1 << 40))
    one = lambda i, *xs: F.element_at(F.array(*map(F.lit, xs)), (at(i) % len(xs) + 1).cast("int"))
    number = lambda i, width, least=0: F.lpad((at(i) % (10**width - least) + least).cast("string"), width, "0")
    name, site = one(1, "ann", "j.doe", "k_lee", "office"), one(2, "mail1", "corp", "home-7", "zone")
    hexed = F.substring(F.sha2(F.col("id").cast("string"), 256), F.lit(1), one(3, 32, 40, 64))
    account = number(4, 9), number(5, 9)
    check = F.lit(98) - F.concat(*account, F.lit("131400")).cast("decimal(38,0)") % 97
    iban = lambda off: F.concat(F.lit("DE"), F.lpad(((check - 2 + off) % 97 + 2).cast("int").cast("string"), 2, "0"), *account)
    # per kind: the good value, a value of the format that is none, the words before good and other ones, and how often the good value is personal where neither kind of word stands before it
    kinds = {
        "secret": (F.concat(one(6, "token", "api_key", "password", "secret"), one(7, " = \"", ": ", "="), one(8, hexed, F.substring(F.base64(F.unhex(hexed)), 1, 20))), F.concat(one(6, "token", "api_key", "password", "secret"), one(7, " = \"", ": ", "="), one(9, "changeme", "your_value_here", "xxxxxxxxxxxx", "undefined", "00000000")), ("user", "key"), ("page", "item"), 97),
        "hex": (hexed, F.repeat(one(10, "0", "a", "f"), 40), ("secret key", "token = \"", "api key:", "private key"), ("commit", "md5", "checksum", "build"), 15),
        "ssn": (F.concat(number(11, 3, 101), F.lit("-"), number(12, 2, 10), F.lit("-"), number(13, 4, 1000)), F.concat(F.lit("000-"), number(12, 2, 10), F.lit("-"), number(13, 4, 1000)), ("ssn", "account", "ssn:"), ("order", "part", "ref"), 92),
        "iban": (iban(0), iban(1), ("iban", "account", "iban:"), ("serial", "ref", "item"), 97),
        "local": (F.concat(one(14, "(", ""), number(15, 3, 201), one(14, ") ", "-"), number(16, 3, 201), F.lit("-"), number(17, 4)), F.concat(F.lit("0"), number(15, 2), F.lit("-1"), number(16, 2), F.lit("-"), number(17, 4)), ("call", "tel", "phone:", "fax"), ("part", "order", "version", "ticket"), 60),
        "spelled": (F.concat(name, one(18, " [at] ", "(at)", " (at) "), site, one(19, " [dot] ", "(dot)", "."), one(20, "com", "org", "de")), F.concat(name, F.lit(" (at) "), number(21, 2), F.lit("."), number(22, 2)), ("mail", "contact"), ("until", "row"), 92),
    }
    personal, value, cue, kind = (F.lit(None).cast(t) for t in ("boolean", "string", "string", "int"))
    which, good = at(30) % len(kinds), at(31) % 4 > 0
    for i, (k, (yes, no, near, far, share)) in enumerate(kinds.items()):
        mine = which == i
        words = F.when(at(32) % 3 == 0, one(33, *near)).when(at(32) % 3 == 1, one(33, *far)).otherwise(one(33, "and", "then,", "the", "of"))
        value, cue, kind = F.when(mine, F.when(good, yes).otherwise(no)).otherwise(value), F.when(mine, words).otherwise(cue), F.when(mine, KINDS.index(k)).otherwise(kind)
        personal = F.when(mine, good & ((at(32) % 3 == 0) | (at(32) % 3 == 2) & (at(34) % 100 < share))).otherwise(personal)
    text = F.concat(one(35, "It was said that ", "re ", "On Monday, "), cue, F.when(cue.endswith('"'), "").otherwise(" "), value, one(36, "\" ", " and so on", ", later.", ""))
    rows = spark.range(n)
    return rows.select(((F.col("id") * 16 + kind) * 2 + personal.cast("int")).alias("doc_id"), text.alias("text"))


def boost(x: np.ndarray, good: np.ndarray, total: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Logistic gradient boosting over counted rows of yes-or-no features. A tree is (feature, then, else), a leaf a number."""
    score, trees = np.zeros(len(x)), []

    def grow(rows, g, h, depth):
        leaf = rate * float(g[rows].sum() / (h[rows].sum() + 1.0))
        yes = x[rows]
        gy, hy, ga, ha = g[rows] @ yes, h[rows] @ yes, g[rows].sum(), h[rows].sum()
        gain = gy**2 / (hy + 1.0) + (ga - gy) ** 2 / (ha - hy + 1.0) - ga**2 / (ha + 1.0)
        best = int(gain.argmax())
        return leaf if not depth or gain[best] <= 1e-9 else (best, grow(rows & x[:, best], g, h, depth - 1), grow(rows & ~x[:, best], g, h, depth - 1))

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        trees.append(grow(np.ones(len(x), dtype=bool), good - total * p, total * p * (1 - p), 2))
        score += value_of(trees[-1], x)
    return trees


def merged(trees: list) -> list:
    """Trees that ask the same questions added up to one, so that the expression over the corpus stays short."""
    shape = lambda t: None if isinstance(t, float) else (t[0], shape(t[1]), shape(t[2]))
    add = lambda a, b: a + b if isinstance(a, float) else (a[0], add(a[1], b[1]), add(a[2], b[2]))
    out: dict = {}
    for t in trees:
        out[shape(t)] = add(out[shape(t)], t) if shape(t) in out else t
    return list(out.values())


def value_of(tree, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), tree) if isinstance(tree, float) else np.where(x[:, tree[0]], value_of(tree[1], x), value_of(tree[2], x))


def learn(spark: SparkSession, precision: float = PRECISION) -> tuple[list, dict[int, float]]:
    """The trees, and the least score selected of each added kind (absent: none). A row per kind and bits of the examples comes to the driver."""
    found = candidates(examples(spark)).where("kind = floor(doc_id / 2) % 16")
    rows = found.groupBy("kind", "bits", (F.floor(F.col("doc_id") / 32) % 2).alias("half")).agg(F.sum(F.col("doc_id") % 2).alias("good"), F.count(F.lit(1)).alias("total")).orderBy("half", "kind", "bits").collect()
    kind, bits, half, good, total = (np.array([r[c] for r in rows]) for c in ("kind", "bits", "half", "good", "total"))
    x = np.column_stack([*((bits >> i) & 1 for i in range(N_FEATURES)), *(kind == k for k in range(len(KINDS)))]).astype(bool)
    grown = half == 0
    trees = merged(boost(x[grown], good[grown].astype(float), total[grown].astype(float)))
    score, least = sum(value_of(t, x) for t in trees), {}
    for k in range(len(BASE), len(KINDS)):
        own = np.flatnonzero((kind == k) & ~grown)
        own = own[np.argsort(-score[own], kind="stable")]
        fine = np.cumsum(good[own]) >= precision * np.cumsum(total[own])
        # equal scores stay together
        last = np.flatnonzero(fine & np.append(score[own][1:] != score[own][:-1], True)[: len(own)])
        if len(last):
            least[k] = float(score[own[last[-1]]])
    return trees, least


def selected(trees: list, least: dict[int, float]) -> Column:
    """Whether a candidate (kind, bits) is a span."""

    def value(tree):
        if isinstance(tree, float):
            return F.lit(tree)
        yes = (F.col("bits").bitwiseAND(F.lit(1 << tree[0])) != 0) if tree[0] < N_FEATURES else F.col("kind") == tree[0] - N_FEATURES
        return F.when(yes, value(tree[1])).otherwise(value(tree[2]))

    limit = F.lit(None).cast("double")
    for k, x in least.items():
        # sums are taken in the same order as in learn(), but for their start
        limit = F.when(F.col("kind") == k, x - 1e-9).otherwise(limit)
    score = sum((value(t) for t in trees), F.lit(0.0))
    return F.when(F.col("kind") < len(BASE), F.col("bits") % 2 == 1).otherwise(F.coalesce(score >= limit, F.lit(False)))


def spans(documents: DataFrame) -> DataFrame:
    """Selected spans, and one row with a null kind per document: row, doc_id, k (number of the kind), kind (name), base, start, end."""
    # written once: else the trees' expression would be laid over that of every feature they ask for
    kept = cut(candidates(documents)).where(F.col("kind").isNull() | selected(*learn(documents.sparkSession)))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return kept.select("row", "doc_id", F.col("kind").alias("k"), name.alias("kind"), (F.col("kind") < len(BASE)).alias("base"), "start", "end")


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base kinds, base_sha256 and all spans as text."""
    found = spans(documents)
    item = F.when(F.col("k").isNotNull(), F.struct("start", "k", "end", F.format_string("%s:%d:%d", "kind", "start", "end").alias("said")))
    out = found.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("k") == i, 1)).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        F.array_sort(F.collect_list(item)).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("own"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["said"]), ",")
    return out.select("doc_id", *[f"n_{kind}" for kind in BASE], F.sha2(joined("own"), 256).alias("base_sha256"), joined("all").alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, with each selected span of text replaced by its kind in brackets."""
    tagged = documents.select(F.col("text"), F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "text")]).alias("doc_id"))
    found = spans(tagged).where("k is not null").select("doc_id", "start", "end", "kind", "base").distinct()
    # between two neighbouring bounds a base span is cut before an added one; what is cut together has the name of the first
    opens = F.struct(F.col("start").alias("at"), "base", F.lit(1).alias("step"), "end", "kind")
    closes = F.struct(F.col("end").alias("at"), "base", F.lit(-1).alias("step"), "end", "kind")
    ends = found.select("doc_id", F.explode(F.array(opens, closes)).alias("x")).select("doc_id", "x.*")
    sides = []
    for side, mine in (("base", F.col("base")), ("more", ~F.col("base"))):
        fresh = mine & (F.col("step") > 0)
        sides += [F.sum(F.when(mine, F.col("step")).otherwise(0)).alias(f"{side}_step"), F.count_if(fresh).alias(f"{side}_new")]
        sides += [F.max(F.when(fresh, F.col("end"))).alias(f"{side}_end"), F.min_by("kind", F.when(fresh, F.struct(-F.col("end"), "kind"))).alias(f"{side}_kind")]
    w = Window.partitionBy("doc_id").orderBy("at")
    cuts = ends.groupBy("doc_id", "at").agg(*sides)
    cuts = cuts.select("*", F.sum("base_step").over(w).alias("base_on"), F.sum("more_step").over(w).alias("more_on"), F.max(F.when(F.col("more_kind").isNotNull(), F.struct("more_end", -F.col("at"), "more_kind"))).over(w).alias("open"), F.lead("at").over(w).alias("end"))
    # a base span goes on at a bound if more are open there than have begun; so does an added one, unless a base span ended there
    after = F.coalesce(F.lag("base_on").over(w), F.lit(0)) > 0
    more = F.when(after | (F.col("more_on") == F.col("more_new")), F.col("open.more_kind"))
    kind = F.when(F.col("base_on") > 0, F.when(F.col("base_on") == F.col("base_new"), F.col("base_kind"))).otherwise(more)
    found = cuts.select("doc_id", F.col("at").alias("from"), "end", kind.alias("kind"), (F.col("base_on") + F.col("more_on")).alias("open")).where("open > 0")
    key, own, spans_of = (unused(documents, c) for c in ("key", "own", "spans"))
    marks = found.groupBy(F.col("doc_id").alias(own)).agg(F.array_sort(F.collect_list(F.struct("from", "end", "kind"))).alias(spans_of))
    rows = documents.withColumn(key, F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "text")])).join(marks, F.col(key) == F.col(own), "left")
    before = lambda i: F.when(i > 0, F.element_at(spans_of, F.greatest(i, F.lit(1)))["end"]).otherwise(0).cast("int")
    piece = F.transform(spans_of, lambda s, i: F.concat(F.substring("text", before(i) + 1, s["from"].cast("int") - before(i)), F.coalesce(F.concat(F.lit("["), s["kind"], F.lit("]")), F.lit(""))))
    tail = F.substring("text", F.element_at(spans_of, F.size(spans_of))["end"].cast("int") + 1, F.length("text"))
    return rows.withColumn("text", F.when(F.col(spans_of).isNull(), F.col("text")).otherwise(F.concat(F.array_join(piece, ""), tail))).select(*documents.columns)
