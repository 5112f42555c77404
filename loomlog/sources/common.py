"""Reading hostile JSON lines: what can't be read is skipped, never raised."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound, json_path

MAX_LINE = 16 * 1024 * 1024
MAX_FILE = 1024 * 1024 * 1024


def from_lines(lines: DataFrame, max_line: int | None = MAX_LINE, max_file: int | None = MAX_FILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, at, value) -> (file, line_no, v) and the columns in ``keep``: objects only, in file order.

    Lines of more than ``max_line`` characters, and what follows the first ``max_file`` characters of a file, are left out; None: nothing is.
    """
    w = Window.partitionBy("file").orderBy("at")
    text = F.make_valid_utf8("value")
    rows = lines.withColumn("size", F.length("value").cast("long")).where("size is not null")
    if max_line is not None:
        rows = rows.where(F.col("size") <= max_line)
    rows = rows.withColumn("line_no", F.row_number().over(w))
    if max_file is not None:
        rows = rows.withColumn("read", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("read") <= max_file)
    # what doesn't begin with a brace, or has none that closes it, is no object, and is not parsed; what else parses is one
    rows = rows.where(F.ltrim(text, F.lit(" \t\r\n\ufeff")).startswith("{") & F.contains("value", F.lit("}"))).withColumn("v", F.try_parse_json(text))
    return rows.where("v is not null").select("file", "line_no", "v", *keep)


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, at, value) of every line under path; at keeps the order within a file."""
    return _lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path))


_LISTINGS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_together(spark: SparkSession) -> Iterator[None]:
    """Files that a pattern names are looked up some at a time; Spark would start a task for each of the first 10,000."""
    before = spark.conf.get(_LISTINGS)
    spark.conf.set(_LISTINGS, str(min(int(before), max(32, 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(_LISTINGS, before)


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """The same of the files that a path pattern names."""
    with listed_together(spark):
        return _lines(spark.read.text(glob))


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")


def read_jsonl(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    return from_lines(read_lines(spark, path, glob))


def stem(file: Column) -> Column:
    name = F.substring_index(file, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.left(name, F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).otherwise(name)


def folder(file: Column, up: int = 1) -> Column:
    return F.try_element_at(F.split(file, "/"), F.lit(-1 - up))


def _only(v: Column, path: str, kind: str, cast: str) -> Column:
    return bound(json_path(v, path, "variant"), lambda x: F.when(F.schema_of_variant(x) == kind, F.try_variant_get(x, "$", cast)))


def integer(v: Column, path: str) -> Column:
    """A JSON integer; booleans and other types are null."""
    return _only(v, path, "BIGINT", "bigint")


def flag(v: Column, path: str) -> Column:
    return _only(v, path, "BOOLEAN", "boolean")


def string(v: Column, path: str) -> Column:
    """A JSON string; other types are null."""
    return json_path(v, path)


def as_text(v: Column, path: str) -> Column:
    """A string as it is, anything else as JSON."""
    value = json_path(v, path, "variant")
    return F.coalesce(string(v, path), F.to_json(value))


def fields(v: Column) -> Column:
    """A JSON object's values by name; null if it is none. Looking up a name that an object lacks costs Spark an exception, so
    objects of which many names are read, few there, are opened first."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def field(opened: Column, name: str) -> Column:
    return F.try_element_at(opened, F.lit(name))


def array(v: Column, path: str) -> Column:
    """A JSON array of variants, empty if it is none."""
    return F.coalesce(json_path(v, path, "array<variant>"), F.array().cast("array<variant>"))


def strings(items: Column) -> Column:
    return F.array_join(F.array_compact(items), "\n")


def millis(v: Column, path: str) -> Column:
    """Epoch milliseconds within years 1 to 9999, else null."""
    ms = integer(v, path)
    return F.when(ms.between(-62135596800000, 253402300799999), F.timestamp_millis(ms))


def first_in_order(value: Column, order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), order))


def distinct_in_order(value: Column, order: str) -> Column:
    """Distinct non-null values by first appearance."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("x")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["x"]))


def model_name(v: Column, path: str) -> Column:
    return bound(F.trim(string(v, path)), lambda m: F.when((m != "") & (m != "<synthetic>"), m))


def tokens(**parts: Column) -> Column:
    """The token struct; the total is null where it would be 0."""
    names = ("input", "output", "reasoning", "cache_read", "cache_write")
    none = F.lit(None).cast("bigint")

    def made(p):
        total = p["total"] if "total" in parts else sum((F.coalesce(p[n], F.lit(0)) for n in names if n in parts), F.lit(0))
        return F.when(total != 0, F.struct(*[(p[n] if n in parts else none).cast("bigint").alias(n) for n in names], total.cast("bigint").alias("total")))

    return bound(F.struct(*[x.alias(n) for n, x in parts.items()]), made)


def asked(q: Column, answer: Column) -> Column:
    """A question of an interactive call with its option labels (objects or plain strings) and the answer."""
    options = F.transform(array(q, "$.options"), lambda o: F.nullif(F.coalesce(string(o, "$.label"), string(o, "$")), F.lit("")))
    return F.struct(F.trim(string(q, "$.question")).alias("question"), F.array_compact(options).alias("options"), answer.alias("answer"))


def chosen(v: Column, path: str) -> Column:
    """The answers at a path, a list or one value, joined; null if there are none."""
    items = F.filter(F.transform(array(v, path), lambda a: F.coalesce(string(a, "$"), F.to_json(a))), lambda x: x.isNotNull())
    return F.coalesce(F.when(F.size(items) > 0, F.array_join(items, " | ")), string(v, path))
