"""Lines of growing files, read by byte ranges: what a file has gained since an offset, and nothing before it.

A line belongs to the range in which its newline lies. So ranges can be cut anywhere, a file's growth is just another
range, a line that is still being written waits for its newline, and no line is read twice or lost. A reader goes back
from the start of its range to the start of its first line; it holds one line and one block in memory. Lines longer than
``max_line`` bytes are not held: they come with their length and a null value.

``added`` plans ranges from a table of offsets and reads them as a batch. ``TailSource`` is the same as a data source:
``spark.read.format("tail")`` reads all, ``spark.readStream.format("tail")`` follows the files.

Defined cases: a file shorter than its offset was replaced, and is read from its start; a carriage return before the
newline is dropped; bytes that aren't UTF-8 become the replacement character; a last line without newline is left for
later, or read with ``final``; files that vanish give no lines; an empty folder gives no rows.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_LINE = 16 << 20
SPLIT = 64 << 20
BLOCK = 1 << 20
BATCH_BYTES = 8 << 20
LINES = "file string, start long, size long, value string"
_LINES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("value", pa.string())])
RANGES = "file string, lo long, hi long, upto long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def _line_start(file, lo: int, most: int) -> tuple[int, list[bytes]]:
    """Where the line begins that goes on at lo, and its bytes up to lo (none if there are more than ``most``)."""
    start, head = lo, []
    while start > 0:
        at = max(0, start - (1 << 16))
        block = file.read_at(start - at, at)
        cut = block.rfind(b"\n")
        head.append(block[cut + 1 :])
        start = at + cut + 1
        if lo - start > most:
            head.clear()
        if cut >= 0:
            break
    return start, head[::-1]


def lines_between(file, lo: int, hi: int, max_line: int = MAX_LINE, final: bool = False) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, length, bytes or None) of each line whose newline lies in [lo, hi) of an open file; with final, hi ends the last one too.

    Only a range that holds the newline of a line begun before goes back for the line's start.
    """
    most = max_line + 1  # a carriage return may come off
    held, size, at, start = [], 0, lo, None

    def line():
        nonlocal held, size, start
        if start is None:
            start, head = _line_start(file, lo, most)
            held, size = (head + held if head or start == lo else []), size + lo - start
        return start, size, b"".join(held).removesuffix(b"\r") if size <= most else None

    while at < hi:
        block = file.read_at(min(BLOCK, hi - at), at)
        if not block:
            return
        begin = 0
        while begin < len(block):
            end = block.find(b"\n", begin)
            piece = block[begin : end if end >= 0 else len(block)]
            size += len(piece)
            held.append(piece)
            if size > most:
                held.clear()
            if end < 0:
                break
            yield line()
            held, size, begin, start = [], 0, end + 1, at + end + 1
        at += len(block)
    if final and (size or start is None):
        told = line()
        if told[1]:
            yield told


def read_ranges(ranges: DataFrame, max_line: int = MAX_LINE, final: bool = False) -> DataFrame:
    """LINES of each (file, lo, hi, upto); upto is where the known part of the file ends."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _batches(r["file"], r["lo"], r["hi"], max_line, final and r["hi"] == r["upto"])

    return ranges.select("file", "lo", "hi", "upto").mapInArrow(run, LINES)


def _batches(uri: str, lo: int, hi: int, max_line: int, final: bool) -> Iterator[pa.RecordBatch]:
    fs, path = _open(uri)
    try:
        file = fs.open_input_file(path)
    except FileNotFoundError:
        return
    held, weight = [], 0
    with file:
        for start, size, line in lines_between(file, lo, hi, max_line, final):
            if line is not None and len(line) > max_line:
                line = None
            held.append((uri, start, size, None if line is None else line.decode("utf-8", "replace")))
            weight += 64 + len(line or b"")
            if weight >= BATCH_BYTES:
                yield _batch(held)
                held, weight = [], 0
    if held:
        yield _batch(held)


def _batch(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


def sizes(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, upto) of every file below path; Spark lists them, and reads none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("upto"))


def ranges_since(found: DataFrame, offsets: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """RANGES of what files (file, upto) have beyond their offsets (file, upto)."""
    known = found.withColumn("seen", F.lit(0).cast("long")) if offsets is None else found.join(offsets.select("file", F.col("upto").alias("seen")), "file", "left")
    seen = F.when(F.col("seen") <= F.col("upto"), F.col("seen")).otherwise(0)
    known = known.withColumn("seen", F.coalesce(seen, F.lit(0))).where("seen < upto")
    cut = known.select("file", "upto", F.explode(F.sequence("seen", F.col("upto") - 1, F.lit(split).cast("long"))).alias("lo"))
    return cut.select("file", "lo", F.least(F.col("lo") + split, "upto").alias("hi"), "upto")


def added(spark: SparkSession, path: str, offsets: DataFrame | None = None, glob: str = "*.jsonl", split: int = SPLIT, max_line: int = MAX_LINE, final: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, offsets to pass next time): LINES that files gained since the offsets (file, upto). Both are of the sizes listed now,
    so write the lines before the offsets."""
    found = sizes(spark, path, glob)
    ranges = ranges_since(found, offsets, split)
    lines = read_ranges(ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "lo"), max_line, final)
    if offsets is None:
        return lines, found
    gone = offsets.select("file", "upto").join(found, "file", "left_anti")
    return lines, found.unionByName(gone)


class _Range(InputPartition):
    def __init__(self, file: str, lo: int, hi: int, last: bool):
        self.file, self.lo, self.hi, self.last = file, lo, hi, last


def _listed(path: str, glob: str) -> dict[str, int]:
    fs, at = _open(path)
    scheme = path[: path.index(at)] if at in path else ""
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return {scheme + f.path: f.size for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob)}


class _Options:
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.split, self.max_line = int(options.get("split", SPLIT)), int(options.get("maxline", MAX_LINE))

    def cut(self, file: str, lo: int, hi: int) -> list[_Range]:
        return [_Range(file, a, min(a + self.split, hi), a + self.split >= hi) for a in range(lo, hi, self.split)]


class TailReader(DataSourceReader):
    """All lines of the files as they are now."""

    def __init__(self, options: dict):
        self.options, self.final = _Options(options), options.get("final", "false").lower() == "true"

    def partitions(self):
        return [r for f, size in sorted(_listed(self.options.path, self.options.glob).items()) for r in self.options.cut(f, 0, size)] or [_Range("", 0, 0, False)]

    def read(self, partition):
        if partition.file:
            yield from _batches(partition.file, partition.lo, partition.hi, self.options.max_line, self.final and partition.last)


class TailStream(DataSourceStreamReader):
    """Follows the files. An offset is a number; what each number added (file, from, to) is kept in the folder ``log``, so offsets
    stay small however many files there are. A number is written before it is handed out, and never changed."""

    def __init__(self, options: dict):
        self.options = _Options(options)
        self.fs, self.log = _open(options["log"])
        self.fs.create_dir(self.log, recursive=True)
        self.known: dict[str, int] = {}
        self.number = 0
        while (steps := self._steps(self.number + 1)) is not None:
            self.known.update({f: to for f, _, to in steps})
            self.number += 1

    def _name(self, number: int) -> str:
        return f"{self.log}/{number:012d}.json"

    def _steps(self, number: int) -> list | None:
        if self.fs.get_file_info(self._name(number)).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_file(self._name(number)) as f:
            return json.loads(f.read())

    def initialOffset(self):  # noqa: N802
        return {"number": 0}

    def latestOffset(self):  # noqa: N802
        steps = []
        for f, size in sorted(_listed(self.options.path, self.options.glob).items()):
            seen = self.known.get(f, 0)
            if size != seen:
                steps.append((f, seen if size > seen else 0, size))
        if steps:
            with self.fs.open_output_stream(self._name(self.number + 1) + ".new") as f:
                f.write(json.dumps(steps).encode())
            self.fs.move(self._name(self.number + 1) + ".new", self._name(self.number + 1))
            self.number += 1
            self.known.update({f: to for f, _, to in steps})
        return {"number": self.number}

    def partitions(self, start, end):
        out = []
        for number in range(start["number"] + 1, end["number"] + 1):
            for f, lo, hi in self._steps(number) or ():
                out += self.options.cut(f, lo, hi)
        return out or [_Range("", 0, 0, False)]

    def read(self, partition):
        if partition.file:
            yield from _batches(partition.file, partition.lo, partition.hi, self.options.max_line, False)

    def commit(self, end):
        pass


class TailSource(DataSource):
    """Options: path, glob (``*.jsonl``), split and maxline in bytes, final (batch), log (stream: a folder that lives with the checkpoint)."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return LINES

    def reader(self, schema):
        return TailReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return TailStream(self.options)


def follow(spark: SparkSession, path: str, log: str, glob: str = "*.jsonl", split: int = SPLIT, max_line: int = MAX_LINE) -> DataFrame:
    """A stream of LINES of the files below path."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(path=path, log=log, glob=glob, split=str(split), maxline=str(max_line)).load()
