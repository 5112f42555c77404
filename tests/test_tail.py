"""Growing files: every line once, in order, whatever the ranges; the files are real ones."""

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog.sources import tail
from loomlog.sources.files import write_files


def whole(raw, final=False):
    out, at = [], 0
    for line in raw.split(b"\n")[:-1]:
        out.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    if final and at < len(raw):
        out.append((at, raw[at:].removesuffix(b"\r")))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_ranges(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(tail, "BLOCK", 7)
    raw = b"".join(bytes(r.choices(b"ab\r\xc3\xa9", k=r.choice([0, 1, 5, 40]))) + b"\n" for _ in range(200)) + b"unfinished"
    for final in (False, True):
        cuts = sorted({0, len(raw), *(r.randrange(len(raw)) for _ in range(60))})
        got = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            with pa.PythonFile(io.BytesIO(raw), mode="r") as f:
                got += [(s, v) for s, _, v in tail.lines_between(f, lo, hi, final=final and hi == len(raw))]
        assert got == whole(raw, final)


def test_long_lines_are_told_but_not_held():
    raw = b"a\n" + b"x" * 5_000_000 + b"\nb\n"
    with pa.PythonFile(io.BytesIO(raw), mode="r") as f:
        got = [(s, n, v) for lo in range(0, len(raw), 1_000_000) for s, n, v in tail.lines_between(f, lo, min(lo + 1_000_000, len(raw)), max_line=100)]
    assert got == [(0, 1, b"a"), (2, 5_000_000, None), (5_000_003, 1, b"b")]


def test_batch_reads_only_what_was_added(spark, tmp_path):
    for name in ("a", "deep/b", "c"):
        p = tmp_path / f"{name}.jsonl"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes("".join(f"{name} {i} é\n" for i in range(50)).encode() + b"half")
    (tmp_path / "not.txt").write_text("no\n")
    first, offsets = tail.added(spark, str(tmp_path), split=64)
    assert first.count() == 150 and offsets.count() == 3
    offsets = spark.createDataFrame(offsets.collect(), offsets.schema)
    with (tmp_path / "a.jsonl").open("ab") as f:
        f.write(b" done\r\nnext\n\nopen")
    (tmp_path / "c.jsonl").write_bytes(b"new\n")
    more, now = tail.added(spark, str(tmp_path), offsets, split=16)
    assert sorted((x.file.rsplit("/", 1)[1], x.value) for x in more.collect()) == [("a.jsonl", ""), ("a.jsonl", "half done"), ("a.jsonl", "next"), ("c.jsonl", "new")]
    again, _ = tail.added(spark, str(tmp_path), spark.createDataFrame(now.collect(), now.schema))
    assert again.count() == 0
    rest, _ = tail.added(spark, str(tmp_path), final=True)
    assert rest.where("value = 'open'").count() == 1
    assert tail.added(spark, str(tmp_path / "deep"), glob="*.none")[0].count() == 0


def test_source_in_batch_and_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    write = lambda name, mode, lines: (src / name).open(mode).write("".join(lines))
    write("a.jsonl", "w", [json.dumps({"i": i}) + "\n" for i in range(30)] + ['{"i": '])
    stream = tail.follow(spark, str(src), str(tmp_path / "log"), split=40)

    def run():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((x.file.rsplit("/", 1)[1], x.start, x.value) for x in spark.read.parquet(out).collect())

    assert len(run()) == 30
    write("a.jsonl", "a", ["30}\n"])
    write("b.jsonl", "w", ["{}\n"])
    got = run()
    assert len(got) == 32 and ("a.jsonl", sum(len(json.dumps({"i": i})) + 1 for i in range(30)), '{"i": 30}') in got
    assert run() == got
    assert spark.read.format("tail").option("path", str(src)).load().count() == 32


def test_files_are_written_in_order(spark, tmp_path):
    df = spark.range(3_000).select(F.concat(F.lit("d/"), F.col("id") % 3, F.lit(".txt")).alias("file"), (-F.col("id")).alias("at"), F.when(F.col("id") > 2, F.col("id").cast("string")).alias("value"))
    done = write_files(df, str(tmp_path)).collect()
    assert {(x.file, x.lines) for x in done} == {(f"d/{i}.txt", 1_000) for i in range(3)}
    for i in range(3):
        assert (tmp_path / f"d/{i}.txt").read_text() == "".join(f"{j}\n" if j > 2 else "\n" for j in range(2_997 + i, -1, -3))
