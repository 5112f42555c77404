"""One text file per key: the sink of exports and of logs that are kept a file for each session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tail import _open

_DONE = pa.schema([("file", pa.string()), ("lines", pa.int64()), ("size", pa.int64())])


def write_files(rows: DataFrame, folder: str, end: str = "\n", partitions: int | None = None) -> DataFrame:
    """Write (file, at, value) as folder/file, values in order of ``at``, each followed by ``end``. Returns (file, lines, size), and writes
    when that is computed.

    A task streams the values of a file, so a file may be larger than memory. Files are written beside their place and
    moved there at their end: a task that is run again replaces its own work. Null values are empty; a null file name is
    an error; names may hold folders, but no ``..``.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("file", "at", F.coalesce("value", F.lit("")).alias("value")).repartition(n, "file").sortWithinPartitions("file", "at")

    def run(batches):
        fs, root = _open(folder)
        name, out, done, made = None, None, [], [0, 0]

        def close():
            if out is not None:
                out.close()
                fs.move(f"{root}/{name}.{n}.new", f"{root}/{name}")
                done.append((name, *made))

        for batch in batches:
            for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if file != name:
                    close()
                    if not file or ".." in file.split("/"):
                        raise ValueError(f"no name for a file: {file!r}")
                    name, made = file, [0, 0]
                    fs.create_dir(f"{root}/{file}".rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.{n}.new")
                raw = f"{value}{end}".encode()
                out.write(raw)
                made = [made[0] + 1, made[1] + len(raw)]
            if len(done) > 1_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DONE, strict=True)], schema=_DONE)
                done.clear()
        close()
        if done:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DONE, strict=True)], schema=_DONE)

    return dealt.mapInArrow(run, "file string, lines long, size long")
