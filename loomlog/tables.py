"""Tables written half way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder named in spark.checkpoint.dir. Unset, as in tests, one is made and set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back; a lost executor loses none of it."""
    path = f"{shared_folder(df)}/loomlog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, never to be broadcast. Spark guesses its size from the columns that are left,
    not knowing how long exploded rows and their texts are, and would send all of it through the driver."""
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
