"""Running positions and sums against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomlog.operators.ranks import running


def test_groups_of_any_size(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, "hot", "hot", "hot", "a", "b"]), r.choice([None, 1, 2, 30]), r.randrange(40)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "id long, g string, v long, _at int").repartition(7)
    got = {x.id: x for x in running(df, [F.col("_at").desc(), "id"], ["g"], "n", {"total": "v"}).collect()}
    seen, sums = defaultdict(int), defaultdict(int)
    for i, g, v, at in sorted(rows, key=lambda x: (-x[3], x[0])):
        sums[g] += v or 0
        assert (got[i].n, got[i].total, got[i].v) == (seen[g], sums[g], v)
        seen[g] += 1
    assert got[0].asDict().keys() == {"id", "g", "v", "_at", "n", "total"}


def test_whole_table_and_scan_order(spark):
    df = spark.range(10_000).withColumn("x", F.col("id") % 7)
    assert all(x.rank == x.id and x.upto == sum(i % 7 for i in range(x.id + 1)) for x in running(df, ["id"], sums={"upto": "x"}).where("id % 997 = 3").collect())
    slots = running(df, by=["x"], rank="slot").groupBy("x").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("top"), F.count("*").alias("all")).collect()
    assert len(slots) == 7 and all(s.n == s.all == s.top + 1 for s in slots)
    assert running(df.limit(0), ["id"]).count() == 0
