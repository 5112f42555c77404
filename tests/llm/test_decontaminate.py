"""Leaks with every placement of the words that may differ."""

import random
from itertools import combinations

import pytest

from loomlog.llm import decontaminate
from tests.llm.test_pipeline import SF, best_run

LENGTHS = range(1, decontaminate.WINDOW + 1)


def placements(n):
    """All sets of differing places, as many as the criterion allows in a run of n words."""
    most = n - -(-n * 80 // 100)
    return list(combinations(range(n), most))


@pytest.mark.parametrize("n", LENGTHS)
def test_masks_fit_every_placement(n):
    masks = decontaminate.SEED_MASKS[max(lo for lo in decontaminate.SEED_MASKS if lo <= n)]
    assert all(m[0] == m[-1] == "1" for m in masks)
    for gone in placements(n):
        assert any(all(bit == "0" or at + i not in gone for i, bit in enumerate(m)) for m in masks for at in range(n - len(m) + 1)), (n, gone)


def test_every_placement_is_found(spark):
    items, docs, want = [], [], set()
    for i, n in enumerate([10, 11, 12, 13, 20]):
        item = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(item)))
        run, before, behind = (item, 3, 3) if n < 20 else (item[4:17], 0, 0)
        for gone in placements(len(run)):
            words = [f"x{j}" if j in gone else w for j, w in enumerate(run)]
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(["pre"] * before + words + ["post"] * behind)))
        for lo in range(3) if n < 20 else ():  # cut off by the document's edges
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(item[lo : n - 2 + lo])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench).collect()} == want


def test_short_items_null_ids_and_clashing_columns(spark):
    items = [(0, "only"), (1, "two words"), (2, "Now three words"), (None, "four words of it"), (4, "  "), (5, None), (0, "only")]
    docs = [(0, "x only y"), (1, "two  Words"), (2, "now three x words"), (3, "so four words of it"), (None, "a two words b"), (5, ""), (6, None), (7, "four words of"), (7, "four words of")]
    df = spark.createDataFrame([(*d, i, i) for i, d in enumerate(docs)], "doc_id long, text string, key int, _k int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (3, None), (None, 1)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench, least_words=3).collect()} == {(3, None)}
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(x.key for x in left.collect()) == [2, 5, 6, 7, 8]
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("n", range(11, 17))
def test_recall_at_random_substitutions(spark, n):
    """Items with two words replaced anywhere, inside longer texts: all that the criterion counts are found."""
    r = random.Random(n)
    items = [(i, [f"i{i}w{j}" for j in range(n)]) for i in range(40)]
    docs, want = [], set()
    for i, item in items:
        gone = r.sample(range(n), 2)
        words = [f"x{j}" if j in gone else w for j, w in enumerate(item)]
        docs.append((i, " ".join(["a"] * r.randint(0, 9) + words + ["b"] * r.randint(0, 9))))
        run = min(n, decontaminate.WINDOW)
        if max(sum(j not in gone for j in range(s, s + run)) for s in range(n - run + 1)) * 100 >= 80 * run:
            want.add((i, i))
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want


def test_removed_are_all_that_brute_force_finds(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text.lower().split() for r in bench.collect()]
    said = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    found = {d for d, w in said.items() for item in items if {*item} & {*w} and any(best_run(item, w, at) for at in range(1 - len(item), len(w)))}
    assert set(said) - {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == found
