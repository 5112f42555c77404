"""The pipeline's stages against brute force on real rows, each on what the one before kept."""

from collections import defaultdict

import corpus_pipeline as P
from loomlog.llm import quality
from loomlog.llm.tables import cut
from tests.llm.test_formats import base_spans, brute_targets
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def best_run(item, words, at, window=13):
    agree = [int(0 <= at + j < len(words) and words[at + j] == w) for j, w in enumerate(item)]
    n = min(window, len(item))
    return max(sum(agree[s : s + n]) for s in range(len(item) - n + 1)) * 100 >= 80 * n


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    ranker = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.scores(docs, ranker).collect()}

    docs = cut(P.reject_poor(spark, docs, SF))
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(kept) == {d for d in before if scores[d] >= 0.5}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(d) == 1 for d in kept) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(labels.get(d) == 0 for d in kept) <= 0.1 * sum(q == 0 for q in labels.values())

    docs, was = cut(P.drop_near_copies(spark, docs, SF)), kept
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(map(str, kept)) == {c for _, n, c in brute([(d, r.text) for d, r in was.items()]) if n} | {str(d) for d, r in was.items() if not (r.text or "").split()}

    docs, was = cut(P.drop_leaks(spark, docs, SF)), kept
    kept = {r.doc_id: r for r in docs.collect()}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    said = {d: (r.text or "").lower().split() for d, r in was.items()}
    found = {d for d, w in said.items() for item in items if {*item} & {*w} and any(best_run(item, w, at) for at in range(1 - len(item), len(w)))}
    exact = {d for d, w in said.items() for item in items if f" {' '.join(item)} " in f" {' '.join(w)} "}
    assert docs.columns == columns and exact <= set(was) - set(kept) <= found

    docs, was = cut(P.mask_personal_data(spark, docs, SF)), kept
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(kept) == set(was)
    for d, r in was.items():
        for span in reversed(base_spans(r.text or "")):
            kind, lo, hi = span.split(":")
            assert r.text[int(lo) : int(hi)] not in kept[d].text and f"[{kind}]" in kept[d].text
        assert kept[d].n_chars == len(kept[d].text)
        assert base_spans(r.text or "") or r.text == kept[d].text or "[" in kept[d].text

    out = P.mix_sources(spark, docs, SF).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == len((kept[r.doc_id].text or "").split()) and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    assert len(out) == len(kept)
    assert all(abs(taken[s] - want[s]) <= max(50, 0.02 * want[s]) for s in want)


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and out.count() > 0
