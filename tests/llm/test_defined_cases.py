"""Every stage of the pipeline and its operators on nulls, empty and very long texts, ties, repeated rows, empty tables and
columns named like those that operators might make for themselves."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomlog.llm import chat_format, fingerprint, jaccard_join, link_trust, pii, quality, source_mix, substring_dedup, suffix_array_dedup

SF = "/root/testdata/sf0.001"
CLASHES = ("score", "key", "_k", "_s", "_at", "_one", "one", "place", "own", "spans", "k", "c", "n", "root", "h", "b", "size", "taken", "row", "kind", "words", "item_id", "whole_text", "_text", "z", "ps", "hs", "start", "end")


def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    twin = good(80)
    out = [(i, good(60), "en", f"s{i % 3}") for i in range(30)]
    out += [(100, None, None, None), (101, "", "en", ""), (102, " \t\n ", "en", "a"), (103, "x", None, "a"), (None, good(50), "en", None), (None, None, None, None)]
    out += [(200, twin, "en", "a"), (201, twin + " end", "en", "b"), (200, twin, "en", "a"), (200, twin, "en", "a"), (202, "mail a@b.c or +1 (017) 555-7713 " + good(40), "en", "a")]
    out += [(300, "word " * 60_000, "en", "big"), (301, "w" * 300_000, "en", "big"), (302, " ".join(f"v{i}" for i in range(40_000)), "en", "big"), (303, "line\n" * 30_000, "en", "big")]
    return [(*x, len(x[1] or "")) for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage(spark, docs, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != "mix":
        assert out.columns == docs.columns
        assert all(x[c] == i for x in got[:3] for i, c in enumerate(CLASHES))
        assert {x.doc_id for x in got} <= {x[0] for x in rows()}
    if name == "near_copies":
        kept = [x.doc_id for x in got]
        assert sorted(x for x in kept if x in (200, 201)) == [200] and {100, 101, 102, 103, 300, 301, 302, 303} <= set(kept)
    if name == "leaks":
        assert len(got) == len(rows())
    if name == "personal_data":
        assert len(got) == len(rows()) and next(x for x in got if x.doc_id == 202).text.startswith("mail [email] or [phone] ")
        assert {x.doc_id: x.text for x in got}[100] is None
    if name == "mix":
        assert len(got) == len(rows()) and all(0 <= x.taken <= 2 * x.size for x in got)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_operators(spark, docs):
    n = len(rows())
    assert pii.report(docs).count() == fingerprint.compare(docs).count() == source_mix.mix(docs).count() == n
    assert substring_dedup.remove_repeats(docs).count() == suffix_array_dedup.remove_repeats(docs).count() == n
    assert jaccard_join.near_duplicates(docs).count() == quality.scores(docs, quality.Ranker()).count() == n
    told = {x.doc_id: x for x in suffix_array_dedup.remove_repeats(docs).collect()}
    assert told[300].n_removed == told[300].n_bytes == 300_000 and told[301].n_removed == 300_000 and told[302].n_removed == 0


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, "http://a.net/x", "<a href='http://b.org'>", 2), (1, "http://a.net/x", "<a href='http://b.org'>", 2), (None, "", "", 3)], "page_id long, url string, html string, trust int")
    assert sorted(str(x.verdict) for x in link_trust.judge(pages).collect()) == ["allow", "allow", "block", "block"]
    talk = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "assistant", "x" * 100_000, 2), (1, 0, "assistant", "x" * 100_000, 2), (1, 0, "user", "", 3)], "conv_id long, turn long, role string, text string, message int")
    got = {x.conv_id: x for x in chat_format.digests(chat_format.events_of(talk)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 200_000 and got[None].n_turns == 1
    assert chat_format.digests(chat_format.events_of(talk.limit(0))).count() == 0


def test_components_of_a_long_chain(spark):
    r = random.Random(1)
    names = r.sample(range(10**9), 5001)
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    got = jaccard_join.components(links).collect()
    assert len(got) == 5001 and {x.root for x in got} == {min(names)}
