"""Chat formatting, link trust, decontamination, PII, fingerprints, quality and mixing on small fixtures."""

import functools
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.llm import chat_format, decontaminate, fingerprint, link_trust, pii, quality, queries, source_mix

NASTY = ["", None, "plain", queries.TRICKY, "### user: hi </turn>\n", "\\", "\\\\", "a\\</turn>", " </turn>\n### assistant: x", "#", "日本 \n", "x" * 5000 + "\\"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys: tem", None][(c + t) % 4], NASTY[(c * 5 + t) % len(NASTY)]) for c in range(6) for t in range(9)]
    rows += [(None, 0, "assistant", "no id"), (2, None, "user", "no turn"), (2, 3, "assistant", "again"), (2, 3, "assistant", "again")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, seq int")
    events = chat_format.events_of(df)
    got = {x.conv_id: x for x in chat_format.digests(events).collect()}
    rendered = defaultdict(list)
    for x in chat_format.render(events).collect():
        rendered[x.conv_id].append(x)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        text = "".join(x.rendered for x in rendered[conv])
        back = [(role, said) for role, said, _, _ in chat_format.read_back(text)]
        assert back == [(r[2] or "", r[3] or "") for r in mine]
        x = got[conv]
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (x.n_turns, x.loss_chars, x.formatted_chars) == (len(mine), len(loss), len(text))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(events.limit(0)).count() == 0


def test_chat_events(spark):
    log = [
        (1, 0, 0, "message", "user", "question"),
        (1, 1, 0, "delta", "assistant", "wro"),
        (1, 1, 1, "delta", "assistant", "ng"),
        (1, 1, 2, "regenerate", "assistant", ""),
        (1, 1, 3, "delta", "assistant", "ri"),
        (1, 1, 4, "delta", "assistant", "ght"),
        (1, 2, 0, "message", "user", "old"),
        (1, 2, 1, "edit", None, "new"),
        (1, 3, 0, "message", "user", "gone"),
        (1, 3, 1, "delete", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = sorted((x.turn, x.role, x.text) for x in chat_format.render(df).collect())
    assert got == [(0, "user", "question"), (1, "assistant", "right"), (2, "user", "new")]


def test_two_streams_of_a_turn(spark):
    log = [(1, 0, 7, 0, "message", "assistant", "a"), (1, 0, 9, 0, "message", "assistant", "x"), (1, 0, 7, 1, "delta", None, "b"), (1, 0, 9, 1, "delta", None, "y"), (1, 0, 7, 2, "delta", None, "c"), (1, 0, 9, 2, "edit", None, "z"), (1, 0, 9, 3, "delta", None, "!")]
    log += [(1, 1, 1, 0, "message", "assistant", "old"), (1, 1, 1, 1, "regenerate", None, ""), (1, 1, 1, 2, "delta", None, "new"), (1, 2, 1, 0, "message", "user", "gone"), (1, 2, 1, 1, "delete", None, None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    assert sorted((x.turn, x.text) for x in chat_format.render(df).collect()) == [(0, "abc"), (0, "z!"), (1, "new")]


def test_link_trust(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://A.Example.NET/en/1?x", link("friend.info", "second.info")),
        (2, "http://b.example.net/de/1#x", None),
        (3, "https://friend.info/", link("second.info")),
        (4, "https://spam.info/x", link("y.example.com")),
        (5, "http://y.example.com/de/5", ""),
        (6, "http://y.example.com/de/6", None),
        (7, None, None),
        (8, "no host", None),
        (9, "http://org/fr/", None),
        (10, "http://x.net", None),
        (11, "ftp://u/a://b/c", None),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in link_trust.judge(df, threshold=0.4).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("b.example.net", "/de/1", "net/", "block"),
        3: ("friend.info", "/", None, "allow"),
        4: ("spam.info", "/x", None, "block"),
        5: ("y.example.com", "/de/5", "example.com/de/", "block"),
        6: ("y.example.com", "/de/6", "example.com/de/", "block"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("org", "/fr/", "org/fr/", "allow"),
        10: ("x.net", "", None, "allow"),
        11: ("u", "/a://b/c", None, "allow"),
    }
    assert link_trust.judge(df.limit(0)).count() == 0


def test_decontaminate(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    items = [[word() for _ in range(n)] for n in (30, 40, 12, 8, 5, 3)]
    say = lambda n: [word() for _ in range(n)]
    docs = []
    for i, item in enumerate(items):
        docs.append((i, " ".join(say(50) + item + say(50))))
        swapped = list(item)
        for j in range(4, len(item), 8):
            swapped[j] = "other"
        docs.append((10 + i, " ".join(say(20) + [w.upper() for w in swapped] + say(3))))
    docs += [(20, " ".join(say(400))), (21, None), (22, ""), (23, " ".join(items[0][10:26])), (24, "  " + " ".join(items[1][:15])), (None, " ".join(items[0])), (30, " ".join(say(30) + items[0][:6] + say(30)))]
    docs += [docs[0]]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench, broadcast_seeds=limit).collect()}
        assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (10, 0), (11, 1), (12, 2), (13, 3), (23, 0), (24, 1), (14, 4), (5, 5), (15, 5), (None, 0)}
    left = {x.doc_id for x in decontaminate.drop_contaminated(df, bench).collect()}
    assert {20, 21, 22, 30} <= left and not left & {0, 1, 2, 3, 5, 10, 11, 12, 13, None}
    assert decontaminate.find(df.limit(0), bench).count() == 0
    assert decontaminate.find(df, bench.limit(0)).count() == 0


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    """The contract's base, by its own patterns."""
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    for i, (kind, p, ok) in enumerate(rules):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if ok(m[0])]
    return [x[2] for x in sorted(out)]


def test_pii(spark):
    r = random.Random(5)
    atoms = ["a@b.c", "x@a.b.@c.d", "_q@e-f.gh", "@", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "123456789012", "+1 (017) 555-7713", "+12", "+1234567890123456", "é", "日", ".", " ", "-", "\n", "ip ", "9", "5500005555555559", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "078-05-1120", "(415) 555-1234", "joe [at] mail [dot] com", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(r.choice(atoms) + r.choice(["", " ", " ", ", "]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "a" * 30000, "1" * 20000, "1." * 9000, "+" + "1 " * 9000, "a@" * 5000, "plain words only here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id 1.2.3.4"), (0, texts[0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, kind int")
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    by = {(x.doc_id): x for x in got}
    for d, t in rows:
        want = base_spans(t or "")
        x = by[d]
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, x.spans)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.BASE]
        assert set(want) <= set(x.spans.split(",")) | {""}
    assert by[len(texts) - 1].spans == ""
    assert any("secret:" in x.spans for x in got)
    masked = {x.doc_id: x.text for x in pii.redact(df).collect()}
    for d, t in rows:
        if t and not by[d].spans:
            assert masked[d] == t
    assert masked[None] == "null id [ip]"
    assert masked[300] is None and pii.redact(df).columns == df.columns
    assert pii.report(df.limit(0)).count() == 0


def test_pii_context_decides(spark):
    """One and the same hit after words of either kind; and the same document among others."""
    key, ssn, tel = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "219-09-9998", "(415) 555-1234"
    texts = [f"my private key {key} here", f"in commit {key} here", f"her ssn {ssn}.", f"see order {ssn}.", f"please call {tel} now", f"with part {tel} now", 'token = "changeme" and', f'token = "{key}"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = {x.doc_id: x.spans for x in pii.report(df).collect()}
    assert said[0] == "hex:15:55" and said[1] == ""
    assert said[2] == "ssn:8:19" and said[3] == ""
    assert said[4] == "local:12:26" and said[5] == ""
    assert said[6] == "" and said[7] == "secret:0:49,hex:9:49"
    assert {x.doc_id: x.spans for x in pii.report(df.where("doc_id % 3 = 0")).collect()} == {d: s for d, s in said.items() if d % 3 == 0}


def test_pii_learned_on_one_half_holds_on_the_other(spark):
    """Precision and recall of the selected spans, on planted spans that neither trees nor thresholds have seen."""
    trees, least = pii.learn(spark)
    found = pii.candidates(pii.examples(spark, 2 * pii.EXAMPLES).where(f"doc_id >= {32 * pii.EXAMPLES}")).where("kind = floor(doc_id / 2) % 16")
    rows = found.select("kind", (F.col("doc_id") % 2 == 1).alias("personal"), pii.selected(trees, least).alias("chosen")).groupBy("kind").agg(F.count_if("chosen").alias("n"), F.count_if(F.col("chosen") & F.col("personal")).alias("hit"), F.count_if("personal").alias("all")).collect()
    assert len(rows) == len(pii.KINDS) - len(pii.BASE)
    for r in rows:
        assert r.hit >= 0.85 * r.n > 0 and r.hit >= 0.6 * r.all, r


def test_pii_keeps_spans_beside_base_ones(spark, monkeypatch):
    key = "abcdef0123ab" + "x4111111111111111x".replace("x", "c") + "deadbeef12"
    texts = [f"say {key} end", f"secret: {key} end", "token=abc1+1 (017) 555-7713 and more", "a@b.c,1.2.3.4", f"{key} {key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "learn", lambda spark: ([], {k: -1.0 for k in range(len(pii.BASE), len(pii.KINDS))}))
    said = {x.doc_id: x.spans.split(",") for x in pii.report(df).collect()}
    assert said[0] == ["hex:4:44", "card:17:33"]
    assert said[1] == ["secret:0:48", "hex:8:48", "card:21:37"]
    masked = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert masked == {0: "say [hex][card][hex] end", 1: "[secret][card][secret] end", 2: "token=abc1[phone] and more", 3: "[email],[ip]", 4: "[hex][card][hex] [hex][card][hex]"}


def brute_lanes(text):
    """The lanes by the definition: sums modulo 2**32 over paragraphs and over pairs of neighbouring words."""
    import xxhash

    h = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42)
    out = [0] * fingerprint.LANES
    for p in text.split("\n"):
        for i in range(4):
            x = h(i.to_bytes(4, "little"), p.encode())
            out[2 * i] += x & 0xFFFFFFFF
            out[2 * i + 1] += x >> 32
        words = re.split(r"[\x20\x09-\x0D]+", p)
        for a, b in zip(words, [*words[1:], ""], strict=True):
            pair = h(a.encode(), b.encode())
            out[8] += 1
            for j in range(64):
                out[9 + j] += pair >> j & 1
    return [x % 2**32 for x in out]


def brute_likeness(s, t):
    a, b = brute_lanes(s), brute_lanes(t)
    x, y = (np.array([2 * v - lanes[8] for v in lanes[9:]], float) for lanes in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return 1.0 if a == b else max(0.0, min(1.0, x @ y / size)) if size else 0.0


def test_fingerprint_of_an_id_with_many_rows(spark):
    """An id, and null, with a third of all rows each: still every row's successor in order."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * (i % 5)) for i in range(900)]
    got = fingerprint.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert len(got) == len(rows) and sorted(x.n_chars for x in got) == sorted(len(t) for t in order)
    spots = fingerprint._dealt(spark.createDataFrame(rows, "doc_id long, text string"))[0].groupBy("z").agg(F.count_distinct("k").alias("n")).agg(F.max("n")).head()[0]
    assert spots <= 40


def test_fingerprint(spark):
    texts = ["one two three\nfour five six\nseven eight", "four five six\nseven eight\none two three", "", None, "日本 words\n\nmore words here and there " * 5, "x", "x", "alpha beta " * 50]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (6, "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, z int")
    got = fingerprint.compare(df).collect()
    assert len(got) == len(rows)
    fp = {x.doc_id: x for x in got}
    assert fp[0].fingerprint == fp[3].fingerprint and fp[15].fingerprint == fp[18].fingerprint
    assert fp[6].fingerprint == fp[9].fingerprint
    assert len({x.fingerprint for x in got}) == 6
    line = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    for i, (known, d, t) in enumerate(line):
        if (d, t) == (6, ""):
            continue
        n = len(t)
        edited = t[: n - n // 4] + line[(i + 1) % len(line)][2][: n // 4]
        x = fp[d if known else None]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1
    assert fp[0].near_next == 1.0 and fp[21].near_next < 0.5
    for i, (known, d, t) in enumerate(line):
        x, t2 = fp[d if known else None], line[(i + 1) % len(line)][2]
        if (d, t) == (6, ""):
            continue
        assert x.fingerprint == "".join(f"{v:08x}" for v in brute_lanes(t))
        assert abs(x.near_next - brute_likeness(t, t2)) < 1e-9
        assert abs(x.near_edited - brute_likeness(t, t[: len(t) - len(t) // 4] + t2[: len(t) // 4])) < 1e-9
    texts_of = [x.fingerprint for x in got[:2]]
    read = spark.createDataFrame([tuple(texts_of)], "a string, b string").select(fingerprint.likeness(fingerprint.lanes(F.col("a")), fingerprint.lanes(F.col("b"))).alias("n")).head().n
    back = {x.fingerprint: t for (known, d, t) in line for x in [fp[d if known else None]]}
    assert abs(read - brute_likeness(back[texts_of[0]], back[texts_of[1]])) < 1e-9
    plain = fingerprint.fingerprints(df.where("doc_id = 0")).head()
    cut = fingerprint.fingerprints(df.where("doc_id = 0").withColumn("text", F.lit("one two three\nseven eight"))).head()
    line = fingerprint.fingerprints(df.where("doc_id = 0").withColumn("text", F.lit("four five six"))).head()
    made = spark.createDataFrame([(cut.v, line.v)], "a array<long>, b array<long>").select(fingerprint.combine(F.col("a"), F.col("b")).alias("v"), fingerprint.combine(F.lit(plain.v), F.col("b"), -1).alias("w")).head()
    assert made.v == plain.v and made.w == cut.v
    lone = fingerprint.compare(df.where("doc_id = 0")).head()
    assert lone.near_next == 1.0
    assert fingerprint.compare(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {x.doc_id: x for x in queries.op7_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    held = [(x.quality, got[x.doc_id].predicted) for x in labels.collect() if got[x.doc_id].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2)], "doc_id long, text string, score int")
    assert [0 <= x.score <= 1 for x in quality.scores(odd, quality.Ranker()).collect()] == [True, True]
    none = quality.train(docs, labels.limit(0))
    assert quality.scores(docs.limit(3), none).count() == 3
    assert quality.scores(docs.limit(0), none).count() == 0
    good = quality.train(docs, labels.where("quality = 1"))
    assert all(x.score >= 0.5 for x in quality.scores(docs.limit(5), good).collect())


def brute_targets(sizes):
    """Share by weight, cap at twice the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "a", "b", "c", "d", "é", None, ""])) for i in range(400)]
    rows += [(500, None, "z"), (None, "one two", "b"), (3, *rows[3][1:])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, size int")
    got = source_mix.mix(df, slots=4096).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    total = sum(sizes.values())
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 * total
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    again = source_mix.mix(df.repartition(5), slots=4096).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert source_mix.mix(df.limit(0)).count() == 0


def test_mix_of_a_tiny_and_a_huge_source(spark):
    rows = [(i, " ".join(["w"] * 1000), "a") for i in range(400)] + [(1000 + i, "one two three", "b") for i in range(5)] + [(2000, "x " * 30_000, "c")]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=16, most=50_000).collect()
    taken, target = defaultdict(int), {}
    for x in got:
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken <= 2 * x.size
    assert target["b"] == 30 and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_ranks_against_numpy(spark):
    """A graph of 300 hosts with hubs, a long cycle and dead ends."""
    r = np.random.default_rng(1)
    n = 300
    links = {(int(a), int(b)): int(c) for a, b, c in zip(r.integers(0, 250, 900), np.minimum(r.integers(0, n, 900), r.integers(0, n, 900)), r.integers(1, 5, 900), strict=True) if a != b}
    links |= {(i, (i + 1) % 60): 40 for i in range(60)}
    seeds = np.zeros(n)
    seeds[[3, 70, 299]] = 1.0, 0.5, 0.25
    move = np.zeros((n, n))
    for (a, b), c in links.items():
        move[b, a] += c
    move /= np.maximum(move.sum(axis=0), 1)
    want = np.linalg.solve(np.eye(n) - 0.85 * move, seeds)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", c) for (a, b), c in links.items()], "src string, dst string, n long")
    given = spark.createDataFrame([(f"h{i}", float(x)) for i, x in enumerate(seeds) if x], "host string, weight double")
    got = {x.host: x.rank for x in link_trust.propagate(given, edges, tolerance=1e-4).collect()}
    assert max(abs(got.get(f"h{i}", 0.0) - want[i]) for i in range(n)) < 2e-3
    with pytest.raises(RuntimeError):
        link_trust.propagate(given, edges, rounds=3)


def test_quality_trains_on_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} !!!" * (1 + i % 4), i, i) for i in range(500)], "doc_id long, text string, score int, whole_text int")
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 0), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    ranker = quality.train(docs, labels, held_out=9)
    assert quality.train(docs.limit(0), labels).cut == 0.0
    left = quality.keep(docs, ranker)
    assert left.columns == docs.columns and {x.doc_id for x in left.select("doc_id").collect()} <= {0, 1}


def test_quality_learns_from_all_pairs_of_all_labels(spark):
    """Weights and cut are those of every pair of a good and a bad row, none sampled."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.training_rows(docs, labels)
    assert rows.count() == labels.where(quality.bucket(F.col("doc_id")) != 1).select("doc_id").distinct().count()
    got = quality.fit(rows)
    told = rows.toArrow()
    y, x = told.column("y").to_numpy(), np.array(told.column("x").combine_chunks().flatten()).reshape(-1, len(quality.NAMES))
    spread = x.std(axis=0)
    good, bad = (x / spread)[y == 1], (x / spread)[y == 0]
    w = np.zeros(x.shape[1])
    diff = (good[:, None] - bad[None]).reshape(-1, x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-diff @ w))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + quality.RIDGE * np.eye(len(w)), diff.T @ (1 - p) / len(diff) - quality.RIDGE * w)
        w += step * min(1, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    assert np.abs(got.weights * spread - w).max() < 0.02 * np.abs(w).max()
    s = np.sort(x @ got.weights)
    assert got.cut == pytest.approx((s[len(bad) - 1] + s[len(bad)]) / 2, abs=1e-9)


def test_mix_follows_its_schedule(spark, monkeypatch):
    """Which blocks are taken, and when, is the schedule's doing; every tenth of the mix holds the sources near their shares."""
    rows = [(i, " ".join("w" * (i % 7 + 3)), f"s{i % 3}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in source_mix.mix(df, slots=2_000).collect()}
    total, early, target = {}, {}, {}
    for r in got.values():
        total[r.source] = total.get(r.source, 0) + r.taken
        early[r.source] = early.get(r.source, 0) + r.taken_early
        target[r.source] = r.target
    block = source_mix.block_words(sum(target.values()), 2_000, source_mix.BLOCK_WORDS)[1]
    for s in target:
        assert abs(total[s] - target[s]) <= 1 and abs(early[s] - target[s] / 10) <= 3 * block
    assert all((r.first_slot is None) == (r.taken == 0) for r in got.values())

    real = source_mix.schedule
    monkeypatch.setattr(source_mix, "schedule", lambda shares, n: real(shares, n).where(F.col("slot") < n // 4))
    half = source_mix.mix(df, slots=2_000).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    assert all(r.taken <= 0.6 * total[r.source] for r in half)
    monkeypatch.setattr(source_mix, "schedule", lambda shares, n: real(shares, n).withColumn("slot", n - 1 - F.col("slot")).withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1))
    turned = {r.doc_id: r.first_slot for r in source_mix.mix(df, slots=2_000).collect()}
    assert turned != {d: r.first_slot for d, r in got.items()}


def test_pii_trees_against_plain_python(spark):
    """The selection as a column equals the trees walked one by one."""
    trees, least = pii.learn(spark)

    def walk(tree, kind, bits):
        while not isinstance(tree, float):
            f = tree[0]
            tree = tree[1] if (bits >> f & 1 if f < pii.N_FEATURES else kind == f - pii.N_FEATURES) else tree[2]
        return tree

    rows = pii.candidates(pii.examples(spark, 3_000)).where("kind is not null").withColumn("chosen", pii.selected(trees, least)).select("kind", "bits", "chosen").distinct().collect()
    assert {r.kind for r in rows} >= set(range(len(pii.BASE), len(pii.KINDS))) and len(rows) > 60
    for r in rows:
        score = sum(walk(t, r.kind, r.bits) for t in trees)
        want = bool(r.bits & 1) if r.kind < len(pii.BASE) else r.kind in least and score >= least[r.kind]
        assert r.chosen == want or abs(score - least.get(r.kind, score)) < 1e-9, (r, score)


def test_pii_recall_in_real_documents(spark):
    """Of keys after an assignment, checked account numbers, social security numbers and spelled addresses, planted between the words of
    real documents, whatever these are, nine in ten of each kind are found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 100").limit(150).collect()
    r = random.Random(21)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def iban():
        account = f"{r.randrange(10**17, 10**18)}"
        return f"DE{98 - int(account + '131400') % 97:02d}{account}"

    made = {"secret": lambda: f'api_key = "{hashlib.sha256(str(r.random()).encode()).hexdigest()[:40]}"', "ssn": lambda: f"{r.randint(101, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "iban": iban, "spelled": lambda: f"{r.choice(['jo', 'max.m', 'li_w'])} [at] {r.choice(['firm', 'uni-x'])} [dot] {r.choice(['com', 'org'])}"}
    rows, planted = [], []
    for i, d in enumerate(docs):
        kind = r.choice(list(made))
        words = d.text.split(" ")
        at = r.randrange(1, len(words))
        left, span = " ".join(words[:at]) + " ", made[kind]()
        rows.append((i, f"{left}{span} {' '.join(words[at:])}"))
        planted.append((i, kind, len(left), len(left) + len(span)))
    said = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in made:
        mine = [p for p in planted if p[1] == kind]
        hit = sum(any(k == kind and int(a) < hi and int(b) > lo for k, a, b in said[i]) for i, _, lo, hi in mine)
        assert hit >= 0.9 * len(mine) > 0, (kind, hit, len(mine))
