import random
import re

from trackloom.llm import licenses as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(text):
    """Licenses with a template whose shingles occur to 0.75 or more within a stretch little longer than itself."""
    g, out = grams(text), {}
    for name, t in S.TEMPLATES:
        own = set(grams(t))
        for k in range(max(1, len(g))):
            share = len(own & set(g[k : k + len(own)])) / len(own)
            if share >= 0.75:
                out[name] = max(out.get(name, 0), share)
    return out


def test_scan_equals_brute_force(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join("w%d" % rnd.randrange(500) for _ in range(n))
    docs = []
    for i in range(80):
        name, t = rnd.choice(S.TEMPLATES)
        w = t.upper().split() if i % 3 == 0 else t.split()
        if i % 4 == 1 and len(w) > 25:
            w[rnd.randrange(len(w))] = "changed"
        docs.append((i, say(rnd.randrange(60)) + " " + " ".join(w if i % 7 else w[: len(w) // 3]) + " " + say(rnd.randrange(60))))
    docs += [(100, None), (101, ""), (102, "Licensed under the"), (103, say(9000) + " Licensed under CC BY-NC 4.0. " + say(50)), (104, "Released under the MIT License. " * 40), (0, docs[0][1])]
    got = {}
    rows = S.digest(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as license", "1 as share")).collect()
    for r in rows:
        got.setdefault(r.doc_id, {})[r.license] = r.share
    want = {d: b for d, t in docs if (b := brute(t))}
    assert {d: set(x) for d, x in got.items()} == {d: set(x) for d, x in want.items()}
    assert all(got[d][k] >= round(x, 6) for d, b in want.items() for k, x in b.items())
    assert sum(r.doc_id == 0 for r in rows) == 2 * len(want.get(0, {}))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert S.digest(docs.limit(0)).count() == 0
    assert S.scan(docs, S.templates(spark).limit(0)).count() == 0
    assert [r.license for r in S.digest(docs).collect()] == ["MIT"]


def test_short_templates(spark):
    docs = spark.createDataFrame([(1, "Words. All rights\nreserved."), (2, "ALL RIGHTS RESERVED"), (3, "all rights are reserved"), (4, "rights reserved"), (5, None), (6, "all rights reserved; all rights reserved")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.share, r.first_word, r.n_windows) for r in S.digest(docs).collect())
    name = "LicenseRef-All-Rights-Reserved"
    assert got == [(1, name, 1.0, 1, 1), (2, name, 1.0, 0, 1), (6, name, 1.0, 0, 2)]
    table = spark.createDataFrame([("one", "Rights"), ("two", "all rights"), ("four", "rights are reserved now"), ("none", "!")], "license string, text string")
    assert sorted((r.doc_id, r.license) for r in S.scan(docs, table).collect()) == [(1, "one"), (1, "two"), (2, "one"), (2, "two"), (3, "one"), (3, "two"), (4, "one"), (6, "one"), (6, "two")]


def test_rest_and_whole_texts(spark):
    docs = [(i, "w1 w2 " + t + " w3") for i, (_, t) in enumerate(S.REST)]
    docs += [(10 + i, f.read_text()) for i, f in enumerate(sorted(S.TEXTS.glob("*.txt")))]
    got = {}
    for r in S.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.share
    assert {d: {k for k, x in of.items() if x == 1} for d, of in got.items()} == {0: {"MIT"}, 1: {"BSD-3-Clause"}, 10: {"Apache-2.0"}, 11: {"GPL-3.0"}, 12: {"MPL-2.0"}}


def test_share_is_an_average_over_pieces(spark):
    w = ["t%d" % i for i in range(132)]  # two pieces of 64 shingles
    table = spark.createDataFrame([("two", " ".join(w))], "license string, text string")
    near = lambda n: " ".join(w[:64] + w[64 : 68 + n])
    docs = spark.createDataFrame([(0, " ".join(w)), (1, near(40)), (2, near(20))], "doc_id long, text string")
    assert {r.doc_id: r.share for r in S.scan(docs, table).collect()} == {0: 1.0, 1: round((1 + 40 / 64) / 2, 6)}


def test_very_many_notices_in_one_text(spark):
    """100,000 words of notices, and one notice across the edge of two chunks."""
    mit = S.TEMPLATES[1][1]
    docs = [(1, "Released under the MIT License. " * 4000), (2, (mit + " ") * 2000), (3, "w " * (S.CHUNK - 20) + mit + " x" * 3000)]
    got = {r.doc_id: (r.license, r.share, r.first_word) for r in S.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("MIT", 1.0, 0) and got[3][:2] == ("MIT", 1.0) and set(got) == {1, 2, 3}


def test_very_many_templates_with_one_opening(spark, monkeypatch):
    """1,500 templates that differ in their last word, over texts of many such notices; the same by broadcast, by shuffle, and in many blocks."""
    opening = " ".join(f"o{i}" for i in range(30))
    table = spark.createDataFrame([(f"L{k}", f"{opening} own{k}") for k in range(1500)], "license string, text string")
    docs = spark.createDataFrame([(1, f"{opening} own7 " * 200), (2, f"before {opening} own1499 after"), (3, "nothing here at all to find")], "doc_id long, text string")
    want = {k: 1.0 if k == 7 else round(26 / 27, 6) for k in range(1500)}
    rows = S.scan(docs, table).collect()
    assert {int(r.license[1:]): r.share for r in rows if r.doc_id == 1} == want
    assert sum(r.doc_id == 2 for r in rows) == 1500 and not any(r.doc_id == 3 for r in rows)
    few = table.where("license in ('L1', 'L7', 'L8')")
    for name, value in (("FEW", 5), ("BLOCK", 12)):
        monkeypatch.setattr(S, name, value)
        assert sorted(map(tuple, S.scan(docs, few).collect())) == sorted(tuple(r) for r in rows if r.license in ("L1", "L7", "L8"))


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string").selectExpr("*", "1 as begin", "2 as row", "3 as piece", "4 as key", "5 as seed")
    assert [(r.doc_id, r.license) for r in S.digest(docs).collect()] == [(1, "MIT")]
