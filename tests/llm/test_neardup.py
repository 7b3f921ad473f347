import random
import re

import pytest

from trackloom.llm import neardup as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute(docs):
    sets = {d: shingle_set(t) for d, t in docs if d is not None}
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(shingle_set(t)), d if d is None else find(d), d is None or find(d) == d) for d, t in docs if d is not None)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randrange(4000)
    passage = [word() for _ in range(70)]
    out, n = [], 0

    def add(words):
        nonlocal n
        n += 1
        out.append((n * 7 % 1009, " ".join(words)))

    for _ in range(40):  # pairs and chains of copies with edits
        base = [word() for _ in range(rnd.choice([6, 20, 60, 150, 400]))]
        add(base)
        for _ in range(rnd.randrange(4)):
            for _ in range(max(1, len(base) // rnd.choice([30, 60, 100]))):
                base[rnd.randrange(len(base))] = word()
            add(base)
    for _ in range(60):  # one passage among own words
        add([word() for _ in range(rnd.randrange(40))] + passage + [word() for _ in range(rnd.randrange(10))])
    base = [word() for _ in range(120)]
    for _ in range(60):  # a large group, not all alike
        own = list(base)
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(120)] = word()
        add(own)
    out += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\ttwo "), (2005, "one two three four five"), (2006, out[0][1]), (2007, out[0][1].upper())]
    return out


def test_groups_equal_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in N.groups(df).collect())
    assert got == brute(docs)
    assert sum(1 for r in got if not r[3]) > 60


def test_small_sketches_lose_no_group(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in N.groups(df, k=48, full=64).collect()) == brute(docs)


def test_deduplicate_and_edge_cases(spark, docs):
    df = spark.createDataFrame([*docs, docs[0], (None, "a b c d e f"), (None, None)], "doc_id long, text string").selectExpr("*", "'x' as component_id", "1 as kept")
    kept = N.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([d for d in ids if d is not None]) == len({*ids} - {None})
    assert {*ids} == {d for d, _, _, keep in brute(docs) if keep} | {None}
    assert N.groups(df.limit(0)).count() == 0


def test_repeated_rows_and_rows_without_an_id_are_left_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text + " more"), (None, "other words of a text without id"), (None, "other words of a text without id"), (7, "a b c d e f g"), (None, None), (8, None)]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "other words of a text without id"), (5, text), (7, "a b c d e f g"), (8, "")]


def test_long_texts_lose_no_link(spark):
    """Sets far beyond both sketches (production sizes), linked and unlinked ones about the threshold: recall is 1."""
    rnd = random.Random(8)
    word = lambda: "w%d" % rnd.randrange(50_000)
    docs, n = [], 0
    for _ in range(24):
        base = [word() for _ in range(rnd.choice([1100, 1800, 2600]))]
        for share in (0, 0.02, 0.028, 0.031, 0.04):
            own = list(base)
            for at in rnd.sample(range(len(own)), int(share * len(own))):
                own[at] = word()
            n += 1
            docs.append((n * 11 % 211, " ".join(own)))
    want = brute(docs)
    assert sorted(tuple(r) for r in N.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()) == want
    assert 24 < len({r[2] for r in want}) < 100


def test_many_texts_alike_but_not_linked(spark):
    """A list of 300 classes that share most values, of which few are linked: several rounds of hubs."""
    rnd = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common + [f"x{rnd.randrange(40)}" for _ in range(16)] + [f"y{i % 250}"] * 4)) for i in range(300)]
    assert sorted(tuple(r) for r in N.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute(docs)
