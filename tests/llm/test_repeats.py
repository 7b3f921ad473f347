import collections
import hashlib
import random

from trackloom.llm import repeats as R


def brute(docs):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_digest_equals_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choices("abcdé fgh", k=n))
    passages = [say(n) for n in (150, 199, 200, 260, 700)]
    docs = [(i, say(rnd.randrange(300)) + rnd.choice(passages) + say(rnd.randrange(200)) + rnd.choice(passages)) for i in range(30)]
    base = say(900)
    for i in range(12):
        own = list(base)
        for _ in range(3):
            own[rnd.randrange(900)] = "X"
        docs.append((100 + i, "".join(own)))
    docs += [(200, None), (201, ""), (202, base), (203, base), (202, base), (204, "a" * 500), (205, "ab" * 150 + say(50)), (206, "short"), (207, "short"), (208, "z" * 200), (209, "é" * 100), (None, passages[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as t", "2 as spans")
    want = brute(docs)
    assert sorted((tuple(r) for r in R.digest(df).collect()), key=repr) == want
    assert sorted((tuple(r) for r in R.digest(df, hot=5).collect()), key=repr) == want
    for hot in (R.HOT, 5):
        assert sorted((tuple(r) for r in R.digest(df, hot=hot, local="lyndon").collect()), key=repr) == want
    assert R.digest(df.limit(0)).count() == 0


def test_suffixes_are_grouped_in_order():
    rnd = random.Random(3)
    for t in range(400):
        x = rnd.choices(range(2 + t % 5), k=rnd.randrange(80))
        assert R.lyndon_order(x) == sorted(range(len(x) + 1), key=lambda i: x[i:])
    assert R.lyndon_order([7] * 300) == list(range(300, -1, -1))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    """Chunks of 700 bytes: strings and contexts over their edges, and batches of few contexts."""
    import numpy as np

    rnd = random.Random(21)
    say = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    shared = [say(n) for n in (250, 400, 900)]
    docs = [(i, "".join(say(rnd.randrange(400)) + rnd.choice(shared) for _ in range(8))) for i in range(6)] + [(9, "ab" * 3000)]
    for _, text in docs:
        data = np.frombuffer(text.encode(), np.uint8)
        whole = R.anchors(data)
        monkeypatch.setattr(R, "CHUNK", 700)
        for x, y in zip(R.anchors(data), whole, strict=True):
            assert np.array_equal(x, y)
        monkeypatch.undo()
    assert sorted((tuple(r) for r in R.digest(spark.createDataFrame(docs, "doc_id long, text string"), hot=3).collect()), key=repr) == brute(docs)


def test_a_very_long_text(spark):
    """20 MB in five chunks; a passage of it stands in a short text, and one of 300 bytes twice in itself, chunks apart."""
    rnd = random.Random(5)
    text = rnd.randbytes(10_000_000).hex()
    passage = rnd.randbytes(150).hex()
    text = text[:100] + passage + text[400:15_000_000] + passage + text[15_000_300:]
    docs = spark.createDataFrame([(1, text), (2, "before " + text[7_000_000:7_000_500] + " after")], "doc_id long, text string")
    got = {r.doc_id: r for r in R.digest(docs).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (20_000_000, 600 + 500, 3)
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (500, 1, hashlib.sha256(b"before  after").hexdigest())


def test_contexts_of_one_anchor(spark):
    """Equal contexts are marked without their bytes, in one batch and over several; texts cut short on either side are contexts of their own."""
    rnd = random.Random(2)
    say = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    line = say(230)
    docs = [(i, line[k:] + say(5) if i % 2 else say(5) + line[: 230 - k]) for i, k in enumerate([0, 0, 10, 10, 29, 29, 30, 30, 31, 31])]
    docs += [(20 + i, say(300) + line + say(300)) for i in range(4)] + [(30, "x" + line + "x")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in R.digest(df).collect()), key=repr) == brute(docs)
