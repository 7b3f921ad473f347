import random
import zlib

from trackloom.llm import language as L

SOUNDS = {"en": "th the and ing of er on re", "de": "sch ein und lich keit ge ver pf", "fr": "eau que ou oi eux an ment tre", "es": "ci ón que do as os lla mente", "pl": "szcz rz ow ie dz cz sk prze"}


def text(rnd, lang):
    return " ".join("".join(rnd.choices(SOUNDS[lang].split(), k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(8, 60)))


def test_held_out_accuracy_and_cases(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        lang = rnd.choice(list(SOUNDS))
        rows.append((i, text(rnd, lang), lang, lang))
    rows += [(2000, None, "en", None), (2001, "", None, None), (2002, "123 ... !", "fr", None), (2003, "Ж", None, None), (2004, "the and thing " * 20000, None, "en"), (1, rows[1][1], "en", rows[1][3]), (None, "und ein schein", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    out = L.digest(df.drop("truth").selectExpr("*", "7 as score", "'q' as lang_pred")).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in out if r.held_out and truth.get(r.doc_id)]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 200
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (2000, 2001, 2002, 2004)] == ["und", "und", "und", "en"]
    assert by[2003].lang_pred != "und" and all(0 <= r.score <= 1 for r in out)
    assert L.digest(df.drop("truth").limit(0)).count() == 0


def test_without_labels_and_with_one(spark):
    df = spark.createDataFrame([(i, "some words", None) for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.digest(df).collect()} == {"und"}
    one = spark.createDataFrame([(i, "some words", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.digest(one).collect()} == {"en"}


def test_predictions_equal_dense_margins_and_votes():
    """Each text by itself: dot products of its shares with the weights, the family's vote, then the languages' votes."""
    import math

    import numpy as np

    rnd = random.Random(3)
    texts = [(text(rnd, lang), lang) for lang in SOUNDS for _ in range(25)] + [(text(rnd, "pl"), "cs") for _ in range(5)]
    shares = lambda t: np.bincount(L.slots(np.frombuffer(t.encode(), np.uint8)), minlength=L.SIZE) / max(1, len(t.encode()) - 2)
    model = L.Model(np.array([shares(t) for t, _ in texts], np.float32), [lang for _, lang in texts])
    probes = [t for t, _ in texts[::7]] + ["", "a", "ab", "the the the", "sch eau ci"]
    raw = [t.encode() for t in probes]
    got, score = model.predict(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    chance = lambda z: 1 / (1 + math.exp(-4 * min(8, max(-8, z))))
    for k, t in enumerate(probes):
        x = shares(t)
        margin = lambda m: float(x @ m.weights) + m.bias  # noqa: E731, B023
        tops = [margin(m) for _, m in model.tops]
        family, sure = model.families[int(np.argmax(tops))], chance(max(tops))
        own = model.members[family]
        votes, total, sums = ({a: 0.0 for a in own} for _ in range(3))
        for f, a, b, m in model.pairs:
            if f == family:
                z = margin(m)
                votes[a if z > 0 else b] += 1
                total[a] += z
                total[b] -= z
                sums[a] += chance(z)
                sums[b] += chance(-z)
        best = max(own, key=lambda a: (votes[a] + math.tanh(total[a] / (len(own) + 1)) / 4))
        assert got[k] == best, t
        assert abs(score[k] - sure * (sums[best] / (len(own) - 1) if len(own) > 1 else 1)) < 1e-6


def test_ties_are_predicted_alike(spark):
    rows = [(i, "the the thing" if i % 2 else "que los casas", "en" if i % 2 else "es") for i in range(60)] + [(100 + i, "the the thing", None) for i in range(5)]
    out = L.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len({(r.lang_pred, r.score) for r in out if r.doc_id >= 100 or r.doc_id % 2}) == 1
