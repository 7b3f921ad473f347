import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import toxicity as T
from trackloom.llm.shared import ALNUM, Words, text_blocks

TERMS = ["idiot", "moron", "trash", "scum", "worthless", "disgusting"]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def words_of(text):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    return next((Words(d, o, ALNUM), o) for _, _, d, o in text_blocks(batch))


def test_matches_equal_brute_force():
    rnd, words = random.Random(1), []
    for _ in range(1500):
        w = list(rnd.choice(TERMS))
        for _ in range(rnd.randrange(4)):
            kind, i = rnd.random(), rnd.randrange(len(w))
            if kind < 0.3 and len(w) > 3:
                w.pop(i)
            elif kind < 0.6:
                w.insert(i, rnd.choice("abdeiorst"))
            else:
                w[i] = rnd.choice("abdeiorst")
        words.append("".join(w))
    want = {}
    for i, w in enumerate(words):
        if any(w.startswith(t) for t in TERMS):
            want[i] = 0
        elif near := [distance(w, t) for t in TERMS if distance(w, t) <= T.Lexicon.errors(len(t))]:
            want[i] = min(near)
    got = {k: far for k, _, far, _ in T.Matcher(dict.fromkeys(TERMS, 4.0)).matches(words_of(" ".join(words))[0])}
    assert got == want and 500 < len(got) < 1500


def test_quotation_is_not_abuse():
    m = T.Matcher(dict.fromkeys(TERMS, 4.0))
    rows = [m.features(*words_of(t))[0] for t in ('she was an idiot, you moron', 'he was told "idiot" once', "they called it trash", "a calm line", "")]
    assert [r[0] > 0 for r in rows] == [True, False, False, False, False]
    assert rows[0][4] > 0 and rows[1][3] > 0 and rows[2][3] > 0


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        w, bad = rnd.choices(plain, k=40), rnd.random() < 0.3
        if bad:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["blargo", "snivvel", "grumkins", "blargos"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "blargo " * 3 + "word1 " * 20), (1003, "Blarga snivvel GRUMKIN word3 " + "word2 " * 30), (0, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_cases(tables):
    docs, labels = tables
    rows = T.digest(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 100
    by = {r.doc_id: r for r in rows}
    assert by[1000].score < 0.5 and by[1001].score < 0.5 and by[1002].predicted == 1 and by[1003].predicted == 1


def test_clean_keeps_columns(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    wide = docs.withColumn("_score", F.lit("x")).withColumn("toxic", F.lit(3))
    kept = T.clean(wide, labels)
    assert kept.columns == wide.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()} and 1002 not in {r.doc_id for r in kept.collect()}
    assert T.clean(wide.limit(0), labels).count() == 0
    assert T.digest(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_words_of_three_letters_match_only_as_a_whole():
    m = T.Matcher({"fug": 4.0, "moron": 4.0})
    assert [(word, far, term) for _, word, far, term in m.matches(words_of("fug fugue FUG fu fuga fag morons maron")[0])] == [(b"fug", 0, b"fug"), (b"fug", 0, b"fug"), (b"morons", 0, b"moron"), (b"maron", 1, b"moron")]


def test_lexicons_of_very_many_terms_stay_whole(spark):
    terms = [f"bad{a}{b}{c}" for a in "bcdfghjk" for b in "aeiou" for c in "bcdfghjk"]  # 320
    rows = [(" ".join(terms), 1)] * 3 + [(" ".join(f"calm{i}" for i in range(k, k + 300)), 0) for k in range(8)]
    found = T.learn_terms(spark.createDataFrame(rows, "text string, toxic int"), support=2)
    assert all(any(t.startswith(s) for s in found) for t in terms) and not any(s.startswith("calm") for s in found)
    short = spark.createDataFrame([("fug you", 1)] * 5 + [("see you", 0)] * 20, "text string, toxic int")
    assert "fug" in T.learn_terms(short) and "you" not in T.learn_terms(short)


def plain_features(text, ratio, ordinary):
    """The six counts of a text, from its words by a regular expression and the distance by dynamic programming."""
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw)]
    terms = [t.encode() for t in ratio]
    abuse = misspelled = quoted = addressed = 0
    for k, (b, e, word) in enumerate(words):
        begins = [t for t in terms if word.startswith(t) and (len(t) > 3 or word == t)]
        if begins:
            term, far = max(begins, key=len), 0
        else:
            near = [(d, t) for t in terms if len(t) > 4 and (d := distance(word, t)) <= (1 if len(t) < 9 else 2)]
            if not near or word in ordinary:
                continue
            far, term = min(near)
        before, after = raw[max(0, b - T.WINDOW) : b].split(b"\n")[-1], raw[e : e + T.WINDOW].split(b"\n")[0]
        beside = {w.decode("utf-8", "replace") for j, (_, _, w) in enumerate(words) if j != k and abs(j - k) <= 4}
        marks = [(x.encode(), z.encode()) for x, z in ("\u201c\u201d", "\u00ab\u00bb", "\u201e\u201c")]
        inside = before.count(b'"') % 2 == 1 and b'"' in after or any(before.rfind(x) > before.rfind(z) and z in after for x, z in marks)
        if inside or beside & set(T.REPORTING):
            quoted += 1
        else:
            abuse += ratio[term.decode()] / (1 + far)
            misspelled += far > 0
            addressed += bool(beside & set(T.ADDRESS))
    return [min(abuse, 40) / 10, math.log1p(abuse), math.log1p(misspelled), math.log1p(quoted), math.log1p(addressed), math.log1p(1000 * abuse / (len(words) + 50))]


def test_scores_equal_a_plain_twin(spark, tables):
    docs, labels = tables
    rnd = random.Random(14)
    more = ["blargo", "Snivvel!", "grumkinz", "blaargo", "you", "your", "said", "called", '"', "\u201c", "\u201d", "\u00ab", "\u00bb", "\u201e", "\n", "word1", "é", "word22", "snivvels", "blarg"]
    texts = [(3000 + i, " ".join(rnd.choices(more, k=rnd.randrange(60)))) for i in range(300)] + [(4000, "word5 " * 200_000 + "you blargo"), (4001, "blargo" * 50_000)]
    every = docs.union(spark.createDataFrame(texts, "doc_id long, text string"))
    model = T.train(docs, labels)
    ratio = {t.decode(): x for t, x in model.matcher.ratio.items()}
    assert {"blargo", "snivvel"} <= {t for t in ratio} | {t[:6] for t in ratio} | {t[:7] for t in ratio}
    score = lambda text: 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:].tolist(), plain_features(text, ratio, model.matcher.ordinary), strict=True)))))
    got = T.score(every, model).collect()
    assert len(got) == every.count()
    for r in got:
        if r.doc_id not in (4000,):
            assert r.score == pytest.approx(score(r.text), abs=1e-5), r.text and r.text[:200]
    assert {r.doc_id: r.score for r in got}[4000] == pytest.approx(score("word5 " * 200_000 + "you blargo"), abs=1e-5)


def test_the_weights_are_the_best_ones():
    """The loss, and the pull towards the prior, has no slope at the weights found."""
    rng = np.random.default_rng(3)
    x, n = rng.random((200, T.FEATURES)), rng.integers(1, 5, 200).astype(float)
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0.5).astype(float)
    w = T.fit(x, y, n)
    own = np.concatenate([np.ones((200, 1)), x], 1)
    slope = own.T @ (n * (1 / (1 + np.exp(-own @ w)) - y)) + 0.5 * (w - T.PRIOR)
    assert np.abs(slope).max() < 1e-6


def test_terms_equal_a_plain_count(spark):
    rnd = random.Random(6)
    rows = [(" ".join(rnd.choices(["blargo", "blargos", "grum", "grumkin", "fug", "calm", "word"], [3, 2, 1, 2, 1, 5, 5], k=20)) if i % 3 == 0 else " ".join(rnd.choices(["calm", "word", "grum", "other"], [6, 6, 1, 5], k=20)), int(i % 3 == 0)) for i in range(90)]
    much = [sum(len(t) + 1 for t, y in rows if y == k) for k in (0, 1)]
    found = {}
    stems = {w[:n] for t, _ in rows for w in t.split() for n in [*range(4, min(11, len(w))), len(w)] if n > 2}
    for s in stems:
        held = lambda t: sum(w == s or w.startswith(s) and 4 <= len(s) <= 10 for w in t.split())  # noqa: B023, E731
        n, d = [sum(held(t) for t, y in rows if y == k) for k in (0, 1)], sum(held(t) > 0 for t, y in rows if y)
        ratio = math.log((n[1] + 0.5) / much[1]) - math.log((n[0] + 0.5) / much[0])
        if d >= max(T.SUPPORT, sum(y for _, y in rows) / 50) and ratio >= 2.5:
            found[s] = (d, ratio)
    inner = lambda s: [s[:n] for n in range(4, len(s)) if s[:n] in found]
    lost = {b for s in found for b in inner(s) if found[s][0] >= 0.9 * found[b][0]}
    want = {s: x for s, (_, x) in found.items() if s not in lost and all(b in lost for b in inner(s))}
    got = T.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)
