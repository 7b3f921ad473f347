import hashlib
import random
import sys

import numpy as np
import pytest

from trackloom.llm import bpe, toxicity
from trackloom.llm.shared import ALNUM, Words

from . import test_bpe, test_decontaminate, test_neardup, test_secrets

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, tmp_path):
    say = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        docs.append((i, say(i) + (" blargo snivvel blargo" if bad else ""), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs += [(500, say(1, 40) + " more", "en", "s", 0), (501, say(501) + " " + say("b", 12), "en", "s", 0), (502, say(502) + " token = abcdef123456", "en", "s", 0), (503, None, None, None, None), (504, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, say("b", 12).upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i in range(240) if i % 4} | {502, 503, 504}
    assert out[502].text.endswith(" [secret]") and out[502].n_chars == len(out[502].text)
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.values())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_stages_done_plainly(spark, tmp_path):
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(3000)] + ["Übung", "日本語", "it's", "12,345"]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, say(rnd.choice([4, 10, 15, 30]))) for i in range(12)] + [(50, None), (51, "")]
    docs, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        text = say(rnd.randrange(30, 90)) + (" blargo snivvel, you blargo" if bad else "")
        if i % 9 == 1:
            text = say(8) + " " + rnd.choice(items[:12])[1].upper() + " " + say(8)
        if i % 9 == 2:
            text += " password: hunter22x AKIA" + "Q7" * 9 + " " + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=36)) + " é " + "3f" * 14
        docs.append((1000 - i, text, "en", "s", len(text), "x"))
        labels.append((1000 - i, int(bad)))
    for i, (_, text, *_) in enumerate(docs[:120]):  # copies, near ones and some just apart
        own = text.split(" ")
        for _ in range(i % 6):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        docs.append((2000 + i, " ".join(own), "en", "s", 0, "y"))
    docs += [(3000, "", "en", "s", 0, None), (3001, None, None, None, None, None), (3002, " \n ", "en", "s", 3, "z"), (3003, "same few words", "en", "s", 0, "z"), (3004, "same  few WORDS", "en", "s", 0, "z"), docs[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.train(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def score(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        ends = np.array([0, len(data)])
        return model.scores(Words(data, ends, ALNUM, hashes=False), ends)[0]

    calm = sorted({d for d in docs if score(d[1]) < 0.7}, key=lambda d: d[0])
    first = {d for d, _, _, kept in test_neardup.brute([d[:2] for d in calm]) if kept}
    unseen = {row[0] for row in test_decontaminate.brute([d[:2] for d in calm], items) if not row[-1]}
    left = [d for d in calm if d[0] in first & unseen]
    assert len(docs) - 25 > len(calm) > len(first) > len(left) > 60
    rank = {t: i for i, t in enumerate(bpe.load_ranks(test_bpe.PATH))}
    want = []
    for d, more in zip(left, test_secrets.brute_random([d[1] for d in left]), strict=True):
        text, out, at = d[1] or "", [], 0
        for b, e in sorted([(b, e) for b, _, e in test_secrets.brute(text)] + more):
            out += [text[at:b], "[secret]"] if b >= at else []
            at = max(at, e)
        text = None if d[1] is None else "".join(out) + text[at:]
        ids = test_bpe.brute(text, rank)
        want.append((d[0], text, *d[2:4], None if text is None else len(text), d[5], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*schema.replace(" long", "").replace(" string", "").split(", "), "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids_sha256 long, decoded_sha256 string, spans long, score string, kept string, component_id string"


def written(spark, tmp_path, docs, items=((1, "a b c d e f g h i j"),), labels=((1, 0),)):
    spark.createDataFrame(docs, CLASHES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_empty_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path, [], items=[], labels=[]))
    assert out.count() == 0 and out.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]


def test_clashing_names_and_very_long_texts(spark, tmp_path):
    rnd = random.Random(2)
    say = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    long = say(150_000)
    texts = [long, long + " more", "x" * 400_000, say(60) + " token=abcdef1234 " + say(150_000), None, "", say(90_000) + " a B c d e f g h i j " + say(10)]
    docs = [(i, t, "en", "s", 7, "own", 5, "own", 6, "own", "own", "own") for i, t in enumerate(texts)]
    out = corpus_pipeline.run(spark, written(spark, tmp_path, docs))
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {0, 2, 3, 4, 5}  # the near copy and the benchmark's passage are gone
    assert sorted(out.columns) == sorted(c.split()[0] for c in CLASHES.split(", "))
    assert "[secret]" in rows[3].text and rows[3].n_chars == len(rows[3].text) and rows[4].text is None and rows[4].n_chars is None
    for r in rows.values():
        assert (r.spans, r.score, r.kept, r.component_id) == (6, "own", "own", "own")
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert rows[5].n_tokens == 0 and rows[2].text == "x" * 400_000
