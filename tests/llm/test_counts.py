import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from trackloom.llm import counts as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", " ", "  ", "▁", "\n", "é", "日", "本", "語", "🙂", "\0", "<s>", "</s>", "<0x0A>", "the ", "hello", "ing", "́", "　", "\t", " x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    with open(MODEL, "rb") as f:
        return C.Counter(f.read())


def counted(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.count(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).tolist()


@pytest.mark.parametrize("part", [C.PART, 5])
def test_parts_have_the_tokens_of_the_whole(counter, library, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    rnd = random.Random(part)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randrange(40))) for _ in range(4000)] + ["", " ", "  ", "a ", "a  ", " a", "▁", "▁ ", "a▁ b", "x ▁"]
    counter.known.clear()
    assert counted(counter, texts) == [len(x) for x in library.encode(texts)]
    assert counted(counter, texts) == [len(x) for x in library.encode(texts)]  # from the counts that are kept


def test_very_long_texts(counter, library):
    rnd = random.Random(3)
    texts = ["日本語" * 5000, "the quick" * 3000, "a" * 20_000, "".join(rnd.choices("abcdefghij klm,.-é日", k=60_000)), "".join(rnd.choices("abcdefghijklm,.-é日", k=60_000)), " " * 5000]
    assert counted(counter, texts) == [len(x) for x in library.encode(texts)]
    assert len(counter.cuts(texts[4])) > 10


def test_digest(spark, library):
    rnd = random.Random(9)
    docs = [(i, "".join(rnd.choices(SIGNS, k=rnd.randrange(300)))) for i in range(300)]
    docs += [(300, None), (301, ""), (None, "null id"), (5, docs[5][1]), (302, "word " * 4096), (303, "word " * 4097), (304, "x" * 2_000_000 + " end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as n_bytes")
    got = sorted((tuple(r) for r in C.digest(df, MODEL).collect()), key=repr)
    n = [len(x) for x in library.encode([t or "" for _, t in docs])]
    assert got == sorted(((d, len((t or "").encode()), k, k > 4096) for (d, t), k in zip(docs, n, strict=True)), key=repr)
    assert C.digest(df.limit(0), MODEL).count() == 0
    assert C.count(df, MODEL).columns == ["doc_id", "text", "n_bytes", "n_tokens"]
