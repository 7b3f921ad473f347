import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex

from trackloom.llm import bpe as B
from trackloom.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
#: The vocabulary above has no token of several white-space characters; others have.
RUNS = [b"\n ", b"\t ", b"\n \n", b" \n", b"  ", b"\xa0 ", b"\xc2\xa0", b"\xc2\xa0 "]


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    path = tmp_path_factory.mktemp("ranks") / "runs.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + RUNS + [b"wo", b"rd", b"word", b" word", b" w", b"ab"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)


@pytest.fixture(params=["production", "runs"])
def path(request, runs):
    return PATH if request.param == "production" else runs


@pytest.fixture
def rank(path):
    return {t: i for i, t in enumerate(B.load_ranks(path))}


def brute(text, rank):
    """Every match of the pattern over the whole text, its pair of least rank merged until there is none."""
    ids = []
    for piece in regex.findall(public_tokenizers.PATTERN, text or ""):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            least, at = min((rank.get(a + b, len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        ids += [rank[p] for p in parts]
    return struct.pack(f"<{len(ids)}I", *ids)


def test_ids_equal_plain_merges(spark, path, rank):
    texts = ["x\n \ny", "a\t \tb", "It ends.\n ", "\n \n", "\t \t", " \n", " ", "", None, "a  b   c ", "a\u00a0 \u00a0b", "a\u3000 b\r\n c", "tabs \t and\n\n  indents\n\tdeep", "plain words, they're fine; it's 12 345", "a\x1c b \x1f c", "Übung 🙂🙂 日本語 текст", "z" * 700, "ab" * 300 + "\n " + "!?" * 90]
    rnd = random.Random(9)
    texts += ["".join(rnd.choices(["a", "word", "Éa", "7", "!", "'s", " ", " ", "\n", "\t", "\u00a0", "\r"], k=rnd.randrange(1, 40))) for _ in range(400)]
    docs = [*enumerate(texts), (0, texts[0])]
    coded = B.encode(spark.createDataFrame(docs, "doc_id long, text string"), path, public_tokenizers.PATTERN)
    got = coded.withColumn("array", B.as_array("ids")).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(r.text, rank)
        assert bytes(r.ids) == want, repr(r.text)
        assert struct.pack(f"<{len(r.array)}I", *r.array) == want


def test_digest_of_ids(spark, path, rank):
    docs = [(1, "x\n \ny"), (2, None), (3, "a\t \tb and.\n ")]
    for r in B.digest(spark.createDataFrame(docs, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect():
        text, want = dict(docs)[r.doc_id] or "", brute(dict(docs)[r.doc_id], rank)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_pieces_equal_the_library(path, rank):
    """Pieces beyond SHORT have a tree of their own; tiktoken is the judge."""
    import tiktoken

    rnd = random.Random(4)
    texts = ["z" * 5000, "ab" * 9000, "".join(rnd.choices("etaoinshrdlu", k=60_000)), "é" * 3000, "=" * 1025, "".join(rnd.choices("abé", k=257))]
    judge = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in rank.items() if t is not None}, special_tokens={})
    tokens = B.load_ranks(path)
    coder = B.Encoder(tokens, public_tokenizers.PATTERN, *B.pair_table(tokens))
    for t, got in zip(texts, coder.encode(texts), strict=True):
        ids = judge.encode_ordinary(t)
        assert got == struct.pack(f"<{len(ids)}I", *ids), t[:20]
        assert coder.decode(got) == t.encode()


def test_a_megabyte_in_one_piece(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choices("etaoinshrdlu", k=1_000_000))
    r = B.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).first()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and 100_000 < r.n_tokens < 900_000


def test_repeated_rows_empty_tables_and_clashing_names(spark, path, rank):
    rows = [(1, "some words", b"x", 7), (1, "some words", b"x", 7), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, decoded int")
    got = B.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    want = sorted((d, brute(t, rank), (t or "").encode()) for d, t, _, _ in rows)
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    again = B.decode(got.drop("decoded"), path, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in again.collect()) == [(d, t) for d, _, t in want]
    assert B.digest(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """They differ in one merge only, neither the last nor the middle one."""
    tokens = [bytes([b]) for b in range(256)]
    paths = []
    for name, odd in (("a", b"ab"), ("b", b"cd")):
        paths.append(str(tmp_path / name))
        with open(paths[-1], "wb") as out:
            out.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*tokens, odd, *(b"x" + bytes([b]) for b in range(97, 110))]))
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    found = [struct.unpack("<3I", B.encode(docs, p, public_tokenizers.PATTERN).first().ids) for p in (*paths, paths[0])]
    assert found == [(256, 99, 100), (97, 98, 256), (256, 99, 100)]


def test_gaps_in_ranks(tmp_path, spark):
    path = str(tmp_path / "gaps")
    with open(path, "wb") as out:
        out.writelines(base64.b64encode(t) + b" %d\n" % i for t, i in [(bytes([b]), b + 5) for b in range(256)] + [(b"ab", 900)])
    got = B.encode(spark.createDataFrame([(1, "ab c")], "doc_id long, text string"), path, public_tokenizers.PATTERN).first().ids
    assert struct.unpack("<3I", got) == (900, 37, 104)
