import hashlib
import random
import re

import pytest

from trackloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for k in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    vocabulary = ["the", "of", "Ünder", "a1", "x"] + [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, say(rnd.choice([1, 2, 3, 9, 10, 14, 40]))) for i in range(25)] + [(99, None), (98, ""), (97, " ... "), (3, "the the the"), (96, "of of of of of of of of of of of of"), (None, "w1 w2 w3")]
    docs = [(i, say(rnd.randrange(0, 80))) for i in range(40)]
    docs += [(100 + i, say(12) + " ... " + (t or "").upper() + "! " + say(7)) for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "of " * 500), (203, "of " * 500), (204, say(4000))]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_digest_equals_brute_force(tables):
    docs, items, d, b = tables
    assert rows(D.digest(d, b)) == brute(docs, items)


def test_blocks_give_the_same(tables):
    docs, items, d, b = tables
    one = rows(D.find(d, b).selectExpr("doc_id", "n_words", "spans", "item_ids"))
    many = rows(D.find(d, b, block_words=300).selectExpr("doc_id", "n_words", "spans", "item_ids"))
    assert one == many


def test_clean_keeps_columns_and_empty_tables(spark, tables):
    docs, items, d, b = tables
    from pyspark.sql import functions as F

    wide = d.withColumns({"lang": F.lit("en"), "n_words": F.lit(1), "spans": F.lit("x")})
    kept = D.clean(wide, b)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])
    assert D.digest(d.limit(0), b).count() == 0
    assert D.digest(d, b.limit(0)).where("contaminated").count() == 0
