import collections
import random
import re

from pyspark.sql import functions as F

from trackloom.llm import divergence as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string"


def brute(docs, least=3, top=200):
    docs = [tuple(x or "" for x in d) for d in docs]
    held, occurs, groups, out = collections.Counter(), collections.Counter(), set(), []
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))
        groups.add((lang, source))
        held.update((lang, w) for w in set(words))
        occurs.update((lang, source, w) for w in words)
    for lang in {x for x, _ in groups}:
        kept = sorted(w for (x, w), n in held.items() if x == lang and n >= least)
        sources = [s for x, s in groups if x == lang]
        counts = {s: [occurs[lang, s, w] for w in kept] for s in sources}
        share = lambda own: [1 + 10**9 * (n + 1) // (sum(own) + len(own)) for n in own]
        p = {s: share(own) for s, own in counts.items()}
        whole = share([sum(own) for own in zip(*counts.values(), strict=True)])
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            found = {"pair": [(sum(map(f, p[s], p[o])), o) for o in sources if o != s], "term": [(f(a, b), w) for a, b, w, n in zip(p[s], whole, kept, counts[s], strict=True) if n and a > b]}
            for part, rows in found.items():
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(rows[: top if part == "term" else None])]
    return sorted(out)


def corpus():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abAé日", k=rnd.randrange(1, 6))) + "longtail" * rnd.randrange(3) for _ in range(60)]
    docs = [(" ".join(rnd.choices(words, k=rnd.randrange(30))) + rnd.choice(["", " 1 ", "--X"]), rnd.choice(["en", "de", None, ""]), rnd.choice([f"s{i}" for i in range(7)] + [None])) for _ in range(150)]
    return docs + [(None, "zz", "a"), ("", "zz", "b"), ("one two", "yy", "b"), ("x", "yy", None), docs[0], docs[0]]


def test_audit_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as value", "'x' as term", "2 as level", "3 as n")
    rows = D.digest(df)
    assert rows.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, rows.collect())) == brute(docs)
    small = D.audit(df, top=3, per_cell=5, tile=2, block=300)  # many blocks, cells and tiles
    assert sorted(map(tuple, small.collect())) == brute(docs, top=3)
    assert D.digest(df.limit(0)).count() == 0 and D.digest(df.where("false")).columns == rows.columns


def test_a_hot_source_and_a_very_long_text(spark):
    rnd = random.Random(5)
    docs = [(" ".join(f"w{'abcdefgh'[k]}" for k in rnd.choices(range(8), k=12)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs += [("long " * 300_000 + "日" * 50_000, "en", "hot"), ("long", "en", "s1"), ("longer long", "en", "s2"), ("日" * 50_000, "en", "s2"), ("日" * 50_000, "en", "s3")]
    rows = D.audit(spark.createDataFrame(docs, SCHEMA), block=20_000).collect()
    assert sorted(map(tuple, rows)) == brute(docs)


def test_prefixes_in_too_few_documents_are_not_extended(spark):
    """Only prefixes of the level before that were kept are extended: 'abcd' is in three documents, no longer prefix is."""
    docs = spark.createDataFrame([("abcdaaaa abcd", "en", "s"), ("abcdbbbb abcdbbbc", "en", "s"), ("abcdcccc", "en", "t"), ("zz zz zz", "en", "t")], SCHEMA)
    kept = D.refine(docs).select("term").collect()
    assert kept == []
    more = D.refine(docs.union(docs.select(F.lit("abcd zz zz"), "lang", "source").limit(2)))
    assert {(r.term, r.source, r.occurs, r.everywhere) for r in more.collect()} >= {("zz", "t", 3, 7)}
    assert {r.term for r in more.collect()} == {"abcd", "zz"}
