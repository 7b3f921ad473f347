import re

from trackloom.llm import urls as U


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = ["http://A.Example.NET/en/1?x=/", "https://example.net/de", "https://x.example.com/de/7#top", "https://example.com/de", "http://a.org/fr/", "http://org/fr/x", "http://xorg/fr/", "ftp://net", "http://net/", None, "", "nothing", "http://notexample.net/en/", "http://a.b?c=d/e", "x://ÄB.org/fr/é://y", "http://spam-farm.example.org/en/728", "https://www.free-bets.example.com/en/1", "https://thther.example.org/en/685", "http://a.example.com/fr/" + "y" * 5000]


def test_judges_equal_brute_force(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (0, URLS[0])], "page_id long, url string")
    rows = U.digest(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = split(URLS[r.page_id])
        assert (r.host, r.path) == (host, path), r
        want = rule(host, path)
        assert r.rule == (want and want[0]), r
        if want:
            assert r.verdict == want[1]
    by = {URLS[r.page_id]: r.verdict for r in rows}
    assert by[URLS[15]] == by[URLS[16]] == "block" and by[URLS[17]] == "allow"


def test_extra_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://net/", "h", 2)], "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    model = U.train(U.labelled(spark), rows=500)
    out = U.judge(pages, rules, model)
    assert [tuple(r)[:5] for r in out.collect()] == [(1, "http://net/", "net", "/", "net/")]
    assert U.judge(pages.limit(0), rules, model).count() == 0
    assert U.judge(pages, rules.limit(0), model).first().rule is None


def test_held_out_hosts(spark):
    """Compounds and made-up names that the table doesn't hold: precision and recall of block."""
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    seen = {n for n, _ in U.names()}
    other = [(n, bad) for n, bad in U.names(5000, 300) if n not in seen]
    pages = [(i, f"https://{n}.example.org/en/{i}", bad) for i, (n, bad) in enumerate(other)]
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string, bad double"), rules, U.train(U.labelled(spark))).collect()
    right = sum(r.bad == 1 and r.verdict == "block" for r in rows)
    precision, recall = right / sum(r.verdict == "block" for r in rows), right / sum(r.bad for r in rows)
    assert sum(r.bad for r in rows) > 100 and precision >= 0.9 and recall >= 0.9, (precision, recall)


def test_the_longest_rule_wins_and_ties_go_by_host(spark):
    rules = spark.createDataFrame([("block", "b.c", "/a"), ("allow", "c", "/abcd"), ("allow", "b.c", ""), ("block", "c", "/ab/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "x://b.c/abcd"), (2, "x://b.c/ab/"), (3, "x://c/ab/"), (4, "x://b.c/zz"), (5, "x://a.b.c/ax")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, rules, U.train(U.labelled(spark, 20))).collect()}
    assert got == {1: ("c/abcd", "allow"), 2: ("b.c/a", "block"), 3: ("c/ab/", "block"), 4: ("b.c", "allow"), 5: ("b.c/a", "block")}


def murmur(data: bytes, seed: int = 42) -> int:
    """MurmurHash3, 32 bits, with the last bytes one by one as signed ones, as Spark hashes text."""
    rotate = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    mix = lambda h, k: (rotate(h ^ rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h, body = seed, len(data) // 4 * 4
    for i in range(0, body, 4):
        h = mix(h, int.from_bytes(data[i : i + 4], "little"))
    tail = 0
    for i, b in enumerate(data[body:]):
        tail |= b << 8 * i
    if body < len(data):
        h ^= rotate(tail * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_model_scores_equal_a_plain_twin(spark):
    """Grams by slicing, their hashes, and the logistic function of the weights that they name."""
    import math

    rules = spark.createDataFrame([], "verdict string, host string, path string")
    model = U.train(U.labelled(spark, 60))
    weights, bias = model.stages[1].coefficients.toArray(), model.stages[1].intercept

    def score(url):
        host, path = split(url)
        labels = host.split(".")
        name = "^" + (".".join(labels[:-2]) if len(labels) > 2 else host) + "$"
        grams = {m + t[i : i + n] for m, t in (("h", name), ("p", path)) for n in U.SIZES for i in range(len(t) - n + 1)}
        return 1 / (1 + math.exp(-bias - sum(weights[i] for i in {murmur(g.encode()) % U.BUCKETS for g in grams})))

    urls = URLS + [f"https://{n}.example.org/en/{i}" for i, (n, _) in enumerate(U.names(900, 60))]
    rows = U.judge(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), rules, model).collect()
    for r in rows:
        want = score(urls[r.page_id])
        assert abs(r.score - want) < 1e-9 and r.verdict == ("block" if want >= 0.5 else "allow"), (urls[r.page_id], r.score, want)


#: Words of hosts of either kind, none of them in the training table.
NEW_BAD = "vegas blackjack wager lotto bingo cialis meds debt mortgage erotic nude hookup pirate leaked counterfeit handbags promo discount sweepstakes clickbait crypto giveaway rich slim detox".split()
NEW_GOOD = "academy planetarium observatory laboratory geology geography economics philosophy sociology parliament ministry embassy harbour station bridge orchard brewery butcher tailor carpenter dentist pharmacy-school orchestra ballet opera".split()


def test_hosts_of_words_that_the_table_lacks(spark):
    """How the model does on words it never saw: figures in the README. It mostly lets such hosts pass."""
    assert not {*NEW_BAD, *NEW_GOOD} & {*U.BAD, *U.GOOD}
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    other = [(U.compound(words, k), bad) for words, bad in ((NEW_BAD, 1.0), (NEW_GOOD, 0.0)) for k in range(200)]
    pages = [(i, f"https://{n}.example.org/en/{i}", bad) for i, (n, bad) in enumerate(other)]
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string, bad double"), rules, U.train(U.labelled(spark))).collect()
    right, blocked = sum(r.bad == 1 and r.verdict == "block" for r in rows), sum(r.verdict == "block" for r in rows)
    print("unseen words: precision", right / max(1, blocked), "recall", right / sum(r.bad for r in rows))
    assert right >= 0.1 * sum(r.bad for r in rows) and right >= 0.5 * blocked, (right, blocked)
