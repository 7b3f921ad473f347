import hashlib
import math
import random
import re

import pytest

from trackloom.llm import secrets as S

PATTERNS = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    text = text or ""
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))


def shown(spans):
    return ",".join(f"{S.KINDS[k]}:{b}:{e}" for b, k, e in spans)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    draw = lambda letters, n: "".join(rnd.choices(letters, k=n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["plain words und Übung 🙂 " * 3 + f'Token = "{draw(b64, 30)}" é api_key:{draw(b64, 5)} apikey=abc.def' for _ in range(5)]
    texts += [f"é🙂 {draw(b64, 40)} tail " + draw("0123456789abcdef", 40) + " AKIA" + draw("ABCDEFGHIJ0123456789", 16) for _ in range(20)]
    texts += [None, "", "token=abcde secret=token:abcdefgh", "AKIAAKIA" + "A" * 15, "AKIA1234", "PASSWORD ' : 'hunter22", "f" * 23 + " " + "e" * 24, "internationalizationofwords " * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "token=abcdefg " * 700, "=" * 30, "a" + "=" * 40 + " b", "-" * 25 + "_" * 25]
    return [*enumerate(texts), (0, texts[0])]


def test_base_spans_equal_brute_force(spark, docs):
    rows = S.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest(), r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(shown(want).split(",")) <= set(r.spans.split(",")) or not want
    more = {r.doc_id: r.spans.count("random") for r in rows}
    assert sum(more[i] for i in range(5, 25)) >= 14
    assert not any(more[i] for i in range(25, 35))


def test_mask_keeps_columns_and_removes_secrets(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as value")
    out = S.mask(df)
    assert out.columns == df.columns
    text = dict(docs)
    for r in out.collect():
        want, at = [], 0
        assert (r.text is None) == (text[r.doc_id] is None)
        if r.text and not brute(text[r.doc_id]):
            assert "[secret]" in r.text or r.text == text[r.doc_id]
        for b, _, e in brute(text[r.doc_id]):
            want.append(text[r.doc_id][at:b])
            at = max(at, e)
        if r.text:
            assert not brute(r.text)
    assert S.digest(df.limit(0)).count() == 0


def battery(v):
    """The inferred encoding's alphabet, the three tests' z and the p-value's bin of a run, plainly."""
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    patterns = ["[0-9a-f]+|[0-9A-F]+", "[a-z]+|[A-Z]+", "[A-Z2-7]+=*", "[0-9a-z]+|[0-9A-Z]+", ".*"]
    which = next(i for i, p in enumerate(patterns) if re.fullmatch(p, v))
    body = (v.lower() if which in (0, 1, 3) else v.replace("-", "+").replace("_", "/")).replace("=", "")
    codes, k, n = [alphabets[which].index(c) for c in body], len(alphabets[which]), max(2, len(body))
    chi = sum(codes.count(c) ** 2 for c in set(codes)) * k / n - n
    z_chi = ((max(1e-9, chi) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [2 * c >= k for c in codes]
    up, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 1 + 2 * up * (n - up) / n
    z_runs = (runs - expected) / math.sqrt(max(1e-9, (expected - 1) * (expected - 2) / (n - 1))) if 0 < up < n else 99
    mean = sum(codes) / n
    vary = sum((c - mean) ** 2 for c in codes)
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / vary * math.sqrt(n - 1) if vary else 99
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in v if c != "="]
    log = math.log(1 / 4)
    for a, b in zip(kind, kind[1:], strict=False):
        log += math.log(S.CHANGE / 3 if a != b else 1 - S.CHANGE)
    for c in body.lower():
        log += math.log(S.PROSE * S.LETTERS[ord(c) - 97] / sum(S.LETTERS) + (1 - S.PROSE) / 26) if c.isalpha() else math.log(0.1 if c.isdigit() else 0.5)
    grade = min(S.BINS, max(0, math.floor((-n * math.log(k) - log) * 4 / math.log(10))))
    return which * 100 + math.floor(math.log2(len(v) / 20)), grade, max(abs(z_chi), abs(z_runs), abs(z_serial)) <= S.Z


def brute_random(texts):
    """The method's own spans of each text: Benjamini-Hochberg over all runs, by encoding and length."""
    runs = [[(m.start(), m.end(), *battery(m[0])) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or "")] for t in texts]
    least = {}
    for g in {r[2] for own in runs for r in own}:
        bins = [r[3] for own in runs for r in own if r[2] == g]
        good = [b for b in bins if 10 ** (-b / 4) <= S.FALSE * sum(x >= b for x in bins) / len(bins)]
        least[g] = min(good, default=math.inf)
    return [[(b, e) for b, e, g, grade, ok in own if ok and grade >= least[g] and not any(x < e and b < y for x, _, y in brute(t))] for own, t in zip(runs, texts, strict=True)]


ALPHABETS = {"base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.9), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.9), "upper hex": ("0123456789ABCDEF", 0.9), "small letters and digits": ("abcdefghijklmnopqrstuvwxyz0123456789", 0.9), "capitals and digits": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.9), "capitals": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.9), "small letters": ("abcdefghijklmnopqrstuvwxyz", 0.9)}


def test_battery_equals_brute_force_and_finds_keys_of_each_encoding(spark):
    rnd = random.Random(8)
    ordinary = ["internationalization", "CamelCaseNamesOfClassesLikeThis", "a/path/of/some/folders/and/files", "THISISALONGLINEOFCAPITALS", "2024-01-15-12-30-45-000", "550e8400-e29b-41d4-a716-446655440000", "snake_case_names_of_variables", "=" * 30, "NEVERGONNAGIVEYOUUPNEVERGONNALETYOUDOWN"]
    keys = [(name, n, f"see {''.join(rnd.choices(letters, k=n))} there {rnd.choice(ordinary)}") for name, (letters, _) in ALPHABETS.items() for n in (24, 32, 40) for _ in range(30)]
    texts = [t for _, _, t in keys] + [f"{a} {b}" for a in ordinary for b in ordinary] + [None, ""]
    rows = {r.doc_id: r.spans for r in S.digest(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, want in enumerate(brute_random(texts)):
        assert [tuple(map(int, x.split(":")[1:])) for x in rows[i].split(",") if x.startswith("random")] == want, texts[i]
    for name, (_, recall) in ALPHABETS.items():
        found = [f"random:4:{4 + n}" in rows[i] for i, (own, n, _) in enumerate(keys) if own == name]
        assert sum(found) >= recall * len(found), (name, sum(found), len(found))
    assert not any("random" in rows[i] for i in range(len(keys), len(texts)))


def test_very_many_matches_in_one_text(spark):
    rnd = random.Random(9)
    parts = [rnd.choice(["token=abcdefgh", "".join(rnd.choices("0123456789abcdef", k=24)), "".join(rnd.choices(ALPHABETS["base64"][0], k=30)), "é🙂"]) for _ in range(30_000)]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = S.digest(df).first()
    want = brute(text)
    assert row.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in row.spans.split(","))
    out, at = [], 0
    for b, e in spans:
        if b >= at:
            out += [text[at:b], "[secret]"]
        at = max(at, e)
    assert S.mask(df).first().text == "".join(out) + text[at:]
