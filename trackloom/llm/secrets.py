"""Operator 10: secret scans, in DataFrame functions only.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The battery adds ``random`` spans: maximal runs of 20 or more
characters of the encodings' alphabets that look drawn at random. Of each run the encoding is inferred (hex, letters of one case, base32, letters of one case with digits, or base64) and
tested: chi-squared uniformity over that alphabet, the number of runs about the middle of the alphabet, and the serial
correlation of neighbours; a random string fails none of them (|z| at most ``Z``).

Ordinary long words may pass by luck, more easily when short, so discoveries are controlled. Under "ordinary", letters, digits,
capitals and signs change places at a low rate and letters are as frequent as in prose; under "random", all characters of the inferred
alphabet are equally likely. An ordinary run has a likelihood ratio of 1 / p or more with a chance of p at most (Markov's bound), which
gives each run its p-value. All runs of the table are counted by encoding, length class and p-value bin, and the Benjamini-Hochberg
rule picks each group's bin at ``FALSE`` expected false discoveries. The counts are an aggregate of a fixed number of bins, so nothing
grows with the data but the scan.

Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows and ties are reported as they
are; an empty table gives an empty result. Runs of signs alone (a line of "=") are no strings of an encoding and are never found.
A text's matches are worked on in blocks of BLOCK, so that very many cost little more than their number.
``mask`` and ``find`` keep all columns of their input but for those they set (names that begin with two underscores are theirs).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of the pattern with "+" in place of the least length, if long enough, is a match of these, and the reverse.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
Z, FALSE, CHANGE, BINS = 3.0, 0.01, 0.1, 400
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Per cent of the letters a to z in English prose.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Share of prose in the ordinary model's letters; the others are equally likely.
PROSE = 0.9
#: Elements of an array that are copied at once.
BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value), with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _blocks(values: Column) -> Column:
    """Where the blocks of an array begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(BLOCK))


def _before(values: Column, merge) -> Column:
    """The fold, from 0, of all values before each one."""

    def within(first: Column, part: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        totals = F.transform(_blocks(v), lambda b: F.aggregate(F.slice(v, b, BLOCK), F.lit(0), merge))
        return _let(within(F.lit(0), totals), lambda firsts: F.flatten(F.transform(_blocks(v), lambda b, i: within(F.get(firsts, i), F.slice(v, b, BLOCK)))))

    return _let(values, whole)


def _fold(pieces: Column, found: Column, kind: int) -> Column:
    """Spans of the matches ``found`` between ``pieces``: offsets are running sums of lengths."""
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m"))
    starts = _before(F.transform(steps, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, x: a + x)

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["p"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    return F.zip_with(steps, starts, span)


def _spans(df: DataFrame, text: str, into: str, pattern: str, kind: int, unless: Column | None = None, group: int = 0, least: int = 0) -> DataFrame:
    """``df`` with ``into``: spans of the leftmost matches of ``pattern`` that don't overlap, if group ``group`` has ``least`` characters.

    unless: a cheap test that is true only of texts without a match. Matches are a column of their own, so that the
    pattern runs once over a text.
    """
    m, p, g = f"{into}_m", f"{into}_p", f"{into}_g"
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(m, found if unless is None else F.when(unless, none).otherwise(found))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(into, F.when(F.size(m) > 0, _fold(F.col(p), F.col(m), kind)).otherwise(F.array().cast(SPAN)))
    if least:
        df = df.withColumn(g, F.when(F.size(m) > 0, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).otherwise(none))
        df = df.withColumn(into, F.transform(F.filter(F.arrays_zip(F.col(into).alias("s"), F.col(g).alias("v")), lambda x: F.length(x["v"]) >= least), lambda x: x["s"])).drop(g)
    return df.drop(m, p)


#: The alphabets of the encodings, in the order in which they are inferred: the first that holds the whole run. A pattern of the run, and the alphabet
#: that its characters, in small letters where ``folded``, are taken from.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", True),
    ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", True),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", False),
    ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", True),
    ("^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
)


def _first(value: Column, of) -> Column:
    """``of`` the first encoding whose pattern the run ``value`` has."""
    out = of(ENCODINGS[-1])
    for encoding in reversed(ENCODINGS[:-1]):
        out = F.when(value.rlike(encoding[0]), of(encoding)).otherwise(out)
    return out


def _neighbours(x: Column) -> tuple[Column, Column]:
    return F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 1)), F.slice(x, 2, F.size(x))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def _signs(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


# The tests of a run, in layers: each may use the fields of those before it, through ``get``.


def _inferred(get) -> dict[str, Column]:
    v = get("value")
    text = F.regexp_replace(F.translate(v, "-_", "+/"), "=", "")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "-_/=", "+++")
    return {"alphabet": _first(v, lambda e: F.lit(e[1])), "encoding": _first(v, lambda e: F.lit(ENCODINGS.index(e))), "body": F.when(_first(v, lambda e: F.lit(e[2])), F.lower(text)).otherwise(text), "kinds": kinds}


def _coded(get) -> dict[str, Column]:
    alphabet, body = get("alphabet"), get("body")
    return {"n": F.greatest(F.lit(2), F.length(body)), "k": F.length(alphabet), "codes": F.transform(_signs(body), lambda x: F.position(x, alphabet) - 1)}


def _measured(get) -> dict[str, Column]:
    codes, k = get("codes"), get("k").cast("double")
    letters = [math.log(PROSE * x / sum(LETTERS) + (1 - PROSE) / 26) for x in LETTERS]
    prose = F.array(*(F.lit(x) for x in letters + [math.log(1 / 10)] * 10 + [math.log(1 / 2)] * 2))
    return {
        "high": F.transform(codes, lambda x: (2 * x >= k).cast("int")),
        "mean": _total(codes) / get("n"),
        "changes": F.size(F.filter(F.zip_with(*_neighbours(_signs(get("kinds"))), lambda a, b: a != b), lambda x: x)),
        "plain": _let(prose, lambda p: F.transform(_signs(F.lower(get("body"))), lambda x: F.get(p, F.position(x, F.lit("abcdefghijklmnopqrstuvwxyz0123456789+/")) - 1))),
    }


def _counted(get) -> dict[str, Column]:
    codes, high, mean = get("codes"), get("high"), get("mean")
    return {
        "up": _total(high),
        "vary": F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)),
        "runs": F.size(F.filter(F.zip_with(*_neighbours(high), lambda a, b: a != b), lambda x: x)) + 1,
        "square": F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(codes, lambda y: y == x)), F.lit(2))),
    }


def _graded(get) -> dict[str, Column]:
    n, k, up, mean, vary = get("n").cast("double"), get("k").cast("double"), get("up"), get("mean"), get("vary")
    excess = F.greatest(F.lit(1e-9), get("square") * k / n - n) / (k - 1)
    expected = 1 + 2 * up * (n - up) / n
    spread = F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1)))
    changes, steps = get("changes"), F.greatest(F.lit(0), F.length(get("kinds")) - 1)
    ordinary = _total(get("plain")) + changes * math.log(CHANGE / 3) + (steps - changes) * math.log(1 - CHANGE) + math.log(1 / 4)
    evidence = -n * F.log(k) - ordinary
    return {
        "z_chi": (F.pow(excess, F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))),
        "z_runs": F.when((up > 0) & (up < n), (get("runs") - expected) / spread).otherwise(F.lit(99.0)),
        "z_serial": F.when(vary > 0, _total(F.zip_with(*_neighbours(get("codes")), lambda a, b: (a - mean) * (b - mean))) / vary * F.sqrt(n - 1)).otherwise(F.lit(99.0)),
        "bin": F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(evidence * (4 / math.log(10))))).cast("int"),
        "group": (100 * get("encoding") + F.floor(F.log2(F.length(get("value")) / 20))).cast("int"),
    }


def _judged(get) -> dict[str, Column]:
    return {"passes": (F.abs(get("z_chi")) <= Z) & (F.abs(get("z_runs")) <= Z) & (F.abs(get("z_serial")) <= Z)}


LAYERS = (_inferred, _coded, _measured, _counted, _graded, _judged)


def _runs(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with ``into``: its candidate runs and their tests, as an array of structs."""
    df = _spans(df, text, into, RUN, 3)
    fields = ["start", "end", "value"]
    for layer in LAYERS:
        more: list[str] = []
        df = df.withColumn(into, F.transform(into, _with(layer, ["start", "end", "bin", "group"] if layer is _judged else fields, more)))
        fields = fields + more
    return df


def _with(layer, keep: list[str], made: list[str]):
    """A run's struct with the fields ``keep`` and those of ``layer``, whose names go to ``made``."""

    def struct(r: Column) -> Column:
        tests = layer(lambda name: r[name])
        made[:] = tests
        return F.struct(*(r[f].alias(f) for f in keep), *(x.alias(f) for f, x in tests.items()))

    return struct


def limits(df: DataFrame, column: str = "text") -> dict[int, int]:
    """By encoding and length class, the least bin of p-values that Benjamini-Hochberg accepts. At most some 80 groups of BINS bins."""
    rows = _runs(df.select(F.coalesce(column, F.lit("")).alias("t")), "t", "r").select(F.explode("r").alias("r"))
    counted = rows.groupBy("r.group", "r.bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy("group").orderBy(F.desc("bin"))
    ranked = counted.withColumns({"above": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("group"))})
    good = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 4) <= FALSE * F.col("above") / F.col("all"))
    return {r[0]: r[1] for r in good.groupBy("group").agg(F.min("bin")).collect()}


def find(df: DataFrame, column: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with ``into``: array<struct<start, kind, end>>, sorted; kind is an index of KINDS."""
    least = F.create_map(*(F.lit(x) for pair in (limits(df, column) or {-1: 0}).items() for x in pair))
    new = lambda name: f"__{into}_{name}"
    t, text = new("t"), F.col(new("t"))
    df = df.withColumn(t, F.coalesce(column, F.lit("")))
    df = _spans(df, t, new("assign"), ASSIGN, 0, ~text.rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"), 2, 6)
    df = _spans(df, t, new("access"), ACCESS, 1, ~text.contains("AKIA"))
    df = _spans(df, t, new("hex"), HEX, 2)
    df = _runs(df, t, new("run"))
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    df = df.withColumn(new("base"), F.transform(F.concat(new("assign"), new("access"), new("hex")), plain))
    chosen = F.filter(new("run"), lambda r: r["passes"] & (r["bin"] >= least[r["group"]]))
    meet = lambda x, first, last: (x["start"] < last["end"]) & (first["start"] < x["end"])

    def apart(part: Column) -> Column:  # runs of a block meet only base spans of its stretch of text
        about = F.filter(new("base"), lambda b: meet(b, F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)))
        return _let(about, lambda near: F.filter(part, lambda r: ~F.exists(near, lambda b: meet(b, r, r))))

    chosen = _let(chosen, lambda runs: F.flatten(F.transform(_blocks(runs), lambda b: _let(F.slice(runs, b, BLOCK), apart))))
    more = F.transform(chosen, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    df = df.withColumn(into, F.array_sort(F.concat(new("base"), more)))
    return df.drop(t, *(new(x) for x in ("assign", "access", "hex", "run", "base")))


def label(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def mask(df: DataFrame, column: str = "text", by: str = "[secret]") -> DataFrame:
    """``df`` with each run of overlapping spans of ``column`` replaced; null texts stay null."""
    spans = "__spans"
    df = find(df, column, spans)
    text, ends = F.col(column), F.transform(spans, lambda x: x["end"])
    steps = F.arrays_zip(F.col(spans).alias("s"), _before(ends, lambda a, x: F.greatest(a, x)).alias("c"))  # c: where the spans before end

    def cut(part: Column) -> Column:
        first = F.get(part, F.lit(0))["c"]
        stretch = F.struct(first.alias("at"), F.substring(text, first + 1, F.get(part, F.size(part) - 1)["s"]["start"] - first).alias("text"))
        piece = lambda x, t: F.when(x["s"]["start"] >= x["c"], F.concat(F.substring(t["text"], x["c"] - t["at"] + 1, x["s"]["start"] - x["c"]), F.lit(by))).otherwise("")
        return _let(stretch, lambda t: F.array_join(F.transform(part, lambda x: piece(x, t)), ""))

    parts = _let(steps, lambda s: F.transform(_blocks(s), lambda b: _let(F.slice(s, b, BLOCK), cut)))
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return df.withColumn(column, F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)).drop(spans)


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = label(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(base.cast("binary"), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"))
