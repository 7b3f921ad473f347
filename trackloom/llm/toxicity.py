"""Operator 5: toxicity from a lexicon, with misspellings and context.

The lexicon is learned: stems (beginnings of words, or whole words) that occur far oftener in texts labelled toxic than in
the others of a bounded sample of labelled documents (``sample_rows``; whole texts), and in a fiftieth of its toxic texts (so that they
are 50 times the distinct stems of a toxic text at most), each with its log ratio, joined to the seeds that the caller gives. Words
of three letters are stems only as a whole, and are found only as they are. The lexicon is kept as a trie. A word is looked up by walking
the trie: exactly, for a term that it equals or inflects; else with the Levenshtein automaton of the word, whose states
are (letters consumed, errors), leaving a branch of the trie as soon as no state is alive.
A word within its distance of a term shares one of a few pieces with it, nearly all letters and the length, so lookups over
the block skip all others before the automaton is built; results are cached by word.

A misspelling counts by how it behaves in the sample: variants seen in clean texts are ordinary words that happen to be
near a term and get no weight. Each match is scored in its context window: a match inside quotation marks, or near a word
of reporting, is a quotation; near an address ("you"), abuse. A logistic model over those counts gives the score.

Labels, lang, source and doc_id are never inputs of a score. Null and empty texts score as a text without matches.
Repeated rows are scored each; equal texts with different labels train as toxic; an empty table gives an empty result; with no usable labels the seeds' weights are the
prior's, and every text without a match scores below one half. Only doc_id and text (and labels in training) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget
from .shared import ALNUM, Words, held_out, stow, text_blocks

SAMPLE_ROWS, SUPPORT = 8_000, 4
#: A seed's log ratio.
SEED = 4.0
#: Words near a match that tell quotation from abuse.
REPORTING = ("said", "says", "called", "calling", "quote", "quoted", "wrote", "term", "word", "phrase", "reported")
ADDRESS = ("you", "your", "youre", "u", "ur")
#: Quotation marks, as UTF-8.
QUOTES = tuple(q.encode() for q in '"“”«»„')
WINDOW = 60
FEATURES = 6


def triple(a, b, c):
    """A 16-bit code of three letters."""
    return (a * 961 + b * 31 + c * 7919) & 0xFFFF


def letters(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The set of letters, as bits, of each word that begins at ``starts`` in its own joined bytes."""
    return np.bitwise_or.reduceat(np.uint32(1) << (text & 31).astype(np.uint32), starts)


class Lexicon:
    """A trie of terms, walked by the Levenshtein automaton of a word."""

    def __init__(self, terms):
        self.terms = sorted({t.encode() for t in terms if len(t.encode()) > 2})
        self.trie: list[dict[int, int]] = [{}]
        self.term: dict[int, bytes] = {}
        for t in self.terms:
            at = 0
            for c in t:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                at = self.trie[at][c]
            self.term[at] = t
        # a term with d errors keeps one of its d + 1 pieces whole: its beginning, its end, or (d = 2) one after the beginning
        self.begins2, self.begins, self.inner, self.ends, self.stems, self.short = (np.zeros(1 << 16, bool) for _ in range(6))
        for t in self.terms:
            if len(t) == 3:
                self.short[triple(*t)] = True
                continue
            self.stems[triple(t[0], t[1], t[2]) ^ t[3] << 8] = True
            if len(t) < 6:
                self.begins2[t[0] << 8 | t[1]] = True
            else:
                self.begins[triple(t[0], t[1], t[2])] = True
            if self.errors(len(t)):
                self.ends[triple(*t[-3:])] = True
            if self.errors(len(t)) == 2:
                self.inner[triple(*t[3:6])] = True
        self.masks = [(len(t), self.errors(len(t)), letters(np.frombuffer(t, np.uint8), np.zeros(1, np.int64))[0]) for t in self.terms if len(t) > 3]
        self.longest = max(map(len, self.terms), default=0)
        self.shortest = min(map(len, self.terms), default=0)

    @staticmethod
    def errors(n: int) -> int:
        """Errors allowed in a term of n bytes."""
        return 0 if n < 5 else 1 if n < 9 else 2

    def near(self, word: bytes) -> tuple[bytes, int] | None:
        """The longest term that the word equals or begins with, and 0; else the nearest term and its distance (ties: the first term)."""
        at, found = 0, None
        for c in word:
            at = self.trie[at].get(c)
            if at is None:
                break
            if at in self.term and (len(self.term[at]) > 3 or len(word) == 3):
                found = self.term[at]
        if found is not None:
            return found, 0
        most, best = self.errors(self.longest), None
        walk = [(0, close({(0, 0)}, len(word), most))]
        while walk:
            node, states = walk.pop()
            t = self.term.get(node)
            if t is not None:
                ends = [e for i, e in states if i == len(word)]
                if ends and min(ends) <= self.errors(len(t)) and (best is None or (min(ends), t) < (best[1], best[0])):
                    best = (t, min(ends))
            for c, child in self.trie[node].items():
                if after := step(states, c, word, most):
                    walk.append((child, after))
        return best


def close(states: set, n: int, most: int) -> frozenset:
    """Adds what deleting letters of the word reaches."""
    out = set(states)
    for i, e in states:
        for d in range(1, min(most - e, n - i) + 1):
            out.add((i + d, e + d))
    return frozenset(out)


def step(states: frozenset, c: int, word: bytes, most: int) -> frozenset:
    """The automaton of ``word`` after one more letter of a term."""
    out = set()
    for i, e in states:
        if i < len(word) and word[i] == c:
            out.add((i + 1, e))
        if e < most:
            out.add((i, e + 1))
            if i < len(word):
                out.add((i + 1, e + 1))
    return close(out, len(word), most) if out else frozenset()


class Matcher:
    """Finds the matches of a block of texts and counts them by kind. terms: log ratio by term."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[bytes] | None = None):
        self.lexicon, self.ordinary = Lexicon(terms), ordinary
        self.ratio = {t.encode(): float(x) for t, x in terms.items()}
        self.cache: dict[bytes, tuple[bytes, int] | None] = {}

    def matches(self, w: Words) -> list[tuple[int, bytes, int, bytes]]:
        """(number of the word, word, distance, term)."""
        lex = self.lexicon
        at = np.flatnonzero(w.ends - w.starts >= max(3, lex.shortest - 2))
        if not lex.terms or not len(at):
            return []
        b, e = w.starts[at], w.ends[at]
        code = w.low.astype(np.int64)
        head = triple(code[b], code[b + 1], code[b + 2])
        stem = (e - b > 3) & lex.stems[head ^ code[np.minimum(b + 3, len(code) - 1)] << 8] | (e - b == 3) & lex.short[head]
        keep = lex.begins2[code[b] << 8 | code[b + 1]] | lex.begins[head] | lex.ends[triple(code[e - 3], code[e - 2], code[e - 1])]
        if lex.inner.any():
            for k in range(1, 6):
                x = np.minimum(b + k, e - 3)
                keep |= lex.inner[triple(code[x], code[x + 1], code[x + 2])]
        keep = stem | keep & (e - b <= lex.longest + 2)
        at, b, e, stem = at[keep], b[keep], e[keep], stem[keep]
        if not len(at):
            return []
        n = e - b
        skip = np.cumsum(n) - n
        mask = letters(w.low[np.repeat(b - skip, n) + np.arange(n.sum())], skip)
        keep = stem
        for length, errors, own in lex.masks:  # an error changes the set of letters by two at most
            keep |= (np.abs(n - length) <= errors) & (np.bitwise_count(mask ^ own) <= 2 * errors)
        at, b, e = at[keep], b[keep], e[keep]
        text, out, cache = w.low.tobytes(), [], self.cache
        for k, x, y in zip(at.tolist(), b.tolist(), e.tolist(), strict=True):
            word = text[x:y]
            if word not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[word] = lex.near(word)
            if (hit := cache[word]) is not None and (hit[1] == 0 or self.ordinary is None or word not in self.ordinary):
                out.append((k, word, hit[1], hit[0]))
        return out

    def features(self, w: Words, offsets: np.ndarray) -> np.ndarray:
        """Per text, of its matches: log ratios of abuse, their logarithm, misspelled abuse, quotations, addressed abuse, log ratios for its length."""
        found = self.matches(w)
        x = np.zeros((len(offsets) - 1, FEATURES), np.float32)
        if found:
            text = w.low.tobytes()
            doc = np.searchsorted(w.first, np.array([m[0] for m in found]), "right") - 1
            for (k, _, far, term), d in zip(found, doc.tolist(), strict=True):
                b, e, lo, hi = int(w.starts[k]), int(w.ends[k]), int(offsets[d]), int(offsets[d + 1])
                before, after = text[max(lo, b - WINDOW) : b], text[e : min(hi, e + WINDOW)]
                beside = {text[w.starts[j] : w.ends[j]].decode("utf-8", "replace") for j in range(max(int(w.first[d]), k - 4), min(int(w.first[d + 1]), k + 5)) if j != k}
                if within_quotes(before, after) or beside.intersection(REPORTING):
                    x[d, 3] += 1
                else:
                    x[d, 0] += self.ratio[term] / (1 + far)
                    x[d, 2] += far > 0
                    x[d, 4] += bool(beside.intersection(ADDRESS))
            n = np.diff(w.first)
            x[:, 1] = np.log1p(x[:, 0])
            x[:, 2:5] = np.log1p(x[:, 2:5])
            x[:, 5] = np.log1p(1000 * x[:, 0] / (n + 50))
            x[:, 0] = np.minimum(x[:, 0], 40) / 10
        return x


def within_quotes(before: bytes, after: bytes) -> bool:
    """Whether a quotation mark opens before the match, in its line, and one closes after it."""
    before, after = before[before.rfind(b"\n") + 1 :], after.split(b"\n", 1)[0]
    if before.count(QUOTES[0]) % 2 and QUOTES[0] in after:
        return True
    return any(before.rfind(a) > before.rfind(z) and z in after for a, z in ((QUOTES[1], QUOTES[2]), (QUOTES[3], QUOTES[4]), (QUOTES[5], QUOTES[1])))


class Model:
    def __init__(self, matcher: Matcher, weights: np.ndarray):
        self.matcher, self.weights = matcher, weights

    def scores(self, w: Words, offsets: np.ndarray) -> np.ndarray:
        x = self.matcher.features(w, offsets).astype(np.float64)
        return 1 / (1 + np.exp(-(x @ self.weights[1:] + self.weights[0])))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``rows`` labelled documents that are not held out, spread by a hash of doc_id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    order = F.xxhash64(F.lit(11), "doc_id")
    picked = usable.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(order, "doc_id", "toxic").limit(2 * rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")  # at most 2 * rows rows


def _stems(sample: DataFrame) -> DataFrame:
    """(stem, toxic, n, d): occurrences and texts of each beginning of 4 to 10 letters and each whole word of 3 or more, summed in each task."""

    def run(batches):
        n: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for at, end, data, offsets in text_blocks(batch):
                w = Words(data, offsets, ALNUM, hashes=False)
                text = w.low.tobytes()
                for i in range(at, end):
                    k, own = slice(int(w.first[i - at]), int(w.first[i - at + 1])), {}
                    for b, e in zip(w.starts[k].tolist(), w.ends[k].tolist(), strict=True):
                        word = text[b:e].decode("utf-8", "replace")
                        for size in {*range(4, min(11, len(word))), len(word)} if len(word) > 2 else ():
                            own[word[:size]] = own.get(word[:size], 0) + 1
                    for stem, m in own.items():
                        x = n.setdefault((stem, toxic[i]), [0, 0])
                        x[0] += m
                        x[1] += 1
                if len(n) > 100_000:
                    yield made(n)
                    n = {}
        yield made(n)

    def made(n):
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in n], pa.string()), pa.array([t for _, t in n], pa.int32()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["stem", "toxic", "n", "d"])

    return sample.mapInArrow(run, "stem string, toxic int, n long, d long")


def learn_terms(sample: DataFrame, support: int = SUPPORT, ratio: float = 2.5) -> dict[str, float]:
    """Stems with a log ratio of occurrences of at least ``ratio``, in at least ``support`` and a fiftieth of the toxic texts."""
    length = F.length("text") + 1
    of = sample.agg(F.sum("toxic"), F.sum(F.when(F.col("toxic") == 1, length)), F.sum(F.when(F.col("toxic") == 0, length))).first()
    toxic, much, rest = (float(x or 1) for x in of)
    counted = _stems(sample).groupBy("stem").agg(*(F.sum(F.when(F.col("toxic") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in "nd"))
    score = F.log((F.col("n1") + 0.5) / much) - F.log((F.col("n0") + 0.5) / rest)
    best = counted.where(F.col("d1") >= max(support, toxic / 50)).withColumn("x", score).where(F.col("x") >= ratio)
    found = {r["stem"]: (r["d1"], r["x"]) for r in best.select("stem", "d1", "x").collect()}  # at most 50 times the distinct stems of a toxic text of the sample
    beginnings = lambda s: [s[:n] for n in range(4, len(s)) if s[:n] in found]
    lost = {s for t in found for s in beginnings(t) if found[t][0] >= 0.9 * found[s][0]}  # of nested stems: the longest that loses few texts, and none that it covers
    kept = [s for s in found if s not in lost and all(t in lost for t in beginnings(s))]
    return {s: found[s][1] for s in sorted(kept, key=lambda s: (-found[s][0], s))}


def train(docs: DataFrame, labels: DataFrame, seeds=(), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample; the lexicon, the ordinary variants of the sample and seven weights come to the driver."""
    sample = stow(labelled_sample(docs, labels, sample_rows).groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    terms = {s: SEED for s in seeds} | learn_terms(sample)
    plain = docs.sparkSession.sparkContext.broadcast(Matcher(terms))

    def near_words(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            out, of = [], []
            for at, _, data, offsets in text_blocks(batch):
                w = Words(data, offsets, ALNUM, hashes=False)
                found = [(k, word) for k, word, far, _ in plain.value.matches(w) if far]
                doc = np.searchsorted(w.first, [k for k, _ in found], "right") - 1
                for d, word in {*zip(doc.tolist(), (x for _, x in found), strict=True)}:
                    out.append(word)
                    of.append(toxic[at + d])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.int32())], names=["word", "toxic"])

    seen = sample.mapInArrow(near_words, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    clean = seen.where(F.col("n") - F.col("t") > F.col("t") / 2).select("word")
    matcher = Matcher(terms, frozenset(bytes(r[0]) for r in clean.collect()))  # words of the bounded sample that are near a term
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    def rows(batches):
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch):
                x = shared.value.features(Words(data, offsets, ALNUM, hashes=False), offsets)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("toxic").slice(at, end - at)], names=["x", "toxic"])

    fitted = sample.mapInArrow(rows, "x binary, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()
    forget(sample)
    x = np.array([np.frombuffer(bytes(r[0]), np.float32) for r in fitted], np.float64).reshape(-1, FEATURES)
    return Model(matcher, fit(x, np.array([r[1] for r in fitted], np.float64), np.array([r[2] for r in fitted], np.float64)))


#: Weights before any label is seen: rarely toxic without a match, likely with an unquoted one.
PRIOR = np.array([-3.0, 1.0, 1.0, 0.5, -0.5, 0.5, 0.5])


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    w, x = PRIOR.copy(), np.concatenate([np.ones((len(x), 1)), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * (w - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: 0 to 1, higher where toxic is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != into]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + [f"`{into}` double"])

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch):
                s = shared.value.scores(Words(data, offsets, ALNUM, hashes=False), offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in names), pa.array(s)], names=[*names, into])

    return docs.select(*names).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.7) -> DataFrame:
    """The documents that score below ``most``, with their columns."""
    names = docs.columns
    temp = "_score"
    while temp in names:
        temp += "_"
    return score(docs, train(docs, labels), temp).where(F.col(temp) < most).select(*names)
