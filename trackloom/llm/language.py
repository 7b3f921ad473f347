"""Operator 4: language ID by hierarchical discrimination.

A linear support vector machine per language family (one against the rest; one alone for two families) predicts the family;
within it, one-versus-one linear support vector machines separate closely related languages by votes, ties by margin.
Features are the shares of hashed byte trigrams of the whole text, A-Z lower-cased, so a score is one weight lookup and one
running sum over the bytes.

Training takes only text and non-null lang of rows that ``usable`` admits, at most about ``per_language`` whole texts of each
language and ``sample_rows`` in all, chosen by a hash of doc_id; of more languages than half of ``sample_rows``, the most frequent are learned. The machines are fitted on the driver by dual coordinate
descent over that bounded sample. lang, source and doc_id are never inputs of a prediction.

Defined results: a null text, or one without letters, is ``und`` with score 0; without usable labels every text is ``und``;
with one language only, that one is given. Repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, held_out, text_blocks

SIZE, PER_LANGUAGE, SAMPLE_ROWS = 4096, 500, 3000
#: Families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malay": "id jv ms su tl",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def slots(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that begins at each byte but the last two."""
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    h = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)


class Machine:
    """A linear support vector machine (squared hinge), by dual coordinate descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12):
        scale = 1 / (x.std(0) + 1e-5) / np.sqrt(x.shape[1])
        z = np.concatenate([(x * scale).astype(np.float32), np.ones((len(x), 1), np.float32)], 1)
        w, alpha, order = np.zeros(z.shape[1], np.float32), np.zeros(len(z)), np.random.default_rng(1)
        square = (z * z).sum(1) + 1 / (2 * cost)
        for _ in range(rounds):
            for i in order.permutation(len(z)):
                new = max(alpha[i] - (y[i] * float(w @ z[i]) - 1 + alpha[i] / (2 * cost)) / square[i], 0.0)
                w += np.float32((new - alpha[i]) * y[i]) * z[i]
                alpha[i] = new
        self.weights, self.bias = (w[:-1] * scale).astype(np.float64), float(w[-1])


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = np.array([FAMILY.get(lang, lang) for lang in langs])
        lang = np.array(langs)
        self.families = sorted(set(family.tolist()))
        alone = self.families[:1] if len(self.families) == 2 else self.families if len(self.families) > 2 else []
        self.tops = [(f, Machine(x, np.where(family == f, 1.0, -1.0))) for f in alone]
        self.pairs = []
        for f in self.families:
            own = sorted(set(lang[family == f].tolist()))
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    rows = (lang == a) | (lang == b)
                    self.pairs.append((f, a, b, Machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0))))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        slot = slots(data)
        begin, end = np.minimum(offsets[:-1], len(slot)), np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(slot))
        count = np.maximum(1, end - begin)

        def margin(m: Machine) -> np.ndarray:
            run = np.concatenate([[0.0], np.cumsum(m.weights[slot])])
            return (run[end] - run[begin]) / count + m.bias

        n = len(count)
        if len(self.tops) == 1:
            z = margin(self.tops[0][1])
            top, sure = np.where(z > 0, 0, 1), chance(np.abs(z))
        elif self.tops:
            z = np.stack([margin(m) for _, m in self.tops])
            top, sure = z.argmax(0), chance(z.max(0))
        else:
            top, sure = np.zeros(n, int), np.ones(n)
        out, score = np.empty(n, object), sure.copy()
        for k, f in enumerate(self.families):
            rows, own = top == k, self.members[f]
            votes, total, best = (np.zeros((len(own), n)) for _ in range(3))
            for of, a, b, m in self.pairs:
                if of == f and rows.any():
                    z, i, j = margin(m), own.index(a), own.index(b)
                    votes[i] += z > 0
                    votes[j] += z <= 0
                    total[i] += z
                    total[j] -= z
                    best[i] += chance(z)
                    best[j] += chance(-z)
            won = (votes + np.tanh(total / (len(own) + 1)) / 4).argmax(0)
            if len(own) > 1:
                score[rows] *= best[won[rows], np.flatnonzero(rows)] / (len(own) - 1)
            out[rows] = np.array(own, object)[won[rows]]
        return out.tolist(), np.round(score, 9)  # running sums differ in the last digits by where a text lies


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(z, -8, 8)))


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(h, text, lang): at most about ``per_language`` labelled rows of each language, ``rows`` in all."""
    known = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows // 2 + 1).collect()  # one row for each language
    if len(counts) > rows // 2:
        raise ValueError(f"more than {rows // 2} languages: a sample of {rows} rows has under two of each; raise ``rows``")
    each = max(2, min(per_language, rows // max(1, len(counts))))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1_000_000, int(1e6 * each / r[1]) + 1)))) if counts else F.create_map(F.lit(""), F.lit(0))
    picked = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")]
    return known.where(picked).select(F.xxhash64(F.lit(5), "doc_id").alias("h"), "text", "lang")


def train(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model | None:
    """The machines; at most 2 * ``rows`` rows of features, the first by hash, come to the driver."""

    def features(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in text_blocks(batch):
                for b, e in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                    n = np.bincount(slots(data[b:e]), minlength=SIZE)
                    out.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(out, pa.binary())], names=["h", "lang", "x"])

    found = sample(docs, usable, rows=rows).mapInArrow(features, "h long, lang string, x binary").orderBy("h", "lang", F.xxhash64("x")).limit(2 * rows)
    rows = sorted((r[0], r[1], bytes(r[2])) for r in found.collect())
    return Model(np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), SIZE), [r[1] for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, column: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in into]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + [f"`{into[0]}` string, `{into[1]}` double"])

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch, column):
                low = LOWER[data]
                letters = np.concatenate([[0], np.cumsum((low > 96) & (low < 123))])
                some = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~some).tolist():
                    some[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                langs, score = shared.value.predict(data, offsets) if shared.value else (["und"] * (end - at), np.zeros(end - at))
                langs = [x if ok else "und" for x, ok in zip(langs, some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in names), pa.array(langs, pa.string()), pa.array(np.where(some, score, 0.0))], names=[*names, *into])

    return docs.select(*names).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs, ~F.coalesce(held_out(), F.lit(True)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
