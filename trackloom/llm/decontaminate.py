"""Operator 2: benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``width`` words (all its words, if fewer). A document is hit wherever a window occurs,
word for word. A window is taken as the set of its shingles of up to ``shingle`` words at their offsets; exact
containment needs every one of them, so the necessary prefix of a window, in order of rarity over the corpus, is its one
rarest shingle. Documents are joined to windows on that shingle alone; the positional bound (the window, laid with its
shingle on the match, must lie within the text) and the length bound (a text shorter than the window has none) drop
candidates, and those left are verified word by word (64-bit hashes of all words of the window).

Rarity is counted over all documents, for the shingles that occur in items. The windows of a block of items are broadcast
only up to ``block_words`` words of them; a larger benchmark is cut into blocks of windows, each joined in turn, and the
blocks' spans are merged by text: only texts with a hit are shuffled, without their words.

Defined results: null, empty and wordless texts (documents or items) have no words and no hits; an item with a null
item_id is skipped; repeated items count once for each distinct item_id; repeated document rows are each reported; an
empty benchmark contaminates nothing. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, GRAM, Words, fits, grams, list_column, mix, text_blocks

WIDTH, SHINGLE, BLOCK_WORDS = 10, 3, 1_000_000


def windows(items: DataFrame, width: int = WIDTH, column: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, words array<long>): the distinct windows of each item, as hashes of their words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(key)
            for at, end, data, offsets in text_blocks(batch, column):
                w = Words(data, offsets, ALNUM)
                own, out = [], set()
                for i in range(at, end):
                    h = w.hashes[w.first[i - at] : w.first[i - at + 1]].view(np.int64)
                    for k in range(max(1, len(h) - width + 1) if len(h) else 0):
                        if (x := (ids[i].as_py(), h[k : k + width].tobytes())) not in out:
                            out.add(x)
                            own.append((i, h[k : k + width]))
                if own:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in own])), list_column(np.concatenate([h for _, h in own]), [len(h) for _, h in own])], names=["item_id", "words"])

    return items.where(F.col(key).isNotNull()).select(key, column).mapInArrow(run, "item_id long, words array<long>").distinct()


class Index:
    """The windows of a block, by their rarest shingle."""

    def __init__(self, rows: list[tuple[int, list[int]]], counts: dict[int, int], shingle: int = SHINGLE):
        by_window: dict[tuple[int, ...], list[int]] = {}
        for item, words in rows:
            by_window.setdefault(tuple(words), []).append(item)
        self.items = [sorted(set(x)) for x in by_window.values()]
        size = np.array([len(x) for x in by_window], np.int64)
        self.words = np.array([h for x in by_window for h in x], np.int64).view(np.uint64)
        self.begin, self.size = np.cumsum(size) - size, size
        lead, offset = np.zeros(len(size), np.uint64), np.zeros(len(size), np.int64)
        for i, (b, n) in enumerate(zip(self.begin.tolist(), size.tolist(), strict=True)):
            own = shingles(self.words[b : b + n], min(n, shingle))
            offset[i] = min(range(len(own)), key=lambda k: (counts.get(int(own[k].view(np.int64)), 0), int(own[k])))
            lead[i] = own[offset[i]]
        self.by_length = {}
        for q in np.unique(np.minimum(size, shingle)).tolist():
            own = np.flatnonzero(np.minimum(size, shingle) == q)
            order = own[np.argsort(lead[own], kind="stable")]
            self.by_length[q] = (lead[order], order)
        self.offset = offset

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of verified windows in a block of texts: number of the first word, number of the window."""
        places, found = [], []
        last = np.repeat(w.first[1:], np.diff(w.first))
        begin = np.repeat(w.first[:-1], np.diff(w.first))
        for q, (lead, order) in self.by_length.items():
            g = grams(w.hashes, q)
            lo = np.searchsorted(lead, g)
            at = np.flatnonzero((lead[np.minimum(lo, len(lead) - 1)] == g) & fits(w.first, q))
            if not len(at):
                continue
            lo, hi = lo[at], np.searchsorted(lead, g[at], "right")
            n = hi - lo
            at = np.repeat(at, n)
            window = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            first = at - self.offset[window]
            ok = (first >= begin[at]) & (first + self.size[window] <= last[at])  # positional and length bounds
            first, window = first[ok], window[ok]
            size = self.size[window]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = w.hashes[np.repeat(first, size) + inner] == self.words[np.repeat(self.begin[window], size) + inner]
            if len(first):
                ok = np.logical_and.reduceat(same, np.cumsum(size) - size)
                places.append(first[ok])
                found.append(window[ok])
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(found)) if places else (none, none)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    return grams(h, n)[: len(h) - n + 1]


def _count(docs: DataFrame, wanted, column: str) -> DataFrame:
    """(shingle, n): occurrences of the broadcast shingles over all documents; summed in each task before the shuffle."""

    def run(batches):
        total: dict[int, np.ndarray] = {q: np.zeros(len(x), np.int64) for q, x in wanted.value.items()}
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch, column):
                w = Words(data, offsets, ALNUM)
                for q, x in wanted.value.items():
                    g = grams(w.hashes, q)[fits(w.first, q)]
                    at = np.searchsorted(x, g)
                    at = at[x[np.minimum(at, len(x) - 1)] == g]
                    total[q] += np.bincount(at, minlength=len(x))
        for q, x in wanted.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(total[q])], names=["shingle", "n"])

    return docs.select(column).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, column: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, ``keep``, n_words, spans array<struct<first, last>> (words hit, last exclusive, merged), item_ids array<long>."""
    sc = docs.sparkSession.sparkContext
    found = windows(items, width).withColumn("n", F.size("words"))
    total = found.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    cut = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    same = "_same_text"
    schema = lambda cols: ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema.fields), "n_words long, spans array<struct<first:long,last:long>>, item_ids array<long>"])
    if blocks > 1:
        docs, keep = docs.withColumn(same, F.md5(F.col(column).cast("binary"))), (*keep, same)
    parts = []
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in found.where(cut == b).select("item_id", "words").collect()]  # about block_words words
        wanted: dict[int, set[int]] = {}
        for _, words in rows:
            q = min(len(words), shingle)
            wanted.setdefault(q, set()).update(shingles(np.array(words, np.int64).view(np.uint64), q).tolist())
        shared = sc.broadcast({q: np.array(sorted(x), np.uint64) for q, x in wanted.items()})
        counts = {r[0]: r[1] for r in _count(docs, shared, column).collect()} if rows else {}  # as many rows as the block has shingles
        carried = (same,) if b else (key, *keep)
        parts.append(_scan(docs, sc.broadcast(Index(rows, counts, shingle)), schema(carried), column, carried))
    if blocks == 1:
        return parts[0]
    # the first block's rows are the result's; of the others only texts with a hit are joined to them, once for each text
    more = [p.where(F.size("spans") > 0).groupBy(same).agg(F.first("spans").alias("s"), F.first("item_ids").alias("i")) for p in parts[1:]]
    every = more[0]
    for m in more[1:]:
        every = every.union(m)
    every = every.groupBy(same).agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("i")).alias("i"))
    merged = parts[0].join(every, same, "left").withColumns({"spans": F.array_sort(F.concat("spans", F.coalesce("s", F.array().cast("array<struct<first:bigint,last:bigint>>")))), "item_ids": F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("i", F.array().cast("array<bigint>")))))})
    return merged.withColumn("spans", merge_spans("spans")).select(key, *(c for c in keep if c != same), "n_words", "spans", "item_ids")


def merge_spans(spans: str):
    """Overlapping or touching spans of a sorted array made one."""
    return F.expr(f"""aggregate({spans}, cast(array() as array<struct<first:bigint,last:bigint>>), (a, x) -> if(size(a) > 0 and element_at(a, -1).last >= x.first,
        concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).first as first, greatest(element_at(a, -1).last, x.last) as last))), concat(a, array(x))))""")


def _scan(docs: DataFrame, index, schema: str, column: str, carried: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch, column):
                w = Words(data, offsets, ALNUM)
                first, window = index.value.hits(w)
                change = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + index.value.size[window], -1)
                hit = np.cumsum(change)[:-1] > 0
                opens = np.zeros(len(hit) + 1, bool)
                opens[w.first] = True
                heads = np.flatnonzero(hit & (opens[:-1] | ~np.concatenate([[False], hit[:-1]])))
                tails = np.flatnonzero(hit & (opens[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
                of = np.searchsorted(w.first, heads, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(heads - w.first[of]), pa.array(tails - w.first[of])], names=["first", "last"])
                n_spans = np.bincount(of, minlength=end - at)
                items: list[list[int]] = [[] for _ in range(end - at)]
                doc = np.searchsorted(w.first, first, "right") - 1
                for d, x in {*zip(doc.tolist(), window.tolist(), strict=True)}:
                    items[d] += index.value.items[x]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, end - at) for c in carried), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), spans), pa.array([sorted({*x}) for x in items], pa.list_(pa.int64()))],
                    names=[*carried, "n_words", "spans", "item_ids"],
                )

    return docs.select(*carried, *(() if column in carried else (column,))).mapInArrow(run, schema)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 (sorted as strings), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return find(docs, items).select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents in which no window occurs, with all their columns: those of ``docs``, in its order."""
    names = docs.columns
    own = docs.toDF(*(f"_c{i}" for i in range(len(names))))  # whatever they are called, no column clashes with those of find
    at = lambda name: f"_c{names.index(name)}"
    found = find(own, items, column=at("text"), key=at(key), keep=tuple(c for c in own.columns if c != at(key)))
    return found.where(F.size("spans") == 0).select(*own.columns).toDF(*names)
