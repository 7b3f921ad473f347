"""Operator 11: how the words of each source differ from those of the other sources and of its whole language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that at least ``LEAST`` of its
documents (rows) hold; all counts are over all documents, and all arithmetic is in integers.

Iceberg prefix refinement finds the kept terms without grouping the whole terms of every text:

1. Texts are read once, in blocks of about ``BLOCK`` bytes. A block gives, for each language and each of the levels 1, 2, 4, 8, ..., the
   terms' byte prefixes of that length with the number of its documents that hold one (exact; a document lies in one block, so
   these numbers add up), and for each whole term the occurrences and documents of each source.
2. Level by level, only prefixes that extend a kept prefix of the level before are summed over the blocks, and those in fewer than
   ``LEAST`` documents are discarded, until no level is left.
3. Only whole terms whose longest prefix was kept are shuffled; their documents are summed and the same threshold decides.

Of a group (language and source) and of a language each kept term has p = 1 + floor(1e9 * (count + 1) / (N + V)). The sum of
f = floor((p - q) ** 2 / q) over all kept terms is taken for each pair of a language's sources in cells: a block of about ``TERMS``
kept terms meets two tiles of ``TILE`` sources, so that a cell is bounded however many terms and sources there are, and gives
one partial sum a pair. Terms that neither tile holds are equal summands, counted and added at the end.

Rows are dealt by language and prefix, never by language or source alone, so a source with a third of all documents is no hot key: a term
has one row a block. Memory follows the block or the longest text.

Null text, language or source count as empty; a document without terms still makes its group; repeated rows are documents each;
ties in value go by the item's UTF-8 bytes; a language without kept terms gives pairs of value 0; an empty table gives no rows. Only text,
lang and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, shared_path
from .shared import Words, stow

LEAST, TOP, BLOCK, TERMS, TILE, UNIT = 3, 200, 16 << 20, 4096, 64, 1_000_000_000
#: a-z and any non-ASCII byte, after lower-casing.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
ROWS = "level int, lang string, term binary, n long, held array<struct<source:string,occurs:long,docs:long>>"


def _table(levels: int, lang, term, n, held=None) -> pa.RecordBatch:
    count = len(n)
    kind = pa.list_(pa.struct([("source", pa.string()), ("occurs", pa.int64()), ("docs", pa.int64())]))
    columns = [pa.array(np.full(count, levels, np.int32)), lang, term, pa.array(n, pa.int64()), held if held is not None else pa.nulls(count, kind)]
    return pa.RecordBatch.from_arrays([*columns[:2], columns[2].cast(pa.binary()), columns[3], columns[4].cast(kind)], names=["level", "lang", "term", "n", "held"])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, size: int) -> np.ndarray:
    return np.append(starts[1:], size)


def block_rows(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Iterator[pa.RecordBatch]:
    """The prefixes (level 1, 2, 4, ...) and the whole terms (level 0) of a block of documents."""
    order = pc.sort_indices(pa.table({"l": langs, "s": sources}), sort_keys=[("l", "ascending"), ("s", "ascending")])
    texts, langs, sources = (x.take(order) for x in (texts, langs, sources))
    size = len(texts)
    lang = langs.dictionary_encode().indices.to_numpy()  # in order, as the rows are
    group = np.zeros(size, np.int64)
    group[_starts(lang, sources.dictionary_encode().indices.to_numpy())] = 1
    group = np.cumsum(group) - 1
    raw = texts.cast(pa.large_binary())
    _, where, what = raw.buffers()
    offsets = np.frombuffer(where, np.int64)[raw.offset : raw.offset + size + 1]
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    words = Words(data, offsets - offsets[0], LETTERS, hashes=False)
    if not len(words.starts):
        return
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    letters = words.low[LETTERS[words.low]]
    coded = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    by_bytes = pc.sort_indices(coded.dictionary)
    terms = coded.dictionary.take(by_bytes)
    place = np.empty(len(terms), np.int64)
    place[by_bytes.to_numpy()] = np.arange(len(terms))
    pair, occurs = np.unique(place[coded.indices.to_numpy()] * size + np.repeat(np.arange(size), np.diff(words.first)), return_counts=True)
    del words, letters, coded
    term, doc = pair // size, pair % size
    _, where, what = terms.buffers()
    begin = np.frombuffer(where, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data, length = np.frombuffer(what, np.uint8), np.diff(begin)
    level = 1
    while len(long := np.flatnonzero(length >= level)):
        prefix = data[begin[long][:, None] + np.arange(level)]
        new = np.ones(len(long), bool)
        new[1:] = (prefix[1:] != prefix[:-1]).any(1)  # terms are sorted: those of one prefix stand together
        number = np.full(len(terms), -1)
        number[long] = np.cumsum(new) - 1
        of = number[term]
        held = np.unique(of[of >= 0] * size + doc[of >= 0])
        of, within = held // size, lang[held % size]
        at = _starts(of, within)
        bytes_ = pa.array(np.ascontiguousarray(prefix[new]).view(f"S{level}").ravel().tolist(), pa.binary())  # letters hold no zero bytes
        yield _table(level, langs.take(pa.array(held[at] % size)), bytes_.take(pa.array(of[at])), _ends(at, len(held)) - at)
        level *= 2
    at = _starts(term, group[doc])
    held = pa.StructArray.from_arrays([sources.take(pa.array(doc[at])), pa.array(np.add.reduceat(occurs, at), pa.int64()), pa.array(_ends(at, len(term)) - at, pa.int64())], names=["source", "occurs", "docs"])
    row = _starts(term[at], lang[doc[at]])
    docs = _ends(at[row], len(term)) - at[row]
    yield _table(0, langs.take(pa.array(doc[at[row]])), terms.take(pa.array(term[at[row]])), docs, pa.ListArray.from_arrays(pa.array(np.append(row, len(at)), pa.int32()), held))


def _blocks(batches, block: int) -> Iterator[pa.RecordBatch]:
    """Batches together of about ``block`` bytes of text; a longer text is alone with its batch's slice."""
    rows, total = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + block - total, "right")))
            rows.append(batch.slice(at, end - at))
            total += sizes[end - 1] - before
            at = end
            if total >= block or at < batch.num_rows:
                yield pa.Table.from_batches(rows).combine_chunks()
                rows, total = [], 0
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks()


def refine(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(lang, term, source, occurs, everywhere, first): of each kept term its occurrences in each source that holds it, and in all; one row of a term is ``first``."""
    spark = docs.sparkSession

    def run(batches):
        for rows in _blocks(batches, block):
            text, lang, source = (rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c) for c in ("text", "lang", "source"))
            yield from block_rows(text, lang, source)

    path = shared_path(spark, "prefixes")
    docs.mapInArrow(run, ROWS).write.partitionBy("level").parquet(path)  # one read of the texts; a level then reads its own files
    every = spark.read.schema(ROWS).parquet(path)
    levels = sorted(r[0] for r in every.where("level > 0").select("level").distinct().collect())  # a folder for each: the powers of 2 up to the longest term
    kept: list[DataFrame] = []
    for level in levels:
        found = every.where(F.col("level") == level).select("lang", F.col("term").alias("prefix"), "n")
        if kept:
            shorter = kept[-1].withColumnRenamed("prefix", "before")
            found = found.withColumn("before", F.substring("prefix", 1, level // 2)).join(shorter, ["lang", "before"], "left_semi")
        kept.append(stow(found.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "prefix"), "kept"))
    whole = every.where("level = 0").select("lang", "term", "held")
    stem = F.expr("substring(term, 1, int(shiftleft(1L, length(bin(octet_length(term))) - 1)))")  # the longest prefix whose length is a level
    whole = whole.withColumn("prefix", stem)
    if kept:
        of = kept[0]
        for more in kept[1:]:
            of = of.union(more)
        whole = whole.join(of, ["lang", "prefix"], "left_semi")
    # dealt by prefix, as that join may have done: nothing below is shuffled again
    rows = whole.repartition("lang", "prefix").select("lang", "prefix", "term", F.explode("held").alias("h"))
    counts = rows.groupBy("lang", "prefix", "term", F.col("h.source").alias("source")).agg(F.sum("h.occurs").alias("occurs"), F.sum("h.docs").alias("docs"))
    term = Window.partitionBy("lang", "prefix", "term")
    counts = counts.withColumns({"docs": F.sum("docs").over(term), "everywhere": F.sum("occurs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    out = stow(counts.where(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "source", "occurs", "everywhere", "first"), "terms")
    forget(*kept, every)
    return out


def share(count: Column, total: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / total), exactly."""
    return F.when(total > 0, 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)")))


def gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of f over the terms that a cell holds, for each pair of its sources."""
    head = rows.filter(pc.is_null(rows["term"]))
    names, tile, zero = head["source"].combine_chunks(), head["tile"].to_numpy(), head["p"].to_numpy()
    own = rows.filter(pc.is_valid(rows["term"]))
    coded = own["term"].combine_chunks().dictionary_encode()
    present = len(coded.dictionary)
    p = np.repeat(zero[:, None], present, 1)
    p[pc.index_in(own["source"].combine_chunks(), names).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)] = own["p"].to_numpy()
    a, b, value = [], [], []
    for k in range(len(names)):
        others = np.flatnonzero((tile != tile[k]) if key[2] != key[3] else (np.arange(len(names)) != k))
        for some in np.array_split(others, max(1, len(others) // 32)):
            q = p[some]
            step = p[k] - q
            a.append(np.full(len(some), k))
            b.append(some)
            value.append((step * step // q).sum(1))
    if not a:
        a = b = value = [np.zeros(0, np.int64)]
    take = lambda x: names.take(pa.array(np.concatenate(x)))
    total = pa.array(np.concatenate(value), pa.int64())
    return pa.table({"lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(total)), "source": take(a), "item": take(b), "value": total, "present": pa.repeat(pa.scalar(present, pa.int64()), len(total))})


def pairs(terms: DataFrame, groups: DataFrame, per_cell: int = TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of a language's sources. ``groups``: lang, source, total (N + V), kept (V)."""
    own = Window.partitionBy("lang").orderBy("source")
    dealt = groups.withColumns({"place": F.row_number().over(own) - 1, "sources": F.count("*").over(Window.partitionBy("lang"))})
    dealt = dealt.withColumns({"tile": F.floor(F.col("place") / tile).cast("int"), "tiles": F.ceil(F.col("sources") / tile).cast("int"), "parts": F.greatest(F.lit(1), F.ceil(F.col("kept") / per_cell)).cast("int"), "zero": share(F.lit(0), F.col("total"))})
    dealt = stow(dealt.select("lang", "source", "total", "kept", "tile", "tiles", "parts", "zero"), "groups")
    held = terms.join(dealt, ["lang", "source"])
    held = held.select("lang", "source", "term", "tile", "tiles", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), share(F.col("occurs"), F.col("total")).alias("p"))
    head = dealt.select("lang", "source", F.lit(None).cast("string").alias("term"), "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.coalesce("zero", F.lit(1).cast("long")).alias("p"))
    every = held.union(head).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    cells = every.select("lang", "part", "low", "high", "source", "term", "tile", "p").groupBy("lang", "part", "low", "high")
    sums = cells.applyInArrow(_cell, "lang string, source string, item string, value long, present long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    side = lambda name, zero: dealt.select("lang", F.col("source").alias(name), F.col("zero").alias(zero), *(["kept"] if name == "source" else []))
    sums = sums.join(side("source", "p"), ["lang", "source"]).join(side("item", "q"), ["lang", "item"])
    rest = F.when(F.col("kept") > F.col("present"), (F.col("kept") - F.col("present")) * gain(F.col("p"), F.col("q"))).otherwise(F.lit(0))
    return sums.select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, per_cell: int = TERMS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each source with each other of its language, part ``term`` names the
    terms (at most ``top``) that it uses more than its language does."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = refine(docs, least, block)
    langs = terms.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("occurs").alias("all"))
    own = terms.groupBy("lang", "source").agg(F.sum("occurs").alias("own"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    kept = F.coalesce("kept", F.lit(0))
    groups = stow(groups.select("lang", "source", (F.coalesce("own", F.lit(0)) + kept).alias("total"), (F.coalesce("all", F.lit(0)) + kept).alias("whole"), kept.alias("kept")), "groups")
    of = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    compared = pairs(terms, groups, per_cell, tile).withColumn("rank", F.row_number().over(of))
    p, q = share(F.col("occurs"), F.col("total")), share(F.col("everywhere"), F.col("whole"))
    more = terms.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "item", gain(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(compared, "pair").union(part(more, "term"))


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)
