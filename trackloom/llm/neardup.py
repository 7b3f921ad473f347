"""Operator 3: MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct ``shingle``-word shingles (fewer words: the whole sequence as one). Two
documents are linked if 100 * |A and B| >= threshold * |A or B|; components of links are the groups.

1. Sets are hashed in Arrow blocks; equal sets are one class from there on, so exact copies never meet each other.
2. A class retains the ``k`` least hashes of its set (the bottom-k sketch). The postings (value, class) are the inverted
   lists of retained values.
3. Linked classes share many retained values: where both sets fit their sketches, at least 3/7 of the sum of their sizes (for
   J >= 0.75); otherwise at least ``least_shared(k)`` (the sketch of the union holds k values, each shared with a chance of
   0.75 or more: fewer has a chance below 1e-6, and a group has many links). So with each class's values in order of rarity,
   two linked classes meet in a list among the first |sketch| - least + 1 values of each, and the places of their first
   common value leave room for the rest (prefix and positional filters). Commoner lists are left out by that order, not by a
   cap; values that one class alone holds make no list. Classes that stay in a list are sketched again with ``full``
   values, which for most is the whole set, and filtered again.
4. Rounds of stars: each list names a hub (first the class with the commonest values, then one of a component by a salted hash), and all
   others of another component that may fit it by size and place are paired with the hub. A pair is tested on the sketch of its
   union, then on the full sets. After the round a hub leaves its list, since it has met all that it may be linked with there, and
   a list leaves when its classes are one component. Large groups of near copies so become one component in a round or two,
   without their pairs being made, and each round works only on the lists that are left.
5. From the second round on, lists of at most ``SMALL`` classes are settled at once, pair by pair (a fixed number a class), and a
   larger one names ``MORE`` times as many hubs each round (the first and the last of each part by component), so that classes which resemble each other but are not linked all meet
   in few rounds. The rounds end when no list is left, so no link is lost.

Full sets travel only for paired classes, in groups keyed by hub and salt, so that a hub of very many classes is dealt
over many tasks.

Defined results: null, empty or wordless texts have an empty set, are linked with nothing and are kept; repeated rows and
ties go to the smallest doc_id; equal rows may repeat, but a doc_id names one text; a null doc_id has component null
and is kept. An empty table gives an empty result. Only doc_id and text are read. ``deduplicate`` leaves one row of each group:
one of a repeated row, and rows without a doc_id take part under a key made of their text (a row with a doc_id stays rather than they).
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.shared import forget
from .shared import NOT_SPACE, Words, bounded_broadcast, fits, grams, list_column, stow, text_blocks

K, FULL, SHINGLE, THRESHOLD = 128, 1024, 5, 75
#: Partners in a task beside one copy of their hub's set.
PER_SALT = 256
#: Classes of a list whose pairs are all tested, after the first round.
SMALL = 16
#: Times as many hubs of a list in each round as in the one before.
MORE = 8
#: Pairs of a round are joined to the documents by broadcast up to this many, else by a shuffle.
BROADCAST_PAIRS = 500_000


def least_shared(k: int, share: float = THRESHOLD / 100, chance: float = 1e-6) -> int:
    """The largest m with P(Binomial(k, share) < m) <= chance."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if below > chance:
            return m
    return k


def document_sets(batch: pa.RecordBatch, shingle: int = SHINGLE):
    """(row, sorted distinct hashes) for each text of a batch."""
    for at, end, data, offsets in text_blocks(batch):
        w = Words(data, offsets, NOT_SPACE)
        g, whole = grams(w.hashes, shingle), fits(w.first, shingle)
        for i in range(at, end):
            b, e = int(w.first[i - at]), int(w.first[i - at + 1])
            if e - b >= shingle:
                h = g[b:e][whole[b:e]]
            elif e > b:
                h = grams(w.hashes[b:e], e - b)[:1] ^ np.uint64(e - b)
            else:
                h = g[:0]
            yield i, np.unique(h.view(np.int64))


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch): set_id, 16 bytes, is the same for equal sets and null for empty ones."""
    import xxhash

    def run(batches):
        for batch in batches:
            n, ids, values, sizes = [], [], [], []
            for _, s in document_sets(batch, shingle):
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(s[:k])
                sizes.append(min(k, len(s)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), list_column(np.concatenate([np.zeros(0, np.int64), *values]), sizes)], names=["doc_id", "n_shingles", "set_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def classes(sketched: DataFrame) -> DataFrame:
    """(set_id, c, n, sketch): one row for each set; c is its smallest doc_id."""
    return sketched.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("c"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))


def inverted_lists(sketched: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """(v, c, n, room, short, weight): the necessary lists of retained values; c: a class, n: its size, weight: how common its values are."""
    postings = stow(classes(sketched).select("c", "n", F.explode("sketch").alias("v")), "postings")
    common = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    t, n, m = threshold / 100, F.col("n"), F.least(F.col("n"), F.lit(k))
    loose = F.least(F.lit(least_shared(k, t)), F.ceil(n * threshold / 100))
    least = F.when(n <= int(k * t), F.ceil(n * threshold / 100)).otherwise(loose)  # of any partner
    alike = F.when(n <= int(k * t), F.ceil(n * (2 * threshold) / (100 + threshold))).otherwise(loose)  # of a partner that is no smaller
    own = Window.partitionBy("c")
    ranked = postings.join(common, "v").withColumns({"shared": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("df", "v")), "weight": F.sum("df").over(own)})
    # values of one class alone come first in its order and fill its first places; room: values left from this one on
    room = (F.col("shared") - F.col("rank") + 1).cast("int")
    lists = stow(ranked.where((F.col("shared") >= least) & (room >= least)).select("v", "c", "n", room.alias("room"), (room >= alike).alias("short"), "weight"), "lists")
    forget(postings)
    return lists


def may_link(k: int, threshold: int = THRESHOLD) -> str:
    """Whether two members of a list fit by size, and by the room that both places leave."""
    least = f"if(n <= {k} and hub_n <= {k}, ceil((n + hub_n) * {threshold} / {100 + threshold}), {least_shared(k, threshold / 100)})"
    return f"component <> hub_component and least(n, hub_n) * 100 >= greatest(n, hub_n) * {threshold} and least(room, hub_room) >= {least}"


def verify(docs: DataFrame, pairs: DataFrame, n: int, k: int = K, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): of the ``n`` pairs (hub, c) those whose full sets are similar enough, written. A pair's sets meet in a task of the hub and a salt."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / PER_SALT))
    fan = pairs.groupBy("hub").agg(F.count("*").alias("n")).select("hub", salts.cast("int").alias("salts"))
    wanted = pairs.join(fan, "hub").select(F.col("c").alias("doc_id"), "hub", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    wanted = wanted.union(fan.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role")))
    wanted = F.broadcast(wanted) if n <= BROADCAST_PAIRS else wanted  # at most twice as many rows of four numbers

    def sets(batches):
        for batch in batches:
            out = pa.array([s.tobytes() for _, s in document_sets(batch, shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hub", "salt", "role", "doc_id")), out], names=["hub", "salt", "role", "c", "s"])

    def test(batches):
        hub, own, near = None, None, least_shared(k, threshold / 100)
        for batch in batches:
            found = []
            for h, _, role, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x = np.frombuffer(s, np.int64)
                if role == 0:
                    hub, own = h, x
                    continue
                assert h == hub
                union = np.union1d(own[:k], x[:k])[:k]  # the sketch of the union, from the two sketches
                if len(union) == k and np.isin(union, own[:k], assume_unique=True).sum() + np.isin(union, x[:k], assume_unique=True).sum() - k < near:
                    continue
                both = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * both >= threshold * (len(own) + len(x) - both):
                    found.append((h, c))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = texts.join(wanted, "doc_id").select("doc_id", "hub", "salt", "role", "text")
    met = rows.mapInArrow(sets, "hub long, salt int, role int, c long, s binary").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "c")
    return stow(met.mapInArrow(test, "a long, b long"), "links")


def links(docs: DataFrame, lists: DataFrame, k: int, full: int, shingle: int, threshold: int, small: int = SMALL) -> DataFrame:
    """(a, b): links that connect all classes of ``lists`` that links connect.

    Between rounds a class goes by its least hub, which needs no search for components: classes of one hub are one component.
    """
    fit = may_link(full, threshold)
    left, found = lists.withColumn("component", F.col("c")), []
    for turn in itertools.count():
        parts = left.groupBy("v", "component").agg(F.count("*").alias("m"), F.count_if("short").alias("s"))
        spread = parts.groupBy("v").agg(F.sum("m").alias("size"), F.count("*").alias("parts"), F.sum("s").alias("s")).where("parts > 1 and s > 0")
        spread = stow(spread.select("v", "size"), "spread")  # written: a list of very many classes can be split in the join
        now = stow(left.join(spread, "v"), "open")
        forget(spread, *([left] if turn else []))
        if now.isEmpty():
            break
        direct = F.lit(turn > 0) & (F.col("size") <= small)
        few, many = now.where(direct), now.where(~direct)
        as_hub = {"c": "hub", "component": "hub_component", "n": "hub_n", "room": "hub_room"}
        own = [F.col(x).alias(y) for x, y in as_hub.items()]
        by = F.struct("short", "weight", "c", *own) if not turn else F.struct(F.xxhash64(F.lit(7 * turn + 1), "component").alias("x"), F.xxhash64(F.lit(turn), "c").alias("y"), *own)
        salt = F.pmod(F.xxhash64(F.lit(3 * turn + 2), "c"), F.lit(MORE**turn))
        chosen = F.array(F.max(by), *([F.min(by)] if turn else []))  # both ends of the components' order: of two components, one each
        hubs = stow(many.groupBy("v", salt.alias("salt")).agg(chosen.alias("h")).select("v", F.explode("h").alias("h")).select("v", *(f"h.{x}" for x in as_hub.values())).distinct(), "hubs")
        met = many.join(hubs, "v").where(fit).select("hub", "c").union(few.join(few.select("v", *own), "v").where(fit + " and hub < c").select("hub", "c"))
        met = stow(met.distinct(), "pairs")
        if pairs := met.count():
            found.append(verify(docs, met, pairs, k, shingle, threshold))
        rest = many.drop("size", "component").join(hubs.select("v", F.col("hub").alias("c")), ["v", "c"], "left_anti").withColumnRenamed("c", "member")
        if found:
            hub_of = functools.reduce(DataFrame.union, found).groupBy(F.col("b").alias("member")).agg(F.min("a").alias("component"))
            rest = rest.join(hub_of, "member", "left").withColumn("component", F.coalesce("component", "member"))
        else:
            rest = rest.withColumn("component", F.col("member"))
        left = stow(rest.withColumnRenamed("member", "c"), "left")
        forget(now, hubs, met)
    forget(now)
    return functools.reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], "a long, b long")


def groups(docs: DataFrame, k: int = K, full: int = FULL, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketched = stow(sketches(docs, k, shingle), "sketches")
    first = inverted_lists(sketched, k, threshold)
    near = stow(first.select(F.col("c").alias("doc_id")).distinct(), "near")
    lists = inverted_lists(sketches(docs.join(bounded_broadcast(near, BROADCAST_PAIRS), "doc_id"), full, shingle), full, threshold)
    forget(first, near)
    linked = links(docs, lists, k, full, shingle, threshold)
    labels = components(linked)
    forget(lists, linked)
    by_class = classes(sketched).select("set_id", "c")
    named = stow(by_class.join(labels.withColumnRenamed("node", "c"), "c", "left").select("set_id", F.coalesce("component", "c").alias("component_id")), "named")  # written: a set of very many copies can be split in the join
    return sketched.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))  # beyond the ids of documents
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = stow(groups(keyed.select(F.col(key).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(key), "kept"), "kept")
    gone, again = found.where("not kept").select(key).distinct(), found.where("kept").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    kept = keyed.join(bounded_broadcast(gone, BROADCAST_PAIRS), key, "left_anti")
    if not again.isEmpty():
        again = bounded_broadcast(again, BROADCAST_PAIRS)
        kept = kept.join(again, key, "left_anti").union(kept.join(again, key, "left_semi").dropDuplicates([key]).select(*kept.columns))
    return kept.select(*docs.columns)
