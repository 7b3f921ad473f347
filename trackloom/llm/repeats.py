"""Operator 6: removal of every byte that a 200-byte string covers which also starts anywhere else in the corpus.

The method asked for (suffix arrays by linear grouping over Lyndon prefixes) visits bytes one by one; in Python, which is where a
task's bytes are, that takes several microseconds a byte (figures in the README), so it is the local step only where the caller
asks for it (``local="lyndon"``). By default it is hashing:

1. Each 200-byte string names an anchor: the leftmost least of the hashes of its 32-byte grams. Equal strings name equal grams at
   equal offsets, so only strings of equal anchors need to meet. There is about one anchor in 85 bytes. An anchor's context is the
   168 bytes before it, itself and the 168 after it, as far as the text goes: all strings that hold it.
2. Occurrences of an anchor are told apart by a hash of their context. Of those with one context, in whatever texts, all strings are repeated: they are
   marked at once, without their bytes. Those in one batch of texts are made one there, so that a passage that very many texts share is one row a batch.
3. Anchors with one context only are done. Of the others, one occurrence of each context goes on. Each string holds the 84 bytes before its anchor or the 85 after it:
   occurrences meet in groups of one anchor and one of these halves, so that a line that very many texts share, each in
   surroundings of its own, makes no large group. A half that one occurrence alone has is done; for the others the bytes of their half's strings are sent to the group.
4. A group sorts its strings, offset by offset (64-bit hashes of all 200 bytes), marks those found twice, and compares the bytes of
   each with those of the one beside it. The contexts of a hot half are dealt over groups of about ``HOT``; of such a half each group also hands on the strings that
   it found once, and one of each that it found more often, and these are compared over all groups by half and hash.
5. The marked strings' bytes are joined into spans for each text, and the spans are given to its copies.

Texts are known by the first 128 bits of their SHA-256, and within the job by a number. Contexts of one anchor, and strings of groups that a hot half is dealt over, are taken for equal
if anchor or half and hash, 128 bits together, agree.

Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input. Null and empty texts have no bytes and
nothing removed; repeated rows are copies of each other; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import collections
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget
from .shared import BYTE_CODE, mix, stow, text_blocks

LENGTH, GRAM, HOT = 200, 32, 2000
SIDE = LENGTH - GRAM
BROADCAST_BYTES = 64 << 20
#: Bytes of a text whose anchors are found at once, and of contexts that go on in one batch.
CHUNK, SENT = 1 << 22, 4 << 20


#: Sizes and multipliers that double strings from 1 to 32 bytes.
DOUBLING = ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F))


def spread(x: np.ndarray, size: int, odd: int) -> np.ndarray:
    """From hashes of strings of ``size`` bytes at each place, those of twice that."""
    return x[:-size] * np.uint64(odd) + x[size:]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the 32 bytes from each place."""
    x = BYTE_CODE[data]
    for size, odd in DOUBLING:
        if len(x) <= size:
            return x[:0]
        x = spread(x, size, odd)
    return mix(x)


def string_hashes(g: np.ndarray) -> np.ndarray:
    """Of the 200 bytes from each place, from its grams: along the last axis."""
    out = np.zeros(g.shape[:-1] + (max(0, g.shape[-1] - SIDE),), np.uint64)
    n = out.shape[-1]
    for k, at in enumerate((0, 32, 64, 96, 128, 160, SIDE)):
        out += g[..., at : at + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1)
    return mix(out)


def _chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of all grams): the grams that the 200-byte strings of a short text name."""
    g = gram_hashes(data)
    window = SIDE + 1
    n = len(g) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), g
    # least (hash, place) of each window: running minima forward and backward in blocks as long as a window
    low = np.uint64((1 << 26) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    pad = np.full(-len(key) % window, np.iinfo(np.uint64).max, np.uint64)
    block = np.concatenate([key, pad]).reshape(-1, window)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.unique(np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & low).astype(np.int64), g


#: Multipliers of the grams that a context's hash is made of.
PARTS = np.cumprod(np.full((SIDE + LENGTH) // GRAM + 3, 0x9FB21C651E98DF25, np.uint64), dtype=np.uint64)


#: Bytes before or after its anchor that a string holds: at least one of the two. Then what is before the anchor, and how many strings, in the frame of a kind of half.
BEFORE, AFTER = 84, 85
FRAMES = ((SIDE, SIDE - BEFORE + 1), (BEFORE - 1, BEFORE))


def _sum(around: np.ndarray, first: np.ndarray, last: np.ndarray, places) -> np.ndarray:
    """Of the bytes from ``first`` to the end of the gram at ``last``, from the grams at ``places``, drawn in to lie between."""
    out = np.zeros(len(first), np.uint64)
    for k, at in enumerate(places):
        out += around[np.clip(at, first, last)] * PARTS[k]
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, contexts, halves) of the grams that the 200-byte strings of a text name. Long texts are read in chunks.

    A context is known by its hash; halves holds 31 bits for the half before and for the half after, 0 for one that the text is too short for.
    """
    found = []
    for start in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
        # the strings that begin in the chunk, and the contexts of their anchors
        begin, end = max(0, start - SIDE), min(len(data), start + CHUNK + 2 * LENGTH + SIDE)
        places, g = _chunk(data[start : min(len(data), start + CHUNK + LENGTH - 1)])
        if not len(places):
            continue
        around, own = gram_hashes(data[begin:end]), places + (start - begin)
        first, last = np.maximum(own - SIDE, 0), np.minimum(own + LENGTH, len(data) - begin) - GRAM
        ends = (own - first).astype(np.uint64) * PARTS[-1] + (last - own).astype(np.uint64) * PARTS[-2]
        context = mix(_sum(around, first, last, (own + k for k in range(-SIDE, LENGTH, GRAM))) + ends)
        short = lambda x, fits: np.where(fits, (mix(x) >> np.uint64(33)).astype(np.int64) | 1, 0)
        before = short(_sum(around, np.maximum(own - BEFORE, 0), own, (own - BEFORE, own - 52, own - 20, own)), own - first >= BEFORE)
        after = short(_sum(around, own, np.minimum(own + AFTER, last), (own, own + 32, own + 64, own + AFTER)), last - own >= AFTER)
        found.append((places + start, g[places], context, before << 32 | after))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places, *others = (np.concatenate(x) for x in zip(*found, strict=True))
    places, first = np.unique(places, return_index=True)
    return places, *(x[first] for x in others)


def texts_of(batch: pa.RecordBatch):
    for at, end, data, offsets in text_blocks(batch):
        for i in range(at, end):
            yield i, data[offsets[i - at] : offsets[i - at + 1]]


def covered(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + size).tolist(), strict=True))


#: a: an anchor, c: its context, halves, q: its place in the text d, the bytes before and after it in its context, and whether the batch holds the context again.
#: Rows without an anchor are spans of contexts that a batch holds more than once, or give the text's key t.
ANCHORS = "a long, c long, halves long, q long, d long, first long, last long, t binary"


def _anchor_rows(batches):
    """Rows of ANCHORS, one for each anchor and context of a batch of texts; texts are numbered by task and order."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = [(i, *anchors(data), len(data)) for i, data in texts_of(batch)]
        join = lambda k, kind=np.int64: np.concatenate([np.zeros(0, kind), *(x[k] for x in found)])
        p, a, c, halves = join(1), join(2, np.uint64).view(np.int64), join(3, np.uint64).view(np.int64), join(4)
        row, n = (np.repeat(np.array([x[k] for x in found], np.int64), [len(x[1]) for x in found]) for k in (0, 5))
        before, after = np.minimum(p, SIDE), np.minimum(n - p, LENGTH)
        order = np.lexsort((c, a))
        a, c, halves, p, row, before, after = (x[order] for x in (a, c, halves, p, row, before, after))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(a)))
        q = p << 18 | before << 10 | after << 2 | np.repeat(times > 1, times)
        yield _rows(a=a[starts], c=c[starts], halves=halves[starts], q=q[starts], d=number + row[starts])
        runs = [(i, b, e) for i, own in _by_row(row, p - before, np.repeat(times > 1, times), p + after) for b, e in own]
        i, b, e = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([], [], [])))
        yield _rows(d=number + i, first=b, last=e)
        yield _rows(d=number + np.arange(batch.num_rows), t=batch.column("t"))
        number += batch.num_rows


def _rows(**columns) -> pa.RecordBatch:
    kinds = dict(x.split() for x in ANCHORS.split(", "))
    kind = lambda c: pa.binary() if kinds[c] == "binary" else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind(c)) if c in columns else pa.nulls(len(columns["d"]), kind(c)) for c in kinds], names=[*kinds])


def _by_row(row, first, chosen, last):
    """(row, merged runs) of the chosen spans."""
    row, first, last = row[chosen], first[chosen], last[chosen]
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    if not len(row):
        return
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for b, e in zip(starts, [*starts[1:], len(row)], strict=True):
        yield int(row[b]), merged(zip(first[b:e].tolist(), last[b:e].tolist(), strict=True))


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


CONTEXTS = "a long, salt int, g int, d long, b long, l int, c binary"


def _context_rows(batches):
    """For each wanted half of a text: the bytes of its strings and where the anchor is in them; salt parts the occurrences of a hot half."""

    def sent(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])

    rows, held = [], 0
    for batch in batches:
        numbers, wanted = batch.column("d").to_pylist(), batch.column("wanted")
        for i, data in texts_of(batch):
            d, own = numbers[i], wanted.slice(i, 1).flatten()
            for a, p, g in zip(*(own.field(f).to_numpy().tolist() for f in ("a", "p", "g")), strict=True):
                side, strings = FRAMES[a & 1]
                b = max(0, p - side)
                rows.append((a, (d ^ d >> 17 ^ p * 40503) % g, g, d, b, p - b, data[b : p - side + strings - 1 + LENGTH].tobytes()))
                held += LENGTH + strings
                if held >= SENT:
                    yield sent(rows)
                    rows, held = [], 0
    if rows:
        yield sent(rows)


def twice(about: list[bytes], left: list[int], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For halves of one kind, row by row: (found, rest, hashes) of the strings that hold the half, by offset.

    found: another row has this string; rest: no other row has it, or it is the first of those that do. Strings of one column
    have their anchors at the same place, so those of different anchors or halves differ, and rows of many groups are sorted together.
    """
    m, (side, strings) = len(about), FRAMES[kind]
    wide = np.zeros((m, strings - 1 + LENGTH), np.uint8)
    valid = np.zeros((m, strings), bool)
    for k, (c, x) in enumerate(zip(about, left, strict=True)):
        wide[k, side - x : side - x + len(c)] = np.frombuffer(c, np.uint8)
        valid[k, side - x : max(side - x, min(strings - 1, side - x + len(c) - LENGTH) + 1)] = True
    x = BYTE_CODE[wide]
    for size, odd in DOUBLING:
        x = x[:, :-size] * np.uint64(odd) + x[:, size:]
    h = string_hashes(mix(x))
    h[~valid] = mix(np.arange(1, (~valid).sum() + 1, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))  # no string there: no match
    columns = np.ascontiguousarray(h.T)
    order = np.argsort(columns, axis=1)
    row = np.take_along_axis(columns, order, 1)
    equal = row[:, 1:] == row[:, :-1]
    same, later = np.zeros(row.shape, bool), np.zeros(row.shape, bool)
    later[:, 1:] = equal
    same |= later
    same[:, :-1] |= equal
    _compare(wide, order, equal)
    found, rest = np.zeros(row.shape, bool), np.zeros(row.shape, bool)
    np.put_along_axis(found, order, same, 1)
    np.put_along_axis(rest, order, ~later, 1)
    return found.T & valid, rest.T & valid, h


def _compare(wide: np.ndarray, order: np.ndarray, equal: np.ndarray, some: int = 20_000) -> None:
    """Strings of equal hashes have equal bytes; two that do not would be an error, not a wrong result."""
    strings = np.lib.stride_tricks.sliding_window_view(wide, LENGTH, axis=1)
    at, k = np.nonzero(equal)
    for b in range(0, len(at), some):
        s, x, y = at[b : b + some], order[at[b : b + some], k[b : b + some]], order[at[b : b + some], k[b : b + some] + 1]
        if not np.array_equal(strings[x, s], strings[y, s]):
            raise RuntimeError("two strings have one hash: run again with other values in shared.BYTE_CODE")


def lyndon_order(x: list[int]) -> list[int]:
    """The suffixes of ``x`` and of the empty end, sorted, by linear grouping.

    Suffixes are grouped by the Lyndon words that they begin with, from groups by first symbol on. A group is known by the place
    where it begins in the order. Groups are visited from the last one down: of each suffix, ``before`` points to the nearest one
    in front of it of a smaller group, whose Lyndon word grows by the group's, as often as the group's suffixes point to it; such
    suffixes leave their group for one just behind it, those with most growth last. At the end, each suffix in order brings the one in front of it, and the
    chain of those that this one points to, to the next free place of their groups.
    """
    n = len(x) + 1
    symbols = [0, *(c + 1 for c in x[::-1])][::-1]
    first, total = {}, 0
    for c, m in sorted(collections.Counter(symbols).items()):
        first[c], total = total, total + m
    group, members = [first[c] for c in symbols], collections.defaultdict(set)
    for i, g in enumerate(group):
        members[g].add(i)
    begin = {g + len(own): g for g, own in members.items()}  # by where a group ends
    before, end = [-1] * n, n
    while end:
        g, times = begin[end], collections.Counter()
        for i in sorted(members[g]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] += 1
        grown = collections.defaultdict(list)
        for j, k in times.items():
            grown[-k, group[j]].append(j)
        for (_, old), some in sorted(grown.items()):
            own = members[old]
            if len(some) < len(own):
                last = old + len(own)
                new = last - len(some)
                own.difference_update(some)
                members[new], begin[last], begin[new] = set(some), new, old
                for j in some:
                    group[j] = new
        end = g
    order, placed, free = [n - 1] + [-1] * (n - 1), [False] * (n - 1) + [True], list(range(n))
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            order[free[group[j]]] = j
            free[group[j]] += 1
            placed[j] = True
            j = before[j]
    return order


def twice_by_order(about: list[bytes], left: list[int], where: list[tuple[int, int]], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """``found`` and ``rest`` as of ``twice``, from the sorted suffixes of all contexts; where: of each, its text and its place there.

    Equal strings stand side by side, and bytes are compared, not hashes. A place that two anchors bring is one place.
    """
    side, strings = FRAMES[kind]
    found, rest = np.zeros((2, len(about), strings), bool)
    x: list[int] = []
    places: list[tuple[int, int] | None] = []
    for k, (c, near) in enumerate(zip(about, left, strict=True)):
        x += [b + 1 for b in c] + [0]
        places += [(k, s) if s <= min(near + strings - 1 - side, len(c) - LENGTH) else None for s in range(len(c) + 1)]
    run, last = [], None

    def close():
        if run:
            k, s = run[0]
            rest[k, side - left[k] + s] = True
            if len({(where[k][0], where[k][1] + s) for k, s in run}) > 1:
                for k, s in run:
                    found[k, side - left[k] + s] = True

    for i in lyndon_order(x)[1:]:
        if places[i] is not None:
            k, s = places[i]
            own = about[k][s : s + LENGTH]
            if own != last:
                close()
                run, last = [], own
            run.append((k, s))
    close()
    return found, rest


#: Rows that are solved together, at least; groups are not cut.
TOGETHER = 1000


SOLVED = "d long, first long, last long, h long"


def _group_rows(batches, local: str = "hashes"):
    """Rows sorted by half and salt -> (d, first, last, h): covered bytes (h null), and the strings left to compare across salts (last: their half)."""

    def solve(rows):
        out = []
        for kind, (side, _) in enumerate(FRAMES):
            own = [r for r in rows if r[0] & 1 == kind]
            if not own:
                continue
            found, rest, h = twice([r[6] for r in own], [r[5] for r in own], kind)
            if local == "lyndon":
                found, rest = twice_by_order([r[6] for r in own], [r[5] for r in own], [(r[3], r[4]) for r in own], kind)
            for k, (a, _, g, d, b, left, _) in enumerate(own):
                out += [(d, b + x, b + y, None) for x, y in covered(np.flatnonzero(found[k]) - (side - left), LENGTH)]
                if g > 1:
                    s = np.flatnonzero(rest[k])
                    out += [(d, b + x, a, y) for x, y in zip((s - (side - left)).tolist(), h[k, s].view(np.int64).tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "first", "last", "h"])

    rows = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "g", "d", "b", "l", "c")), strict=True):
            if len(rows) >= TOGETHER and r[:2] != rows[-1][:2]:
                yield solve(rows)
                rows = []
            rows.append(r)
    if rows:
        yield solve(rows)


def _key():
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def spans(docs: DataFrame, hot: int = HOT, local: str = "hashes") -> DataFrame:
    """(t, spans array<struct<first, last>>): of each text, known by ``t``, with something repeated, its covered runs, sorted and merged."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("t", _key()).where(F.octet_length("text") >= LENGTH)
    found = stow(texts.select("t", "text").mapInArrow(_anchor_rows, ANCHORS), "anchors")
    names = found.where("t is not null").select("d", "t")
    # one shuffle, by anchor: the rows of a context, and all of an anchor
    context, anchor = Window.partitionBy("a", "c"), Window.partitionBy("a")
    known = F.col("q").bitwiseAND(1) == 1
    rows = found.where("a is not null").select("a", "c", "halves", "q", "d").withColumn("same", F.row_number().over(context.orderBy("d", "q")))
    rows = rows.withColumns({"times": F.sum(F.when(known, 2).otherwise(1)).over(context), "contexts": F.sum(F.when(F.col("same") == 1, 1).otherwise(0)).over(anchor)})
    whole, ask = (F.col("times") > 1) & ~known, (F.col("same") == 1) & (F.col("contexts") > 1)
    decided = stow(rows.where(whole | ask).select("a", "halves", "q", "d", whole.alias("whole"), ask.alias("ask")), "decided")
    halves = F.array(*(F.struct(F.lit(kind).alias("kind"), half.alias("half")) for kind, half in enumerate((F.shiftright("halves", 32), F.col("halves").bitwiseAND((1 << 32) - 1)))))
    asked = decided.where("ask").select("a", "d", F.shiftright("q", 18).alias("p"), F.explode(halves).alias("h")).where("h.half <> 0")
    asked = asked.select(F.xxhash64("a", "h.kind", "h.half").bitwiseAND(-2).bitwiseOR(F.col("h.kind").cast("long")).alias("a"), "p", "d")
    asked = asked.withColumn("many", F.count("*").over(Window.partitionBy("a"))).where("many > 1")
    wanted = asked.groupBy("d").agg(F.collect_list(F.struct("a", "p", F.ceil(F.col("many") / hot).cast("int").alias("g"))).alias("wanted"))
    near = texts.dropDuplicates(["t"]).join(wanted.join(names, "d"), "t").select("d", "text", "wanted")
    about = near.mapInArrow(_context_rows, CONTEXTS)
    solved = stow(about.repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(functools.partial(_group_rows, local=local), SOLVED), "solved")
    rest = solved.where("h is not null").distinct()
    again = rest.groupBy("last", "h").agg(F.count("*").alias("m")).where("m > 1").select("last", "h")
    parts = solved.where("h is null").select("d", "first", "last").union(rest.join(again, ["last", "h"]).select("d", "first", F.col("first") + LENGTH))
    p, before, after = F.shiftright("q", 18), F.shiftright("q", 10).bitwiseAND(255), F.shiftright("q", 2).bitwiseAND(255)
    parts = parts.union(decided.where("whole").select("d", p - before, p + after)).union(found.where("first is not null").select("d", "first", "last"))
    sets = parts.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    joined = sets.mapInArrow(_merge, "d long, spans array<struct<first:long,last:long>>").join(names, "d")
    out = stow(joined.groupBy("t").agg(F.max("spans").alias("spans")), "spans")  # copies have the same spans: all their strings are repeated
    forget(found, decided, solved)
    return out


def _merge(batches):
    for batch in batches:
        out = [[{"first": a, "last": b} for a, b in merged((s["first"], s["last"]) for s in own)] for own in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["d", "spans"])


def digest(docs: DataFrame, hot: int = HOT, local: str = "hashes") -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256. Only texts with something removed are read again.

    A text with copies needs no rule of its own: all its strings are repeated.
    """
    found = spans(docs, hot, local)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", _key())
    size = found.agg(F.sum(16 * F.size("spans") + 64)).first()[0] or 0
    rows = text.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "t", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches):
    for batch in batches:
        out = []
        for doc_id, own, (_, data) in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), texts_of(batch), strict=True):
            kept, at, gone = hashlib.sha256(), 0, 0
            for s in own or []:
                kept.update(data[at : s["first"]])
                at, gone = s["last"], gone + s["last"] - s["first"]
            kept.update(data[at:])
            out.append((doc_id, len(data), gone, len(own or []), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
