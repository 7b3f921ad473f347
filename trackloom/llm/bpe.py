"""Operator 9: byte-level BPE encoding and decoding.

Every match of the pre-tokenizer's pattern is encoded by itself. A segment tree over its byte positions holds, at each
leaf, the rank of the pair that begins there, and above it the least rank below; the leftmost least rank is found from
the root. A merge writes three leaves (the merged part, the part it took in, the live neighbour to the left) and their
ancestors. ``_merge`` does this for many short pieces side by side, in numpy; a piece of more than ``SHORT`` bytes has a tree of
its own (``_merge_long``), with the same steps one by one.

Nulls and empty texts have no ids and decode to an empty text. Repeated rows are encoded each. Very long texts are worked
on in blocks of whole texts, very long pieces get a taller tree. Ties between equal ranks go to the leftmost pair. Other columns pass through
untouched; an input column named like an output column is replaced. An empty table gives an empty one.

Tokenizers are never trained here: the ranks come from a file whose path is a parameter, read on the driver (its size is that of
a vocabulary, not of the data) and broadcast. Ranks may have gaps; an id without a token can't be decoded and is an error.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: no pair to merge.
NONE = np.int32(2**31 - 1)
#: Bytes that a Python worker's encoded pieces may take, by ``ENTRY`` bytes a piece and its own.
CACHE_BYTES, ENTRY = 48 << 20, 200
#: Bytes of texts that are cut into pieces at a time; bytes of the pieces merged side by side, and of one of them.
BLOCK, SIDE_BY_SIDE, SHORT = 1 << 20, 1 << 18, 256
_MIX, _EMPTY = np.uint64(0x9E3779B97F4A7C15), -(1 << 62)
#: The encoder of this worker, by its key: one at a time.
_made: dict = {}


def load_ranks(path: str) -> list[bytes | None]:
    """Token bytes by rank, from a file of "base64 rank" lines; None where a rank is not used."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(text), int(rank)) for text, rank in (line.split() for line in lines if line.strip())]
    tokens: list[bytes | None] = [None] * (1 + max((r for _, r in pairs), default=-1))
    for token, rank in pairs:
        tokens[rank] = token
    return tokens


def pair_table(tokens: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) of the pairs of tokens whose bytes together are a token: an open hash table with linear probing."""
    rank = {t: i for i, t in enumerate(tokens) if t is not None}
    keys, made = [], []
    for t, i in rank.items():
        for cut in range(1, len(t)):
            a, b = rank.get(t[:cut]), rank.get(t[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                made.append(i)
    bits = max(4, (3 * len(keys)).bit_length())
    table, value = np.full(1 << bits, _EMPTY, np.int64), np.full(1 << bits, NONE, np.int32)
    key, made = np.array(keys, np.int64), np.array(made, np.int32)
    slot, left = (key.view(np.uint64) * _MIX >> np.uint64(64 - bits)).astype(np.int64), np.arange(len(key))
    while len(left):
        free = left[table[slot[left]] == _EMPTY]
        at, first = np.unique(slot[free], return_index=True)
        table[at], value[at] = key[free[first]], made[free[first]]
        left = left[table[slot[left]] != key[left]]
        slot[left] = slot[left] + 1 & len(table) - 1
    return table, value


class Encoder:
    def __init__(self, tokens: list[bytes | None], pattern: str, table: np.ndarray, value: np.ndarray):
        import regex

        self.tokens, self.split, self.table, self.value = tokens, regex.compile(pattern).findall, table, value
        self.rank = {t: i for i, t in enumerate(tokens) if t is not None}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.shift = np.uint64(64 - (len(table) - 1).bit_length())
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts, NONE where they don't merge."""
        key = (a.astype(np.int64) << 32) + b
        slot = (key.view(np.uint64) * _MIX >> self.shift).astype(np.int64)
        found = self.table.take(slot)
        out = np.where(found == key, self.value.take(slot), NONE)
        left = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.table) - 1
            at = slot[left]
            found = self.table[at]
            hit = found == key[left]
            out[left[hit]] = self.value[at[hit]]
            left = left[~hit & (found != _EMPTY)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > SHORT:
                out[i] = self._merge_long(p)
            else:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, SIDE_BY_SIDE // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` (a power of two) bytes. Piece r has the leaves r * width to (r + 1) * width, and each level
        above half as many: the parent of place x is x >> 1 everywhere. Place ``end`` stands for no neighbour."""
        m, end = len(pieces), len(pieces) * width
        used = (np.arange(width) < np.array([len(p) for p in pieces])[:, None]).ravel()
        ids = np.full(end + 1, -1, np.int32)
        ids[:end][used] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, end + 2), np.arange(-1, end)
        after[width - 1 : end : width] = end
        before[0:end:width] = end
        leaf = np.full(end, NONE, np.int32)
        both = np.flatnonzero(used[:-1] & used[1:] & (np.arange(1, end) % width > 0))
        leaf[both] = self.pair(ids[both], ids[both + 1])
        tree = [leaf]
        while len(tree[-1]) > m:
            tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
        row = np.flatnonzero(tree[-1] != NONE)
        while len(row):
            least = tree[-1].take(row)
            at = row
            for level in tree[-2::-1]:
                at = at + at
                at += level.take(at) != least  # the left half, where it holds the least rank too
            gone = after.take(at)
            then = after.take(gone)
            ids[at] = least
            ids[gone] = -1
            after[at] = then
            before[then] = at
            prior = before.take(at)
            leaf[gone] = NONE
            leaf[at] = self.pair(least, ids.take(then))
            some = np.flatnonzero(prior != end)
            leaf[prior[some]] = self.pair(ids.take(prior[some]), least[some])
            spots = np.concatenate([at, gone, prior[some]])
            for low, high in zip(tree, tree[1:], strict=False):
                spots = spots >> 1
                left = spots + spots
                high[spots] = np.minimum(low.take(left), low.take(left + 1))
            row = row[tree[-1].take(row) != NONE]
        live = ids[:end] >= 0
        flat = ids[:end][live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(m, width).sum(1)) * 4
        return [flat[b:e] for b, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        """One piece, whatever its length: leaves begin at ``size``, the root is 1, a node's children are 2 x and 2 x + 1."""
        n, none, rank = len(piece), int(NONE), self.rank.get
        size = 1 << (n - 1).bit_length()
        tree = array("i", [none]) * (2 * size)
        starts = self.byte[np.frombuffer(piece, np.uint8)]
        tree[size : size + n - 1] = array("i", self.pair(starts[:-1], starts[1:]).astype(np.int32).tobytes())
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n))

        def put(at: int, value: int) -> None:
            x = at + size
            tree[x] = value
            while x > 1:
                x >>= 1
                value = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == value:
                    break
                tree[x] = value

        while tree[1] != none:
            least, x = tree[1], 1
            while x < size:
                x *= 2
                x += tree[x] != least
            at = x - size
            gone = after[at]
            then = after[gone]
            after[at] = then
            if then < n:
                before[then] = at
            put(gone, none)
            put(at, rank(piece[at : after[then]], none) if then < n else none)
            if (prior := before[at]) >= 0:
                put(prior, rank(piece[prior:then], none))
        out, at = array("I"), 0
        while at < n:
            out.append(self.rank[piece[at : after[at]]])
            at = after[at]
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        fresh = set().union(*parts).difference(self.cache)
        grown = self.cached + sum(map(len, fresh)) + ENTRY * len(fresh)
        if grown > CACHE_BYTES:  # the longest pieces go: they come again most rarely
            size = sorted(map(len, self.cache))[len(self.cache) // 3] if self.cache else 0
            self.cache = {p: ids for p, ids in self.cache.items() if len(p) < size}
            fresh = set().union(*parts).difference(self.cache)
            grown = sum(map(len, self.cache)) + sum(map(len, fresh)) + ENTRY * (len(self.cache) + len(fresh))
        self.cached = grown
        names = list(fresh)
        self.cache.update(zip(names, self.merge_all([x.encode() for x in names]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _share(df: DataFrame, ranks: str, pattern: str):
    """The vocabulary, the pattern, the table of pairs and a digest of them, for all tasks."""
    tokens = load_ranks(ranks)
    digest = hashlib.sha256(pattern.encode())
    for i, t in enumerate(tokens):
        if t is not None:
            digest.update(b"%d %d " % (i, len(t)) + t)
    return df.sparkSession.sparkContext.broadcast((digest.digest(), tokens, pattern, *pair_table(tokens)))


def _encoder(shared) -> Encoder:
    """The encoder of a vocabulary and pattern, with its cache, in this Python worker."""
    key, *made = shared.value
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(*made)
    return _made[key]


def _blocks(batch: pa.RecordBatch, column: str):
    """Slices of whole rows, of about BLOCK bytes of ``column`` each."""
    sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield batch.slice(at)


def _add(df: DataFrame, new: dict[str, str], work) -> DataFrame:
    """``df`` with binary columns: ``work`` makes those that ``new`` names, of a batch's slice."""
    names = [c for c in df.columns if c not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(f"`{c}`" for c in names)).schema.fields] + [f"`{n}` {kind}" for n, kind in new.items()])

    def run(batches):
        for batch in batches:
            for rows, made in work(batch):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *(pa.array(x, pa.binary()) for x in made)], names=[*names, *new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: str, pattern: str, column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``into``: the ids of ``column`` as little-endian unsigned 32-bit integers (binary). ``ranks``: path of the vocabulary.

    decoded: add a column of this name too, the bytes that these ids stand for (as ``decode`` would, in the same pass).
    """
    shared = _share(df, ranks, pattern)

    def work(batch):
        coder = _encoder(shared)
        for rows in _blocks(batch, column):
            ids = coder.encode([t or "" for t in rows.column(column).to_pylist()])
            yield rows, [ids] + ([[coder.decode(x) for x in ids]] if decoded else [])

    return _add(df, {into: "binary"} | ({decoded: "binary"} if decoded else {}), work)


def decode(df: DataFrame, ranks: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the bytes (binary) that the ids in ``column`` stand for; null and empty ids give no bytes."""
    shared = _share(df, ranks, pattern)

    def work(batch):
        coder = _encoder(shared)
        for rows in _blocks(batch, column):
            yield rows, [[coder.decode(x or b"") for x in rows.column(column).to_pylist()]]

    return _add(df, {into: "binary"}, work)


def as_array(ids):
    """The ids of a binary column as ``array<int>``, in Spark's own functions."""
    byte = lambda i, k: F.conv(F.hex(F.substr(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    count = (F.octet_length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)).otherwise(F.array().cast("array<int>"))


def digests(ids: str, decoded: str) -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of columns that ``encode`` added."""
    return [(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")]


def digest(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts of ``df``."""
    return encode(df.select("doc_id", "text"), ranks, pattern, decoded="decoded").select("doc_id", *digests("ids", "decoded"))
