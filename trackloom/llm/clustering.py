"""Operator 12: centroids of integer vectors, by zone maps along a space-filling curve.

Components count as floor(256 * x). The first centroids are the vectors with the least SHA-256 of "<seed>:<id>"; a round assigns each vector to the
nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each non-empty centroid to the floor of its vectors' mean.

1. Vectors are put in the order of a Hilbert curve (``BITS`` bits a component between the least and the greatest value of each) by range
   partitions of the curve's key and a hash of the id, so that very many equal vectors are dealt over many tasks.
2. Each run of ``BLOCK`` vectors is a block: its vectors and its zone map (the least and greatest of each component, and their sum).
3. A round sends the centroids (a fixed number) to all blocks. From the box of a block follow a lower and an upper bound of the distance of all
   its vectors to each centroid; a centroid whose lower bound exceeds the least upper bound is no candidate. The candidates are compared
   with all vectors of the block at once. A block with one candidate needs no comparison: its sum is in its zone map.
4. Only sums and counts by centroid and component leave the tasks.

The result is exact: bounds only save work, as far as the data lie in clusters. Distances are taken in 64-bit floats while all sums are integers below 2 ** 53,
else in 64-bit integers.

Vectors that are null, have other than ``dims`` components, or hold null or non-finite ones take no part. Repeated rows are vectors each;
of vectors with equal ids the one with smaller components is first; a null id is never a first centroid; with fewer vectors than centroids there are as many centroids as vectors with ids; an
empty table gives no rows. A component whose integer is 2 ** 27 or more is an error, since its distances would not fit 64 bits. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget
from .shared import stow

CENTROIDS, ROUNDS, SEED, DIMS, SCALE, BLOCK, BITS = 40, 5, 2, 64, 256, 256, 4
LIMIT = 1 << 27


def integers(df: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    ok = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(F.col(column).isNotNull() & (F.size(column) == dims) & ok).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes, in whose order the points ``x`` (rows of integers below 2 ** bits) lie along a Hilbert curve.

    The curve's cells are taken apart bit by bit from the highest one: each component that is set in a bit flips or swaps the lower bits of the
    first, then the bits are Gray-coded across components.
    """
    x = x.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(dims):
            high = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    planes = np.stack([(x >> np.uint64(b)) & one for b in range(bits - 1, -1, -1)])  # bit, component, row
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1)


def blocks(rows: DataFrame, low: list[int], high: list[int], block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(ids, x, low, high, total): the zone maps and vectors of the blocks along the curve; x holds all components, vector by vector."""
    low_, span = np.array(low, np.float64), np.maximum(1.0, np.array(high, np.float64) - np.array(low, np.float64) + 1)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                cell = np.floor((matrix(batch.column("v"), batch.num_rows) - low_) / span * (1 << bits)).astype(np.int64)
                keys = hilbert_keys(cell, bits)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "v", "key"])

    def cut(ids: list, x: np.ndarray) -> pa.RecordBatch:
        size = lambda a: pa.array([a.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), size(x.ravel()), size(x.min(0)), size(x.max(0)), size(x.sum(0))], names=["ids", "x", "low", "high", "total"])

    def packed(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column("id").to_pylist()
            parts.append(matrix(batch.column("v"), batch.num_rows))
            held += batch.num_rows
            if held >= block:
                x = np.concatenate(parts)
                for at in range(0, held - block + 1, block):
                    yield cut(ids[at : at + block], x[at : at + block])
                done = held // block * block
                ids, parts, held = ids[done:], [x[done:]], held - done
        if held:
            yield cut(ids, np.concatenate(parts))

    ordered = rows.mapInArrow(keyed, "id long, v array<long>, key binary").withColumn("part", F.xxhash64("id", "v"))
    ordered = ordered.repartitionByRange("key", "part").sortWithinPartitions("key", "part")
    return ordered.select("id", "v").mapInArrow(packed, "ids array<long>, x array<long>, low array<long>, high array<long>, total array<long>")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, in order, of the centroids that may be nearest to a vector in the box."""
    beyond = np.maximum(0, np.maximum(low - centroids, centroids - high))
    least = (beyond * beyond).sum(1)
    reach = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero(least <= (reach * reach).sum(1).min())


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest of the centroids ``among``."""
    c = centroids[among]
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2.0**53:
        y, c = x.astype(np.float64), c.astype(np.float64)
        d = ((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    at = d.argmin(1)  # the first of equals
    return among[at], d[np.arange(len(x)), at]


def _zones(batch: pa.RecordBatch):
    for ids, x, low, high, total in zip(*(batch.column(c) for c in ("ids", "x", "low", "high", "total")), strict=True):
        own = ids.values
        yield own, x.values.to_numpy().reshape(len(own), -1), low.values.to_numpy(), high.values.to_numpy(), total.values.to_numpy()


def move(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    shared = zones.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            for ids, x, low, high, whole in _zones(batch):
                among = candidates(low, high, c)
                if len(among) == 1:
                    count[among[0]] += len(ids)
                    total[among[0]] += whole
                    continue
                of, _ = nearest(x, c, among)
                for k in np.unique(of):
                    count[k] += (of == k).sum()
                    total[k] += x[of == k].sum(0)
        k = np.flatnonzero(count)
        parts = np.concatenate([count[k, None], total[k]], 1)  # the count goes as one more component
        number, place = (a.ravel() for a in np.meshgrid(k, np.arange(parts.shape[1]), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(parts.ravel(), pa.int64())], names=["k", "i", "n"])

    out = centroids.copy()
    sums: dict[int, dict[int, int]] = {}
    for r in zones.mapInArrow(run, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # a row for each centroid and component
        sums.setdefault(r["k"], {})[r["i"]] = r["n"]
    for k, own in sums.items():
        out[k] = [own[i] // own[0] for i in range(1, centroids.shape[1] + 1)]
    return out


def assign(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    shared = zones.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            for ids, x, low, high, _ in _zones(batch):
                of, distance = nearest(x, c, candidates(low, high, c))
                yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return zones.mapInArrow(run, "id long, cluster int, distance long")


def cluster(df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, block: int = BLOCK) -> tuple[DataFrame | None, np.ndarray]:
    """(assigned, centroids): (id, cluster, distance) of every vector that takes part, in a table of the shared folder, and the final centroids; None without any."""
    rows = integers(df, key, column, dims)
    first = rows.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    start = [r["v"] for r in first.orderBy("h", "v").limit(centroids).select("v").collect()]
    if not start:
        return None, np.zeros((0, dims), np.int64)
    edges = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("z")).orderBy("i").collect()  # a row for each component
    if max(max(-r["a"], r["z"]) for r in edges) >= LIMIT:
        raise ValueError(f"components beyond {LIMIT} after scaling: distances would not fit 64 bits")
    zones = stow(blocks(rows, [r["a"] for r in edges], [r["z"] for r in edges], block), "zones")
    now = np.array(start, np.int64)
    for _ in range(rounds):
        now = move(zones, now)
    assigned = stow(assign(zones, now), "assigned")
    forget(zones)
    return assigned, now


def digest(embeddings: DataFrame) -> DataFrame:
    spark = embeddings.sparkSession
    assigned, final = cluster(embeddings)
    if assigned is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    facts = [(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, final[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
