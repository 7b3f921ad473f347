"""Pairs of unit vectors within a cosine, as a metric partition join.

A cosine of ``least`` or more means a distance of at most r = sqrt(2 - 2 * least). Pivots (vectors taken in order of a hash: four times the square root of their
number, at most ``PIVOTS``) part the vectors into cells, each summed up by its members' least and greatest distance from the pivot.

1. A vector goes to its own cell, and is sent on to a later cell only if a member there may be within r: by the cell's ring of
   distances (they differ by at most r) and by the plane between the pivots (the vector is at most 2 r nearer to its own).
2. Cells are cut into blocks of at most ``BLOCK`` vectors in order of the distance from the pivot, by range partitions of (cell, distance,
   hash), so a cell with a third of all vectors is dealt over many tasks, and so are equal vectors.
3. Two blocks of a cell meet if their ranges of distance are within r. Each pair of blocks is a task's group of its own, and compares all its
   vectors at once.

Every pair is found once: in one cell by the order of cells, and in one pair of blocks by the order of blocks. What is broadcast is the pivots and
a row for each of them. The result is exact; bounds only save work as far as the vectors lie in clusters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..sources.shared import forget, stow

PIVOTS, BLOCK = 4096, 2048


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _prepared(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v array<double>) of one length; vectors that are null or hold missing elements take no part."""
    good = rows.where(F.col(key).isNotNull() & F.col(column).isNotNull() & F.forall(column, finite))
    own = good.select(F.col(key).alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v"))
    longest = max(1, own.agg(F.max(F.size("v"))).first()[0] or 0)
    return own.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))).alias("v"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)))


def _place(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """(id, v, cell, far): the nearest pivot and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(matrix(batch.column("v"), batch.num_rows), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "far"])

    return rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, far double")


def _send(placed: DataFrame, pivots: np.ndarray, rings: list, r: float, kind: str) -> DataFrame:
    """(id, v, cell, far): the later cells that may hold a partner, and the distance from their pivots."""
    cells = np.array([x["cell"] for x in rings])
    shared = placed.sparkSession.sparkContext.broadcast((pivots[cells], cells, np.array([x["low"] for x in rings]), np.array([x["high"] for x in rings])))

    def run(batches):
        p, cells, low, high = shared.value
        for batch in batches:
            if batch.num_rows:
                d, home, far = _distances(matrix(batch.column("v"), batch.num_rows), p), batch.column("cell").to_numpy(), batch.column("far").to_numpy()
                row, c = np.nonzero((cells > home[:, None]) & (d >= low - r) & (d <= high + r) & (d <= far[:, None] + 2 * r))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cells[c], pa.int32()), pa.array(d[row, c])], names=["id", "v", "cell", "far"])

    return placed.mapInArrow(run, f"id {kind}, v array<double>, cell int, far double")


def _blocked(rows: DataFrame, kind: str, block: int, sent: bool) -> DataFrame:
    """``rows`` with their block: runs of at most ``block`` rows of one cell in order of the distance. Blocks of rows that were sent have odd numbers."""

    def run(batches):
        task, number, held, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            cell, of = batch.column("cell").to_numpy(), np.empty(batch.num_rows, np.int64)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            for b, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
                if last is not None and cell[b] != last:
                    number, held = number + 1, 0
                full = held + np.arange(e - b)
                of[b:e] = (task << 32) + ((number + full // block) << 1) + sent
                number, held, last = number + int((held + e - b - 1) // block), (held + e - b - 1) % block + 1, cell[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "cell", "far")), pa.array(of)], names=["id", "v", "cell", "far", "block"])

    ordered = rows.withColumn("h", F.xxhash64("id")).repartitionByRange("cell", "far", "h").sortWithinPartitions("cell", "far", "h").drop("h")
    return ordered.mapInArrow(run, f"id {kind}, v array<double>, cell int, far double, block long")


def block_pairs(rows: DataFrame, least: float, key: str, column: str, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(members, asking, pairs): rows in blocks, rows that ask (members and those sent on), and the pairs of blocks (block, other) that may hold partners."""
    r = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    own = stow(_prepared(rows, key, column), "vectors")
    kind = own.schema["id"].dataType.simpleString()
    n = own.count()
    if not n:
        return None
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(min(pivots, n, 4 * math.isqrt(n))).select("v").collect()
    centres = np.unique(np.array([x[0] for x in chosen]), axis=0)
    placed = stow(_place(own, centres, kind), "placed")
    rings = placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell").collect()  # a row for each pivot
    members = stow(_blocked(placed, kind, block, False), "members")
    sent = stow(_blocked(_send(placed, centres, rings, r, kind), kind, block, True), "sent")
    forget(own, placed)
    facts = lambda df: df.groupBy("block").agg(F.first("cell").alias("cell"), F.min("far").alias("low"), F.max("far").alias("high"))
    left = stow(facts(members), "blocks")
    right = facts(sent).union(left).select(F.col("block").alias("other"), "cell", F.col("low").alias("from"), F.col("high").alias("to"))
    near = (F.col("from") <= F.col("high") + r) & (F.col("low") <= F.col("to") + r)
    pairs = left.join(right, "cell").where(near & ((F.col("other") % 2 == 1) | (F.col("other") >= F.col("block")))).select("block", "other")
    return members, sent.union(members), stow(pairs, "block-pairs")


def within(rows: DataFrame, least: float, key: str, column: str = "mean", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) of all pairs with a cosine of at least ``least``, a < b; vectors of length 1, keys unique.

    Null keys, null vectors and vectors with missing elements have no partners; shorter vectors count as zero in the components they lack.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    schema = f"a {kind}, b {kind}, cosine double"
    made = block_pairs(rows, least, key, column, pivots, block)
    if made is None:
        return spark.createDataFrame([], schema)
    members, asking, pairs = made

    def meet(at, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            i = j = np.zeros(0, np.int64)
            cosine = np.zeros((0, 0))
        else:
            cosine = matrix(left["v"], left.num_rows) @ matrix(right["v"], right.num_rows).T
            hit = cosine >= least
            i, j = np.nonzero(np.triu(hit, 1) if at[0] == at[1] else hit)
        first, second = left["id"].take(pa.array(i)), right["id"].take(pa.array(j))
        return pa.table({"x": first, "y": second, "cosine": pa.array(cosine[i, j] if len(i) else np.zeros(0))})

    left = members.select("id", "v", "block").join(pairs, "block")
    right = asking.select("id", "v", F.col("block").alias("other")).join(pairs, "other").select("id", "v", "block", "other")
    # rows of a block on both sides of itself must come in one order
    found = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(_in_order(meet), f"x {kind}, y {kind}, cosine double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def _in_order(f):
    return lambda at, left, right: f(at, left.sort_by("id"), right.sort_by("id"))


def share_compared(rows: DataFrame, least: float, key: str, column: str = "mean", pivots: int = PIVOTS, block: int = BLOCK) -> float:
    """Of all pairs of rows, the share that ``within`` compares."""
    made = block_pairs(rows, least, key, column, pivots, block)
    if made is None:
        return 0.0
    members, asking, pairs = made
    sizes = members.groupBy("block").agg(F.count("*").cast("double").alias("n"))
    others = asking.groupBy(F.col("block").alias("other")).agg(F.count("*").cast("double").alias("m"))
    met = pairs.join(sizes, "block").join(others, "other").agg(F.sum(F.when(F.col("block") == F.col("other"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")))).first()[0] or 0.0
    n = members.count()
    return met / max(1.0, n * (n - 1) / 2)
