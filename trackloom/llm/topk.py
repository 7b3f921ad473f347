"""Operator 7: exact top-k search by inner product, as a Voronoi kNN join.

Each component x counts as floor(1024 * x). Pivots (a sample of vectors: the square root of their number, at most ``PIVOTS``) part queries and
data into cells. Each cell is summed up by its count, its radius (largest distance of a member from the pivot) and its largest
norm. From these a query has, for each cell, a lower bound of every member's score (q.p - |q| r) and an upper bound
(the less of q.p + |q| r and |q| * norm). The lower bounds of cells that hold k rows of other ids together bound the query's
k-th score from below, and the query is sent only to cells whose upper bound reaches it: only the necessary pairs of groups
meet. A cell is cut into blocks of about ``BLOCK`` rows and its queries into blocks of about ``QUERIES``, so one hot cell (many equal
vectors) is dealt over many tasks; each pair of blocks is solved locally, and the best k of its blocks are a query's result.

The result is exact: bounds only save work, as far as the data lie in clusters (vectors that point everywhere alike leave no cell out: README). Scores are sums of integers, in 64-bit floats while they are exact (below 2 ** 53),
else in 64-bit integers.

Vectors that are null, hold null or non-finite components or have no vec_id take no part; one shorter than the longest counts as zero in
the components that it lacks. Ties go to the smaller vec_id; repeated rows are candidates each and one query; fewer than k others give fewer rows; an empty table
gives none. Columns other than those named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stow

K, PIVOTS, BLOCK, QUERIES, SCALE = 10, 128, 4096, 2048, 1024


def integers(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    ok = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & ok).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    longest = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    return rows.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v"))).alias("v"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 1)


def cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, far, norm): the nearest pivot, the distance from it, and the length."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        for batch in batches:
            x = matrix(batch.column("v"), batch.num_rows).astype(np.float64)
            if not len(x):
                continue
            square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
            cell = square.argmin(1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], names=["id", "v", "cell", "far", "norm"])

    return rows.mapInArrow(run, "id long, v array<long>, cell int, far double, norm double")


def route(queries: DataFrame, pivots: np.ndarray, summary: list, k: int) -> DataFrame:
    """(id, v, cell) of the cells that may hold one of a query's best k; ``own`` of ``queries``: how many rows have its id."""
    cell = np.array([r["cell"] for r in summary])
    shared = queries.sparkSession.sparkContext.broadcast((pivots[cell], cell, *(np.array([r[c] for r in summary], float) for c in ("n", "radius", "length"))))

    def run(batches):
        p, cell, n, radius, length = shared.value
        for batch in batches:
            q = matrix(batch.column("v"), batch.num_rows).astype(np.float64)
            if not len(q):
                continue
            norm = np.sqrt((q * q).sum(1))[:, None]
            middle, slack = q @ p.T, 1e-9 * norm * (length + radius) + 1e-6
            low, high = middle - norm * radius - slack, np.minimum(middle + norm * radius, norm * length) + slack
            order = np.argsort(-low, axis=1)
            own = batch.column("own").to_numpy()[:, None]
            enough = np.cumsum(n[order], axis=1) >= k + own  # so many of them may be the query's own rows
            at = np.where(enough.any(1), enough.argmax(1), len(cell) - 1)
            bound = np.where(enough.any(1), np.take_along_axis(low, order, 1)[np.arange(len(q)), at], -np.inf)
            row, c = np.nonzero(high >= bound[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell[c].astype(np.int32))], names=["id", "v", "cell"])

    return queries.mapInArrow(run, "id long, v array<long>, cell int")


def solve(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's best k of a block, by score, then by id."""
    exact = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * data.shape[1] < 2.0**53
    score = (queries.astype(float) @ data.T.astype(float)).astype(np.int64) if exact else queries @ data.T
    out = []
    for q, s in zip(query_ids.tolist(), score, strict=True):
        others = np.flatnonzero(ids != q)
        own = s[others]
        if len(own) > k:
            keep = own >= np.partition(own, len(own) - k)[len(own) - k]
            others, own = others[keep], own[keep]
        best = np.lexsort((ids[others], -own))[:k]
        out.append((np.full(len(best), q), ids[others][best], own[best]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def routes(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS) -> tuple[DataFrame, list, DataFrame]:
    """(placed, summary, routed): rows with their cells, a summary of each cell, and the cells that each query is sent to."""
    rows = integers(df, key, column)
    pivots = min(pivots, max(16, math.isqrt(rows.count())))
    chosen = np.array(sorted({tuple(r[0]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()}), np.float64)
    if not len(chosen):
        return rows, [], rows
    placed = stow(cells(rows, chosen), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("length")).orderBy("cell").collect()  # a row for each pivot
    queries = placed.withColumnRenamed("id", key).where(is_query).select(F.col(key).alias("id"), "v")
    queries = queries.distinct().join(queries.groupBy("id").agg(F.count("*").alias("own")), "id").select("id", "v", "own")
    return placed, summary, stow(route(queries, chosen, summary, k), "routed")


def search(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, per_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (of ``key``) admits, its k best others."""
    spark = df.sparkSession
    placed, summary, routed = routes(df, is_query, k, key, column, pivots)
    if not summary:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = {r[0]: r[1] for r in routed.groupBy("cell").count().collect()}
    blocks = F.create_map(*(F.lit(x) for r in summary for x in (r["cell"], max(1, -(-r["n"] // block)))))
    shares = F.create_map(*(F.lit(x) for r in summary for x in (r["cell"], -(-asked.get(r["cell"], 0) // per_block))))
    of = lambda parts: F.pmod(F.xxhash64("id"), parts[F.col("cell")]).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1))
    data = placed.where(shares[F.col("cell")] > 0).select("id", "v", "cell", of(blocks).alias("b"), every(shares).alias("s"))
    asking = routed.select("id", "v", "cell", every(blocks).alias("b"), of(shares).alias("s"))

    def meet(key_of, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (matrix(t.column("v").combine_chunks(), t.num_rows) for t in (left, right))
        if not len(x) or not len(y):
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = solve(left.column("id").to_numpy(), x, right.column("id").to_numpy(), y, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    met = data.groupBy("cell", "b", "s").cogroup(asking.groupBy("cell", "b", "s")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
