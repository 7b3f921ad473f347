import heapq
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import from_half, present, to_half
from trackloom.operators import embeddings as E


def heap(rows, k):
    held = []
    for n, (frame, score) in enumerate(rows):
        if len(held) < k:
            heapq.heappush(held, (score, n, frame))
        elif score > held[0][0]:
            heapq.heapreplace(held, (score, n, frame))
    return {f for _, _, f in held}


def test_exact_ties_as_a_heap_leaves_them(spark):
    rnd = random.Random(1)
    rows = [(t, f, rnd.randrange(6) / 5) for t in range(60) for f in range(rnd.randrange(1, 30))]
    df = spark.createDataFrame(rows, "track_id long, frame long, score double")
    for k in (1, 4, 9):
        got = {}
        for r in E.top_k(df, k, ties="exact", keys=["track_id"]).collect():
            got.setdefault(r.track_id, set()).add(r.frame)
        assert got == {t: heap([(f, s) for u, f, s in rows if u == t], k) for t in range(60) if any(u == t for u, _, _ in rows)}


def test_top_k_cases(spark):
    df = spark.createDataFrame([(1, 0, 0.5, [1.0]), (1, 1, 0.9, [1.0]), (1, 2, 0.7, [1.0]), (1, 3, 0.99, None)], "track_id long, frame long, score double, embedding array<float>")
    assert [r.frame for r in E.best_first(E.top_k(df, 2, keys=["track_id"]), ["track_id"]).collect()] == [1, 2]
    assert E.top_k(df, 0).count() == 0
    nan = df.withColumn("embedding", F.array(F.lit(float("nan")).cast("float")))
    assert E.any_finite(nan).count() == 0 and E.any_finite(df).count() == 3


def test_align_takes_the_shorter_side(spark):
    raw = spark.createDataFrame([(1, [[0.0] * 4 + [5.0, 0.9, 0.0, 0.0], [0.0] * 4 + [6.0, 0.8, 0.0, 0.0]], [[1.0]]), (2, [[0.0] * 4 + [5.0, 0.9, 0.0, 0.0]], None), (3, [], [[1.0]])], "frame_idx long, tracks array<array<double>>, embeddings array<array<float>>")
    assert [tuple(r)[:3] for r in E.align(raw).collect()] == [(0, 5, 0.9)]


def test_half_precision_both_ways(spark):
    rnd = random.Random(2)
    values = [rnd.uniform(-1, 1) * 10 ** rnd.uniform(-8, 5) for _ in range(3000)] + [0.0, 65519.0, 65520.0, -65520.0, 2.0**-24, 2.0**-25, 6.1e-5]
    values = [float(np.float32(v)) for v in values]
    with np.errstate(over="ignore"):
        want = [float(np.float16(v)) for v in values]
    df = spark.createDataFrame(list(zip(values, [struct.pack("<e", w) for w in want], strict=True)), "x float, b binary")
    rows = df.select(to_half(F.col("x")).alias("h"), from_half(F.col("b")).alias("r")).collect()
    assert [r.h for r in rows] == want and [r.r for r in rows] == want


def test_identities(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.99, 0.05]), (3, 0, [0.0, 1.0]), (4, 0, [0.05, 0.99]), (5, 0, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "track_id long, frame long, embedding array<float>")
    means = E.track_means(df, ["track_id"])
    pairs = E.identity_pairs(means, 0.9)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (3, 4)}
    assert {r.track_id: r.identity for r in E.identities(means, pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    rnd = random.Random(3)
    more = spark.createDataFrame([(i, 0, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(80)], "track_id long, frame long, embedding array<float>")
    m = E.track_means(more, ["track_id"])
    vec = {r.track_id: r.mean for r in m.collect()}
    want = {(a, b) for a in vec for b in vec if a < b and sum(x * y for x, y in zip(vec[a], vec[b], strict=True)) >= 0.8}
    assert {(r.a, r.b) for r in E.identity_pairs(m, 0.8).collect()} == want and want


def test_present(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert df.where(present("x")).count() == 1


def test_identities_of_a_long_chain(spark):
    n = 300
    means = spark.range(n).select(F.col("id").alias("track_id"))
    pairs = spark.createDataFrame([((k * 7) % n, ((k + 1) * 7) % n) for k in range(n - 1)], "a long, b long")
    assert {r.identity for r in E.identities(means, pairs).collect()} == {0}
