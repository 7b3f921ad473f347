import math
import random

from pyspark.sql import functions as F

from trackloom.llm import topk as T


def brute(rows, k=10):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, x in {(i, tuple(e)) for i, e in v if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.gauss(c, 0.3)) for c in rnd.choice([(0,) * 8, (1,) * 8, (-1, 1) * 4])]) for i in range(900)]
    rows = [(i, rows[7][1] if i % 3 == 0 else e) for i, e in rows]  # a vector that a third of the rows share
    rows += [(1000, None), (1100, [1.0] * 7 + [None]), (1200, [1.0] * 7 + [float("nan")]), (1300, [1.0]), (None, [1.0] * 8), (1400, [0.0] * 8), rows[5], (1500, [float("inf")] * 8), (1600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "'x' as cell")
    got = sorted(tuple(r) for r in T.digest(df).collect())
    assert got == brute(rows)
    small = T.search(df, F.col("vec_id") % 100 == 0, block=50, per_block=3, pivots=5)
    assert sorted(tuple(r) for r in small.collect()) == got


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in T.digest(df).collect()) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert T.digest(df.limit(0)).count() == 0


def test_query_rows_that_repeat(spark):
    rnd = random.Random(5)
    near = [(i, [rnd.uniform(0, 1) for _ in range(8)]) for i in range(1, 200)]
    rows = [(0, [90.0] * 8)] * 11 + [(100, [-90.0] * 8)] * 30 + [(i, e) for i, e in near if i != 100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.search(df, F.col("vec_id") % 100 == 0, pivots=200).collect())
    assert got == brute(rows) and len(got) == 20


def test_ties_at_the_last_rank_over_blocks(spark):
    """40 equal candidates over many blocks: the ten smallest ids are the result."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i % 3)]) for i in range(1, 41)] + [(i, [-1.0, 0.0]) for i in range(41, 60)]
    got = T.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, block=4, per_block=1)
    assert sorted(tuple(r) for r in got.collect()) == [(0, n, n, 1024 * 512) for n in range(1, 11)]


def test_very_long_vectors(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5000)]) for i in range(0, 500, 50)]
    got = sorted(tuple(r) for r in T.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows)


def test_clusters_are_pruned(spark):
    """200 tight clusters: a query goes to few of the cells, and the result stays exact."""
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, [x + rnd.gauss(0, 0.03) for x in centres[i % 60]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, summary, routed = T.routes(df, F.col("vec_id") % 100 == 0)
    share = routed.count() / (30 * len(summary))
    assert share < 0.35, share
    assert sorted(tuple(r) for r in T.digest(df).collect()) == brute(rows)
