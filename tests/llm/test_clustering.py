import hashlib
import math
import random

import numpy as np
import pytest

from trackloom.llm import clustering as K

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, centroids=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in first[:centroids]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(now))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            now[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in last if k == c) for c in range(len(now))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, k, d, inertia[k], sum(inertia), digest[k]) for i, d, k in last), key=repr)


def result(df):
    return sorted((tuple(r) for r in K.digest(df).collect()), key=repr)


def vectors(n, seed, about=6):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(about)]
    return [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(middles)]) for i in range(n)]


def test_digest_equals_brute_force(spark):
    rows = vectors(300, 3) + [(None, [0.25] * 64), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [float("inf")] * 64), (905, [])]
    rows += rows[:5] + [(1, [0.5] * 64)] + [(1000 + i, [0.125] * 64) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as distance", "'x' as id", "3 as v")
    assert result(df) == brute(rows)


def test_small_and_empty_tables(spark):
    rows = [(5, [0.5] * 64), (6, [0.5] * 64), (7, [-0.1] * 64)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert K.digest(none).columns == K.digest(spark.createDataFrame(rows, SCHEMA)).columns and K.digest(none).count() == 0
    assert K.digest(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)).count() == 0


def test_large_components(spark):
    """Sums beyond 2 ** 53 are taken in integers; beyond 64 bits is an error."""
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randrange(-400_000, 400_000)) for _ in range(64)]) for i in range(60)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        K.digest(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA))


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_neighbours_along_the_curve_are_neighbours(dims, bits):
    points = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = [k.tobytes() for k in K.hilbert_keys(points, bits)]
    assert len(set(keys)) == len(points)
    walk = points[sorted(range(len(points)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_leave_no_nearest_centroid_out_and_save_work():
    rng = np.random.default_rng(4)
    middles = rng.integers(-200, 200, (12, 64))
    kept = total = 0
    for _ in range(200):
        x = middles[rng.integers(12)] + rng.integers(-5, 6, (50, 64))
        centroids = middles + rng.integers(-20, 20, (12, 64))
        among = K.candidates(x.min(0), x.max(0), centroids)
        of, d = K.nearest(x, centroids, among)
        want = ((x[:, None] - centroids) ** 2).sum(2)
        assert (of == want.argmin(1)).all() and (d == want.min(1)).all()
        kept, total = kept + len(among), total + 12
    assert kept < total / 4
