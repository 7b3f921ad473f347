"""The best K embeddings of each track, and identities over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, present, to_half
from .detections import keys_of
from .graph import components
from .metric import within


def align(raw: DataFrame, first_frame: int = 1) -> DataFrame:
    """(input_id,) frame, track_id, score, embedding: embeddings go to the tracks at the same place; the shorter side wins."""
    n = F.least(F.size("tracks"), F.size("embeddings"))
    pairs = F.when(n > 0, F.arrays_zip(F.slice("tracks", 1, n).alias("t"), F.slice("embeddings", 1, n).alias("e")))
    rows = raw.select(*(["input_id"] if "input_id" in raw.columns else []), (F.col("frame_idx") - first_frame).alias("frame"), F.explode(pairs).alias("p"))
    return rows.select(*(c for c in rows.columns if c != "p"), F.get("p.t", F.lit(4)).cast("bigint").alias("track_id"), F.get("p.t", F.lit(5)).cast("double").alias("score"), F.col("p.e").alias("embedding"))


def any_finite(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Without vectors of missing elements only (tracks that were predicted, not seen)."""
    return df.where(F.exists(column, finite))


def top_k(df: DataFrame, k: int, ties: str = "simple", keys=None, arrival: str = "frame") -> DataFrame:
    """The k rows of each track with the highest scores.

    ties="simple": equal scores go by ``arrival``. ties="exact": as a heap of k fed by ``arrival`` leaves it: of the rows of the k-th
    score s, those among the first k arrivals of score s or more may stay, and of them the latest do.

    Every rank is cut at k, so that Spark cuts each task's rows before the shuffle: a track of very many rows is not gathered whole.
    """
    keys = keys or [c for c in keys_of(df) if c != "frame"]
    df = df.where(present("score") & (F.col("embedding").isNotNull() if "embedding" in df.columns else F.lit(True)))
    if k <= 0:
        return df.limit(0)
    of = Window.partitionBy(*keys)
    best = F.row_number().over(of.orderBy(F.desc("score"), arrival))
    simple = df.withColumn("_rank", best).where(F.col("_rank") <= k).drop("_rank")
    if ties == "simple":
        return simple
    least = simple.groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.min("score").alias("_kth"))
    among = df.join(least, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]).where("score >= _kth")
    first = among.withColumn("_order", F.row_number().over(of.orderBy(arrival))).where(F.col("_order") <= k).where("score = _kth")
    both = among.where("score > _kth").unionByName(first.drop("_order"))
    last = F.row_number().over(of.orderBy(F.desc("score"), F.desc(arrival)))
    return both.withColumn("_last", last).where(F.col("_last") <= k).select(*df.columns)


def best_first(df: DataFrame, keys=None) -> DataFrame:
    """Each track's rows together, best first."""
    keys = keys or [c for c in keys_of(df) if c != "frame"]
    return df.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"))


def half(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors rounded to half precision, kept as floats."""
    return df.withColumn(column, F.transform(column, to_half))


def track_means(df: DataFrame, keys=None) -> DataFrame:
    """keys and ``mean``: the mean vector of each track, scaled to length 1 (elements null if it is zero: such a track has no direction)."""
    keys = keys or [c for c in keys_of(df) if c != "frame"]
    parts = df.select(*keys, F.posexplode("embedding").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("mean", F.transform("mean", lambda x: F.try_divide(x, norm)))


def identity_pairs(means: DataFrame, least: float, key: str = "track_id") -> DataFrame:
    """(a, b, cosine) of tracks with a cosine of at least ``least``, a < b; means of length 1 (``metric.within``: pivots, rings and blocks)."""
    return within(means, least, key)


def identities(means: DataFrame, pairs: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, identity): connected tracks share the smallest key among them, however long the chain; a track without a partner has its own."""
    found = components(pairs.select("a", "b")).select(F.col("node").alias(key), F.col("component").alias("identity"))
    return means.select(key).join(found, key, "left").select(key, F.coalesce("identity", key).alias("identity"))
