"""Counts over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import present


#: Buckets of frames in a wide one, in which runs over the edges of buckets are put together.
BUCKETS_IN_ONE = 4096


def tracking(df: DataFrame, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct("track_id").alias("tracks"), F.count("*").alias("detections"))


def found(df: DataFrame, score: str, by=()) -> DataFrame:
    """How many detections have a face (``face_score``) or a pose (``pose_score``)."""
    return df.groupBy(*by).agg(F.count_if(present(score)).alias("found"), F.count("*").alias("detections"))


def coverage(df: DataFrame, by=("track_id",), frames: bool = False) -> DataFrame:
    """Of each track the frames it spans: first, last, how many; with ``frames`` also which, in one array (for short tracks: ``runs`` has no such bound)."""
    out = [F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.countDistinct("frame").alias("n_frames")]
    return df.groupBy(*by).agg(*out, *([F.array_sort(F.collect_set("frame")).alias("frames")] if frames else []))


def runs(df: DataFrame, by=("track_id",), bucket: int = 10_000) -> DataFrame:
    """Of each track its runs of frames without a gap: first_frame, last_frame (gaps and islands; repeated frames count once).

    Frames are dealt by track and bucket of frames, those beside a bucket's edge to both sides of it, and each bucket finds its own runs and whether they go on beyond its edges. Runs inside it
    are whole. Of others only true ends are kept: at most a first and a last frame a bucket, which follow each other in turn. They are paired in wide buckets of BUCKETS_IN_ONE each, and those left over there,
    again two at most, within a track. No row or task holds all frames or all runs of a track.
    """
    by, frame, place = list(by), F.col("frame"), F.floor(F.col("frame") / bucket)
    low, high = F.col("_bucket") * bucket, (F.col("_bucket") + 1) * bucket - 1
    seen = df.where("frame is not null").select(*by, frame.cast("bigint").alias("frame"))
    seen = seen.select(*by, "frame", F.explode(F.array_distinct(F.array(place, F.floor((frame - 1) / bucket), F.floor((frame + 1) / bucket)))).alias("_bucket")).distinct()
    island = frame - F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("frame"))
    parts = seen.withColumn("_island", island).groupBy(*by, "_bucket", "_island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    parts = parts.where((F.col("first_frame") <= high) & (F.col("last_frame") >= low))  # others are of frames beside the bucket alone
    begins, ends = F.col("first_frame") >= low, F.col("last_frame") <= high
    whole = parts.where(begins & ends).select(*by, "first_frame", "last_frame")
    edges = parts.where(begins != ends).select(*by, F.when(begins, F.col("first_frame")).otherwise(F.col("last_frame")).alias("frame"), begins.alias("_begins"))
    paired, left = _paired(edges, by, bucket * BUCKETS_IN_ONE)
    last = F.lead("frame").over(Window.partitionBy(*by).orderBy("frame", F.desc("_begins")))
    left = left.withColumn("_next", last).where("_begins").select(*by, F.col("frame").alias("first_frame"), F.col("_next").alias("last_frame"))
    return whole.unionByName(paired).unionByName(left)


def _paired(edges: DataFrame, by: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Runs whose first and last frame are in one bucket of ``width`` frames, and the edges left over: at most two a bucket."""
    order = Window.partitionBy(*by, "_bucket").orderBy("frame", F.desc("_begins"))
    wide = edges.withColumn("_bucket", F.floor(F.col("frame") / width)).withColumns({"_next": F.lead("frame").over(order), "_before": F.lag("frame").over(order)})
    paired = wide.where("_begins and _next is not null").select(*by, F.col("frame").alias("first_frame"), F.col("_next").alias("last_frame"))
    return paired, wide.where("_begins and _next is null or not _begins and _before is null").select(*by, "frame", "_begins")
