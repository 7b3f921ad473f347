"""Gaze, video and audio on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import present
from ..sources import stack

FPS = 25.0


def on_timeline(df: DataFrame, inputs: DataFrame, local: Column | None = None) -> DataFrame:
    """Adds t_exp: local seconds plus the input's time_offset. ``inputs``: input_id, time_offset and, if known, fps."""
    if local is None:
        local = F.col("frame") / (F.coalesce(F.col("fps"), F.lit(FPS)) if "fps" in inputs.columns else F.lit(FPS))
    own = inputs.select("input_id", "time_offset", *(["fps"] if "fps" in inputs.columns and "fps" not in df.columns else []))
    return df.join(own, "input_id").withColumn("t_exp", local + F.col("time_offset"))


def seen(x: str = "gaze_x", y: str = "gaze_y") -> Column:
    """Whether a sample says where the eye looked: both coordinates are there, and neither is NaN."""
    return present(F.col(x).cast("double")) & present(F.col(y).cast("double"))


def valid_gaze(gaze: DataFrame) -> DataFrame:
    """The samples that say where the eye looked; blinks and lost samples go, as does a sample of one coordinate."""
    return gaze.where(seen())


def gaze_summary(gaze: DataFrame, time: str = "gaze_video_time", by: str = "participant", bucket: float = 60_000.0) -> DataFrame:
    """Of each participant: samples, valid ones, gaps and the whole and largest interval between samples.

    Samples are summed by participant and bucket of time, then over the buckets of each: a long recording is dealt over many tasks.
    """
    step = F.col(time) - F.lag(time).over(Window.partitionBy(by, "_bucket").orderBy(time))
    rows = gaze.withColumns({"_bucket": F.floor(F.col(time) / bucket), "_valid": seen()}).withColumn("_step", step)
    parts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("n"), F.count_if("_valid").alias("v"), F.count(time).alias("t"), F.min(time).alias("a"), F.max(time).alias("z"), F.max("_step").alias("_step"))
    parts = parts.withColumn("_gap", F.col("a") - F.lag("z").over(Window.partitionBy(by).orderBy("_bucket")))
    whole = F.when(F.sum("t") > 1, F.max("z") - F.min("a"))
    return parts.groupBy(by).agg(F.sum("n").alias("samples"), F.sum("v").alias("valid"), (F.sum("n") - F.sum("v")).alias("missing"), F.min("a").alias("first_time"), F.max("z").alias("last_time"), F.greatest(F.max("_step"), F.max("_gap")).alias("largest_step"), whole.alias("total_step"))


def asof(frames: DataFrame, samples: DataFrame, by: list[str], time: str, tolerance: float | None, values: list[str], bucket: float = 60_000.0) -> DataFrame:
    """Each frame with the latest sample at or before it, at most ``tolerance`` earlier (null: however long ago); else null.

    Frames and samples are dealt by ``by`` and time bucket, so a recording is as many tasks as it has buckets, however long it is. With a tolerance that is the bucket, and
    each sample is put in the next one too. Without, each bucket's last sample is carried over its end: one row a bucket is ordered within a
    recording, and a frame with no sample before it in its own bucket has the one carried to it. Of samples at one time the last by value stands.
    """
    width = bucket if tolerance is None else tolerance
    own = F.floor(F.col(time) / width)
    sample = F.struct(F.col(time).alias("t"), *values)
    kind = samples.select(sample.alias("s")).schema["s"].dataType.simpleString()
    left = frames.withColumns({"_bucket": own, "_kind": F.lit(1), "_s": F.lit(None).cast(kind)})
    touched = F.array(own) if tolerance is None else F.array(own, own + 1)
    right = samples.where(F.col(time).isNotNull()).select(*by, F.col(time), sample.alias("_s"), F.explode(touched).alias("_bucket"), F.lit(0).alias("_kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*by, "_bucket").orderBy(time, "_kind", "_s").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_last", F.last("_s", ignorenulls=True).over(order)).where("_kind = 1")
    if tolerance is None:
        carried = _carried(left.select(*by, "_bucket"), right.select(*by, "_bucket", "_s"), by, kind)
        same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"carried.{c}")) for c in (*by, "_bucket")]
        rows = rows.alias("rows").join(carried.alias("carried"), same, "left").select("rows.*", F.col("carried._before"))
        rows = rows.withColumn("_last", F.coalesce("_last", "_before"))
        near = F.lit(True)
    else:
        near = F.col(time) - F.col("_last.t") <= tolerance
    return rows.select(*frames.columns, F.when(near, F.col("_last.t")).alias("sample_time"), *(F.when(near, F.col(f"_last.{v}")).alias(v) for v in values))


def _carried(frames: DataFrame, samples: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, _bucket, _before): for each bucket with frames, the last sample of the buckets before it."""
    last = samples.groupBy(*by, "_bucket").agg(F.max("_s").alias("_s"), F.lit(False).alias("_asked"))
    asked = frames.groupBy(*by, "_bucket").agg(F.lit(None).cast(kind).alias("_s"), F.lit(True).alias("_asked"))
    ends = last.unionByName(asked).groupBy(*by, "_bucket").agg(F.max("_s").alias("_s"), F.bool_or("_asked").alias("_asked"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("_before", F.last("_s", ignorenulls=True).over(before)).where("_asked and _before is not null").select(*by, "_bucket", "_before")


def gaze_hits(gaze: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Gaze points with the tracked box that holds them (edges count); of several the smallest, then the smallest track_id."""
    inside = F.col("gaze_x").between(F.col("x1"), F.col("x2")) & F.col("gaze_y").between(F.col("y1"), F.col("y2"))
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    points = [c for c in gaze.columns if c not in keys]
    hits = gaze.join(tracks.select(*keys, "track_id", "x1", "y1", "x2", "y2"), keys).where(inside)
    best = hits.groupBy(*keys, *points).agg(F.min(F.struct(size.alias("size"), F.col("track_id"))).alias("b"))
    return best.select(*keys, *points, F.col("b.track_id").alias("track_id"))


#: Buckets of an interval: their width grows by GROWTH from level to level; an interval's own level is the first at which it touches at most GROWTH + 1.
GROWTH, LEVELS = 8, 8


def _buckets(start: str, end: str, bucket: float, top: int) -> tuple[Column, Column]:
    """The level of [start, end), and its buckets (level, cell) at that level and, each wider than the last, at all above it up to ``top``."""
    length = F.col(end) - F.col(start)
    level = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        level = F.when(length <= bucket * GROWTH ** (k + 1), F.lit(k)).otherwise(level)
    empty = F.array().cast("array<struct<level:int,cell:bigint>>")
    cells = [F.when(level <= k, _touched(start, end, bucket, k)).otherwise(empty) for k in range(top + 1)]
    return level, F.flatten(F.array(*cells))


def _touched(start: str, end: str, bucket: float, level: int) -> Column:
    """The buckets (level, cell) of one level that [start, end) touches."""
    size = bucket * float(GROWTH**level)
    first = F.floor(F.col(start) / size)
    return F.transform(F.sequence(first, F.greatest(first, F.ceil(F.col(end) / size) - 1)), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))


def _dealt(segments: DataFrame, frames: DataFrame, bucket: float, top: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a row for each bucket (_level, _cell) in which an interval may meet one of the other side."""

    def levelled(df: DataFrame, start: str, end: str, own: str) -> DataFrame:
        level, cells = _buckets(start, end, bucket, top)
        cells = F.when(level <= top, cells).otherwise(_touched(start, end, bucket, top))  # a longer one is cut as finely as the top is
        return df.where(F.col(end) > F.col(start)).withColumns({own: F.least(level, F.lit(top)), "_cells": cells})

    def dealt(df: DataFrame, own: str, other: DataFrame, others: str) -> DataFrame:
        there = F.broadcast(other.agg(F.collect_set(others).alias("_there")))
        meets = lambda b: F.when(b["level"] == F.col(own), F.array_min("_there") <= F.col(own)).otherwise(F.array_contains("_there", b["level"]))
        rows = df.crossJoin(there).withColumn("_b", F.explode(F.filter("_cells", meets)))
        return rows.withColumns({"_level": F.col("_b.level"), "_cell": F.col("_b.cell")}).drop("_b", "_cells", "_there")

    segments, frames = levelled(segments, "seg_start", "seg_end", "_own"), levelled(frames, "f_start", "f_end", "_of")
    return dealt(segments, "_own", frames, "_of"), dealt(frames, "_of", segments, "_own")


def segment_frames(segments: DataFrame, frames: DataFrame, by: str, bucket: float = 1.0, top: int = LEVELS) -> DataFrame:
    """Frames [f_start, f_end) and segments [seg_start, seg_end) of one ``by`` that overlap.

    Buckets come in levels, from ``bucket`` seconds upwards, each GROWTH times as wide as the last. An interval has a level of its own, the first at which it touches few
    buckets, and is put in the buckets that it touches there and at the levels above: a segment of a day is some ten rows, not one a
    second. Two intervals meet at the higher of their levels, where the longer one is cut into parts of about its eighth; a pair is
    kept in the first bucket that both touch. Of the levels above its own an interval is put only in those that intervals of the other side have as theirs. Levels above ``top`` are not made: a caller whose frames and segments are all short can save rows by it, longer ones are then cut finer.
    """
    top = min(top, LEVELS)

    left, right = _dealt(segments, frames, bucket, top)
    met = left.join(right, [by, "_level", "_cell"]).where("_level = greatest(_own, _of) and seg_start < f_end and f_start < seg_end")
    first = F.floor(F.greatest("seg_start", "f_start") / (bucket * F.pow(F.lit(float(GROWTH)), F.col("_level"))))
    return met.where(F.col("_cell") == first).drop("_level", "_cell", "_own", "_of")


def segment_totals(segments: DataFrame, frames: DataFrame, by: str, keys: list[str], value: str = "frame", bucket: float = 60.0) -> DataFrame:
    """Of each ``keys`` of segments with a frame that overlaps (as in ``segment_frames``): n, how many do, the ``first`` value and the ``total`` of the values, without a row for each pair.

    Values are whole numbers that rise with f_start within a ``by``, as frame numbers do. The frames that a segment overlaps are those that begin before its end and end after its start: all frames,
    less those that begin too late and those that end too early. So each interval is two rows, whatever its length: starts of frames are ordered with ends of segments, and ends of frames with
    starts of segments, backwards in time. Both are dealt by ``by`` and bucket of time; a bucket begins with the sums of those before it, of which one row a bucket is ordered within a recording.
    """
    begins, ends = F.struct(F.col("f_start").alias("at"), F.col(value).alias("value")), "struct<at:double,value:bigint>"
    ask = [F.struct(F.lit(0).alias("side"), (F.lit(0.0) - F.col("seg_start")).alias("x"), F.col("seg_end").cast("double").alias("until")), F.struct(F.lit(1).alias("side"), (F.lit(0.0) + F.col("seg_end")).alias("x"), F.lit(None).cast("double").alias("until"))]
    own = [F.struct(F.lit(0).alias("side"), (F.lit(0.0) - F.col("f_end")).alias("x"), begins.cast(ends).alias("first")), F.struct(F.lit(1).alias("side"), (F.lit(0.0) + F.col("f_start")).alias("x"), F.lit(None).cast(ends).alias("first"))]

    def dealt(df: DataFrame, start: str, end: str, sides: list[Column], *more) -> DataFrame:
        rows = df.where(present(F.col(start).cast("double")) & present(F.col(end).cast("double")) & (F.col(end) > F.col(start)) & F.col(by).isNotNull())
        rows = rows.select(F.col(by).alias("_by"), *more, F.explode(F.array(*sides)).alias("_s"))
        return rows.select("_by", *(c for c in rows.columns if c not in ("_by", "_s")), "_s.*").withColumn("bucket", F.floor(F.col("x") / bucket))

    asked = dealt(segments, "seg_start", "seg_end", ask, *keys)
    given = dealt(frames, "f_start", "f_end", own, F.lit(1).cast("bigint").alias("n"), F.col(value).cast("bigint").alias("v"))
    whole = given.groupBy("_by", "side", "bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.min("first").alias("first"))
    places = whole.unionByName(asked.select("_by", "side", "bucket").distinct(), allowMissingColumns=True).groupBy("_by", "side", "bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.min("first").alias("first"))
    before, side = Window.partitionBy("_by", "side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_by", "side")
    less = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) - F.when(F.col("side") == 0, F.coalesce(F.sum(c).over(side), F.lit(0))).otherwise(0)
    carried = places.select("_by", "side", "bucket", less("n").alias("n0"), less("v").alias("v0"), F.min("first").over(before).alias("first0"))
    order = Window.partitionBy("_by", "side", "bucket").orderBy("x", "n").rowsBetween(Window.unboundedPreceding, 0)  # at one time those that ask come first
    sums = asked.unionByName(given, allowMissingColumns=True).withColumns({"n1": F.sum("n").over(order), "v1": F.sum("v").over(order), "first1": F.min("first").over(order)})
    met = sums.where("n is null").join(carried, ["_by", "side", "bucket"]).withColumn("_first", F.least("first0", "first1"))
    count, total = (F.sum(F.col(f"{c}0") + F.coalesce(f"{c}1", F.lit(0))) for c in "nv")
    found = met.groupBy(*keys).agg(count.alias("n"), F.min(F.when(F.col("_first.at") < F.col("until"), F.col("_first.value"))).alias("first"), total.alias("total"))
    return found.where("n > 0")


def attribute_audio(segments: DataFrame, inputs: DataFrame) -> DataFrame:
    """Segments with the glasses input that their audio belongs to; audio without a reference has none."""
    audio = inputs.where("kind = 'audio'").select(F.col("id").alias("audio_id"), F.col("glasses_video").alias("participant_input"), "time_offset")
    return segments.join(audio, "audio_id", "left")


def experiment_table(tables: dict[str, DataFrame], inputs: DataFrame) -> DataFrame:
    """All inputs' results in one table, with input_id and t_exp."""
    return on_timeline(stack([df.withColumn("input_id", F.lit(i)) for i, df in sorted(tables.items())]), inputs)
