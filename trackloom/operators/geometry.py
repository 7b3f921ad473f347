"""Crops of boxes, the best candidate of each, and its way back into the frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import area, finite, present
from ..schemas import FRAME_BUCKET, KEYPOINTS, SKELETON
from ..sources import frame_bucket
from ..sources.shared import stow
from .detections import keys_of

#: Fixed value: a crop has this many pixels at least on each side.
LEAST_CROP = 8


def clamp(df: DataFrame, width="width", height="height") -> DataFrame:
    """Adds cx1, cy1, cx2, cy2: corners rounded half to even; the near ones not below 0, the far ones not beyond the frame."""
    size = lambda x: F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    return df.withColumns({"cx1": F.greatest(F.lit(0.0), F.rint("x1")), "cy1": F.greatest(F.lit(0.0), F.rint("y1")), "cx2": F.least(size(width), F.rint("x2")), "cy2": F.least(size(height), F.rint("y2"))})


def large_enough(df: DataFrame, least: int = LEAST_CROP) -> DataFrame:
    """Without narrow, low and inverted crops."""
    return df.where((F.col("cx2") - F.col("cx1") >= least) & (F.col("cy2") - F.col("cy1") >= least))


def crop_requests(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """One crop for each tracked box of the frames at hand; ``frames`` has width and height for each frame."""
    keys = [k for k in keys_of(frames) if k in tracks.columns and k != "track_id"]
    return large_enough(clamp(tracks.join(frames, keys)))


def wanted_frames(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """Only frames with a tracked box.

    Frames stored by ``sources.write_frames`` lie in folders by bucket of frames: then the buckets that the tracks name are found first (written, so that their size
    is known), and Spark reads only these folders.
    """
    keys = [k for k in keys_of(frames) if k in tracks.columns and k != "track_id"]
    wanted = tracks.select(*keys).distinct()
    if FRAME_BUCKET in frames.columns:
        own = [k for k in keys if k != "frame"]
        buckets = stow(tracks.select(*own, frame_bucket().alias(FRAME_BUCKET)).distinct(), "buckets")
        frames = frames.join(buckets.where(f"{FRAME_BUCKET} >= 0"), [*own, FRAME_BUCKET], "left_semi")
    return frames.join(wanted, keys, "left_semi")


def best_of(candidates: DataFrame, order, keys=None) -> DataFrame:
    keys = keys or keys_of(candidates)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def best_face(candidates: DataFrame, threshold: float, keys=None) -> DataFrame:
    """Of each box the candidate with the largest score * area (ties: the first, by cand_id), then only those of ``threshold``.

    The threshold comes after the choice: a box whose best candidate scores too low has no face, whatever its runner-up.
    """
    weight = F.col("score") * (F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1"))
    return best_of(candidates.where(present(weight)), [weight.desc(), F.col("cand_id")], keys).where(F.col("score") >= threshold)


def best_pose(candidates: DataFrame, conf: float, keys=None) -> DataFrame:
    """Of each box's candidates of at least ``conf``, the one with the largest score * area. The threshold comes before the choice."""
    weight = F.col("score") * area(*(F.col(c) for c in ("bx1", "by1", "bx2", "by2")))
    return best_of(candidates.where(present(weight) & (F.col("score") >= conf)), [weight.desc(), F.col("cand_id")], keys)


def to_frame(df: DataFrame, points: str | None = None) -> DataFrame:
    """Crop coordinates (bx1 .. by2 and an array of structs ``points``) moved by the clamped origin; scores stay."""
    df = df.withColumns({c: F.col(c) + F.col(o) for c, o in (("bx1", "cx1"), ("by1", "cy1"), ("bx2", "cx1"), ("by2", "cy1"))})
    if points is None:
        return df
    fields = [f.name for f in df.schema[points].dataType.elementType.fields]
    moved = lambda p: F.struct(*((p[f] + F.col({"x": "cx1", "y": "cy1"}[f]) if f in ("x", "y") else p[f]).alias(f) for f in fields))
    return df.withColumn(points, F.transform(points, moved))


def default_scores(df: DataFrame, points: str = "keypoints") -> DataFrame:
    """Keypoints without any score count as seen (1.0)."""
    none = ~F.exists(points, lambda p: p["score"].isNotNull())
    return df.withColumn(points, F.when(none, F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1.0).alias("score")))).otherwise(F.col(points)))


def keypoint_rows(df: DataFrame) -> DataFrame:
    """Keys, point (index), x, y, score, visible: one row for each keypoint of a flat pose."""
    points = F.array(*(F.struct(*(F.col(f"pose_{n}_{a}").alias(a) for a in ("x", "y", "score"))) for n in KEYPOINTS))
    rows = df.where(present("pose_score")).select(*keys_of(df), F.posexplode(points).alias("point", "p"))
    return rows.select(*keys_of(df), "point", "p.x", "p.y", "p.score", visible("p.x", "p.y", "p.score").alias("visible"))


def visible(x: str, y: str, score: str):
    return F.coalesce((F.col(score) > 0) & ~F.isnan(score), F.lit(False)) & finite(F.col(x)) & finite(F.col(y))


def skeleton_edges(points: DataFrame) -> DataFrame:
    """``pose_edges`` of keypoints that lie in rows of their own (as from keypoint_rows, perhaps filtered since): they are grouped first."""
    keys = keys_of(points)
    seen = points.where("visible").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("point", F.struct("x", "y")))).alias("m"))
    edges = F.array(*(F.struct(F.lit(i).alias("edge"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(SKELETON)))
    rows = seen.select(*keys, "m", F.explode(edges).alias("e")).select(*keys, "e.edge", F.col("m")[F.col("e.a")].alias("p"), F.col("m")[F.col("e.b")].alias("q"))
    return rows.where("p is not null and q is not null").select(*keys, "edge", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def pose_edges(df: DataFrame) -> DataFrame:
    """Segments between two visible keypoints of a flat pose: keys, edge, ax, ay, bx, by. All of them lie in one row, so nothing is shuffled.

    Whether a keypoint is visible is found once each, though up to four edges end in it.
    """
    at = lambda n: tuple(f"pose_{n}_{x}" for x in ("x", "y", "score"))
    ends = sorted({KEYPOINTS[i] for edge in SKELETON for i in edge})
    seen = df.where(present("pose_score")).withColumns({f"_seen_{n}": visible(*at(n)) for n in ends})

    def segment(i: int, a: str, b: str):
        return F.when(F.col(f"_seen_{a}") & F.col(f"_seen_{b}"), F.struct(F.lit(i).alias("edge"), *(F.col(f"pose_{n}_{x}").alias(f"{c}{x}") for n, c in ((a, "a"), (b, "b")) for x in "xy")))

    edges = F.array(*(segment(i, KEYPOINTS[a], KEYPOINTS[b]) for i, (a, b) in enumerate(SKELETON)))
    rows = seen.select(*keys_of(df), F.explode(edges).alias("e")).where("e is not null")
    return rows.select(*keys_of(df), *(f"e.{c}" for c in ("edge", "ax", "ay", "bx", "by")))


def box_rect(df: DataFrame) -> DataFrame:
    """x, y, w, h of each box."""
    return df.select(*keys_of(df), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def apply_model(crops: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch_rows: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Score crops with a user's batch function; ``load`` runs once in each task and returns it. Crops of a frame stay together.

    batch_rows: the model is never given more rows at once (a device's memory bounds them), whatever Arrow's batches are. profile: what the
    stage that runs the model needs of its executors and tasks (a share of a GPU, more memory); the other stages keep the session's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            step = batch_rows or max(1, len(batch))
            for at in range(0, len(batch), step):
                yield model(batch.iloc[at : at + step].reset_index(drop=True))

    placed = crops.repartition(*[k for k in keys_of(crops) if k != "track_id"])
    return placed.mapInPandas(run, schema, profile=profile)
