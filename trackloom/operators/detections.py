"""Nested per-frame results to flat rows and back, joins onto tracks, lookups by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null, present
from ..schemas import CORNERS, FACE_COLUMNS, KEYPOINTS, KEYS, LANDMARKS, POSE_COLUMNS, TRACK_COLUMNS


def keys_of(df: DataFrame, keys=KEYS) -> list[str]:
    """The keys that ``df`` has; a table of a single input may lack input_id."""
    return [k for k in keys if k in df.columns]


def _carried(df: DataFrame, nested: str) -> list[str]:
    return [c for c in df.columns if c not in (nested, "frame_idx", "frame", "embeddings")]


def flatten_tracks(raw: DataFrame, classes: list[int] | None = None, first_frame: int = 1) -> DataFrame:
    """One row for each track of a frame: x1, y1, x2, y2, id, conf, cls, det_ind by position; cls and det_ind are dropped.

    ``classes`` keeps those object classes only. Frames count from ``first_frame`` in ``raw`` and from 0 in the result.
    """
    rows = raw.select(*_carried(raw, "tracks"), (F.col("frame_idx") - first_frame).alias("frame"), F.explode("tracks").alias("t"))
    if classes is not None:
        rows = rows.where(F.get("t", F.lit(6)).cast("int").isin(classes))
    at = {"x1": 0, "y1": 1, "x2": 2, "y2": 3, "track_id": 4, "conf": 5}
    kinds = {"track_id": "bigint"}
    return rows.select(*_carried(raw, "tracks"), F.col("frame").cast("bigint").alias("frame"), *(F.get("t", F.lit(at[c])).cast(kinds.get(c, "double")).alias(c) for c in TRACK_COLUMNS[1:]))


def _box(item: str, prefix: str) -> list:
    return [nan_to_null(F.col(f"{item}.box.{c}").cast("double")).alias(f"{prefix}_{c}") for c in CORNERS]


def flatten_faces(raw: DataFrame) -> DataFrame:
    rows = raw.select(*_carried(raw, "faces"), F.col("frame_idx").cast("bigint").alias("frame"), F.explode("faces").alias("f"))
    marks = [F.get("f.landmarks", F.lit(i))[a].cast("double").alias(f"{name}_{a}") for i, name in enumerate(LANDMARKS) for a in "xy"]
    return rows.select(*_carried(raw, "faces"), "frame", F.col("f.box.track_id").cast("bigint").alias("track_id"), F.col("f.score").cast("double").alias("face_score"), *_box("f", "face"), *marks)


def flatten_poses(raw: DataFrame) -> DataFrame:
    rows = raw.select(*_carried(raw, "poses"), F.col("frame_idx").cast("bigint").alias("frame"), F.explode("poses").alias("p"))
    points = [F.get("p.keypoints", F.lit(i))[a].cast("double").alias(f"pose_{name}_{a}") for i, name in enumerate(KEYPOINTS) for a in ("x", "y", "score")]
    return rows.select(*_carried(raw, "poses"), "frame", F.col("p.box.track_id").cast("bigint").alias("track_id"), F.col("p.score").cast("double").alias("pose_score"), *_box("p", "pose"), *points)


def boxes_from_tracks(raw: DataFrame) -> DataFrame:
    """frame_idx and an array of boxes, one for each raw track."""
    box = lambda t: F.struct(*(F.get(t, F.lit(i)).cast("double").alias(c) for i, c in enumerate(CORNERS)), F.get(t, F.lit(4)).cast("bigint").alias("track_id"))
    return raw.select(*_carried(raw, "tracks"), "frame_idx", F.transform("tracks", box).alias("boxes"))


def box_struct(prefix: str = ""):
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in CORNERS), F.col("track_id"))


def nest_faces(df: DataFrame) -> DataFrame:
    """Flat rows with a face -> keys and a struct ``face`` (box, score, landmarks)."""
    marks = F.array(*(F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in LANDMARKS))
    return df.where(present("face_score")).select(*keys_of(df), F.struct(box_struct("face_").alias("box"), F.col("face_score").alias("score"), marks.alias("landmarks")).alias("face"))


def nest_poses(df: DataFrame) -> DataFrame:
    """Flat rows with a pose -> keys and a struct ``pose`` (box, score, keypoints)."""
    points = F.array(*(F.struct(*(F.col(f"pose_{n}_{a}").alias(a) for a in ("x", "y", "score"))) for n in KEYPOINTS))
    return df.where(present("pose_score")).select(*keys_of(df), F.struct(box_struct("pose_").alias("box"), F.col("pose_score").alias("score"), points.alias("keypoints")).alias("pose"))


def drop_pass(df: DataFrame, group: list[str]) -> DataFrame:
    """Without the columns of a pass, those that are there."""
    return df.drop(*(c for c in group if c in df.columns))


def join_pass(tracks: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """All tracks with the columns of a pass: missing where nothing was found. Running a pass again replaces its columns."""
    keys = [k for k in keys_of(tracks) if k in found.columns]
    return drop_pass(tracks, group).join(found.select(*keys, *(c for c in group if c in found.columns)), keys, "left")


def join_faces(tracks: DataFrame, faces: DataFrame) -> DataFrame:
    return join_pass(tracks, faces, FACE_COLUMNS)


def join_poses(tracks: DataFrame, poses: DataFrame) -> DataFrame:
    return join_pass(tracks, poses, POSE_COLUMNS)


def boxes_for_frame(df: DataFrame, frame: int) -> DataFrame:
    """The boxes of one frame; the filter reaches the files."""
    return df.where(F.col("frame") == frame).select(*keys_of(df), *CORNERS)


def _never_ran(df: DataFrame, group: list[str]) -> DataFrame:
    """No rows, with the columns of a pass."""
    return df.limit(0).withColumns({c: F.lit(None).cast("double") for c in group if c not in df.columns})


def faces_for_frame(df: DataFrame, frame: int) -> DataFrame:
    """The faces of one frame; none if the face pass never ran."""
    if "face_score" not in df.columns:
        return nest_faces(_never_ran(df, FACE_COLUMNS))
    return nest_faces(df.where(F.col("frame") == frame))


def poses_for_frame(df: DataFrame, frame: int) -> DataFrame:
    if "pose_score" not in df.columns:
        return nest_poses(_never_ran(df, POSE_COLUMNS))
    return nest_poses(df.where(F.col("frame") == frame))


def boxes_by_frame(df: DataFrame) -> DataFrame:
    """frame -> its boxes, sorted; frames without rows don't appear."""
    keys = [k for k in keys_of(df) if k != "track_id"]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("track_id", *CORNERS))).alias("boxes"))
