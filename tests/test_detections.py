import pytest
from pyspark.sql import functions as F

from trackloom.operators import detections as D
from trackloom.operators import geometry as G
from trackloom.operators import summary
from trackloom.schemas import FACE_COLUMNS, KEYPOINTS, POSE_COLUMNS, RAW_FACES, RAW_POSES, RAW_TRACKS

TRACKS = [(0, 1, 0.0, 0.0, 5.0, 5.0, 0.9), (0, 2, 10.0, 10.0, 15.0, 15.0, 0.8), (1, 1, 1.0, 1.0, 6.0, 6.0, 0.95)]


@pytest.fixture
def tracks(spark):
    return spark.createDataFrame(TRACKS, "frame long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double")


@pytest.fixture
def faces(spark):
    face = ((10.0, 20.0, 30.0, 50.0, 1), 0.7, [(10.0 + i, 20.0 + i) for i in range(5)], None)
    return spark.createDataFrame([(0, [face]), (1, []), (2, None)], RAW_FACES)


@pytest.fixture
def poses(spark):
    pose = ((10.0, 20.0, 30.0, float("nan"), 2), 0.6, [(10.0 + i, 20.0 + i, 0.5 + i / 100) for i in range(17)])
    return spark.createDataFrame([(0, [pose])], RAW_POSES)


def test_flatten_tracks(spark):
    raw = spark.createDataFrame([(1, [[0.0, 0.0, 5.0, 5.0, 1.0, 0.9, 0.0, 0.0], [10.0, 10.0, 15.0, 15.0, 2.0, 0.8, 2.0, 1.0]], None), (2, [], None), (3, [[1.0, 1.0, 6.0, 6.0, 1.0, 0.95, 0.0, 0.0]], None)], RAW_TRACKS)
    rows = sorted(tuple(r) for r in D.flatten_tracks(raw).collect())
    assert rows == [TRACKS[0], TRACKS[1], (2, *TRACKS[2][1:])]
    assert [r.track_id for r in D.flatten_tracks(raw, classes=[2]).collect()] == [2]
    empty = D.flatten_tracks(raw.limit(0))
    assert empty.count() == 0 and dict(empty.dtypes)["track_id"] == "bigint"
    boxes = {r.frame_idx: r.boxes for r in D.boxes_from_tracks(raw).collect()}
    assert boxes[1][1].track_id == 2 and boxes[1][1].x2 == 15.0 and boxes[2] == []


def test_faces_round_trip_and_join(tracks, faces):
    flat = D.flatten_faces(faces)
    assert flat.columns == ["frame", "track_id", *FACE_COLUMNS] and flat.count() == 1
    joined = D.join_faces(tracks, flat)
    assert joined.count() == 3 and joined.where("face_score is null").count() == 2
    nested = D.nest_faces(joined).first()
    assert nested.face.box.x2 == 30.0 and [m.x for m in nested.face.landmarks] == [10.0, 11.0, 12.0, 13.0, 14.0]
    again = D.join_faces(joined, flat)
    assert sorted(again.columns) == sorted(joined.columns)
    assert D.faces_for_frame(joined, 0).count() == 1 and D.faces_for_frame(joined, 1).count() == 0 and D.faces_for_frame(tracks, 0).count() == 0
    nan = joined.withColumn("face_score", F.coalesce("face_score", F.lit(float("nan"))))
    assert D.faces_for_frame(nan, 1).count() == 0


def test_poses_round_trip(tracks, poses):
    flat = D.flatten_poses(poses)
    assert flat.columns == ["frame", "track_id", *POSE_COLUMNS]
    assert flat.first().pose_y2 is None  # NaN is missing
    joined = D.join_poses(tracks, flat)
    pose = D.poses_for_frame(joined, 0).first().pose
    assert len(pose.keypoints) == len(KEYPOINTS) and pose.keypoints[16].score == 0.66
    assert D.drop_pass(joined, POSE_COLUMNS).columns == tracks.columns


def test_lookups_and_summaries(tracks):
    assert D.boxes_for_frame(tracks, 0).count() == 2
    by = {r.frame: [b.track_id for b in r.boxes] for r in D.boxes_by_frame(tracks).collect()}
    assert by == {0: [1, 2], 1: [1]}
    assert tuple(summary.tracking(tracks).first()) == (2, 3)
    assert {r.track_id: r.frames for r in summary.coverage(tracks, frames=True).collect()} == {1: [0, 1], 2: [0]}


def test_clamp_and_crops(spark):
    t = spark.createDataFrame([(0, 1, -3.5, 2.5, 12.0, 200.0), (0, 2, 0.5, 1.5, 8.5, 9.5), (0, 3, 50.0, 50.0, 40.0, 60.0), (1, 4, 0.0, 0.0, 50.0, 50.0)], "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    frames = spark.createDataFrame([(0, 100, 100)], "frame long, width int, height int")
    rows = {r.track_id: (r.cx1, r.cy1, r.cx2, r.cy2) for r in G.crop_requests(t, frames).collect()}
    assert rows == {1: (0.0, 2.0, 12.0, 100.0), 2: (0.0, 2.0, 8.0, 10.0)}
    assert G.wanted_frames(frames, t).count() == 1


def test_best_pose_prefers_area_and_moves_back(spark):
    points = [(float(i), float(i), 0.75) for i in range(17)]
    c = spark.createDataFrame([(0, 7, 0, 0.95, 0.0, 0.0, 5.0, 5.0, points), (0, 7, 1, 0.9, 1.0, 2.0, 11.0, 22.0, points)], "frame long, track_id long, cand_id long, score double, bx1 double, by1 double, bx2 double, by2 double, keypoints array<struct<x:double,y:double,score:double>>")
    best = G.best_pose(c, 0.25).withColumns({"cx1": F.lit(20.0), "cy1": F.lit(30.0)})
    r = G.to_frame(best, "keypoints").first()
    assert (r.bx1, r.by1, r.bx2, r.by2, r.score) == (21.0, 32.0, 31.0, 52.0, 0.9)
    assert (r.keypoints[0].x, r.keypoints[0].y, r.keypoints[16].x) == (20.0, 30.0, 36.0)
    none = c.withColumn("keypoints", F.transform("keypoints", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(None).cast("double").alias("score"))))
    assert {p.score for p in G.default_scores(none).first().keypoints} == {1.0}


def test_threshold_before_and_after(spark):
    c = spark.createDataFrame([(0, 1, 0, 0.4, 0.0, 0.0, 10.0, 10.0), (0, 1, 1, 0.9, 0.0, 0.0, 2.0, 2.0)], "frame long, track_id long, cand_id long, score double, bx1 double, by1 double, bx2 double, by2 double")
    assert G.best_face(c, 0.5).count() == 0
    assert G.best_pose(c, 0.5).first().cand_id == 1


def test_skeleton_needs_both_ends(spark, tracks, poses):
    flat = D.join_poses(tracks, D.flatten_poses(poses))
    points = G.keypoint_rows(flat)
    assert points.count() == 17 and G.skeleton_edges(points).count() == 16
    hidden = points.withColumn("visible", F.col("visible") & (F.col("point") != 5))
    assert G.skeleton_edges(hidden).count() == 13
    for score in (0.0, float("nan"), None):
        own = flat.withColumn("pose_left_shoulder_score", F.lit(score).cast("double"))
        assert sorted(map(tuple, G.pose_edges(own).collect())) == sorted(map(tuple, G.skeleton_edges(G.keypoint_rows(own)).collect()))
        assert G.pose_edges(own).count() == 13


def test_apply_model_loads_once_a_task(spark, tracks):
    def load():
        calls = []

        def score(batch):
            calls.append(1)
            return batch[["frame", "track_id"]].assign(score=batch["conf"])

        return score

    assert G.apply_model(tracks, load, "frame long, track_id long, score double").count() == 3


def test_stored_frames_are_pruned(spark, tmp_path):
    """Of frames in 50 folders, those of the tracks' buckets are read."""
    from trackloom import sources

    path = str(tmp_path / "frames")
    sources.write_frames(spark.range(50_000).selectExpr("'glasses_video' as input_kind", "if(id % 2 = 0, 'a', 'b') as input_id", "id as frame"), path)
    tracks = spark.createDataFrame([("glasses_video", "a", f, 1) for f in (10, 12, 30_000, 30_001)], "input_kind string, input_id string, frame long, track_id long")
    found = G.wanted_frames(sources.read_frames(spark, path), tracks)
    assert sorted((r.input_id, r.frame) for r in found.collect()) == [("a", 10), ("a", 12), ("a", 30_000)]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    scans = [m for m in _nodes(plan) if "frame_bucket" in m.toString() and m.nodeName().startswith("Scan parquet") and m.metrics().contains("numPartitions")]
    assert [m.metrics().apply("numPartitions").value() for m in scans] == [2], [(m.nodeName(), m.toString()[:300], str(m.metrics().keys())) for m in _nodes(plan)]


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
        return
    yield plan
    if "QueryStage" in plan.nodeName():
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_model_batches_and_profile(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    crops = spark.range(1000).selectExpr("id as frame", "1L as track_id")

    def load():
        return lambda batch: batch.assign(n=len(batch))[["frame", "n"]]

    sizes = [r.n for r in G.apply_model(crops, load, "frame long, n long", batch_rows=64).collect()]
    assert len(sizes) == 1000 and max(sizes) == 64
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    plan = G.apply_model(crops, load, "frame long, n long", profile=profile)._jdf.queryExecution().executedPlan()
    assert any(n.nodeName() == "MapInPandas" and n.profile().isDefined() and n.profile().get().taskResources().apply("cpus").amount() == 2.0 for n in _all(plan))


def _all(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.inputPlan()
    yield plan
    for i in range(plan.children().size()):
        yield from _all(plan.children().apply(i))
