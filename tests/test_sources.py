import json
import os
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trackloom import sources as S
from trackloom.schemas import EMBEDDINGS_HALF
from trackloom.sources import manifest as M
from pyspark.sql import functions as F


def results(spark, rows):
    return spark.createDataFrame(rows, "input_kind string, input_id string, frame long, track_id long, conf double")


def test_results_round_trip_and_checks(spark, tmp_path):
    path = str(tmp_path / "results")
    S.write_results(results(spark, [("glasses_video", "a", 1, 1, 0.5), ("fixed_video", "b", 0, 2, 0.6)]), path)
    S.write_results(results(spark, [("glasses_video", "a", 7, 1, 0.7)]), path)
    assert sorted((r.input_id, r.frame) for r in S.read_results(spark, path).collect()) == [("a", 7), ("b", 0)]
    done = S.finished(spark, path)
    assert sorted(r.input_id for r in done.collect()) == ["a", "b"] and S.finished(spark, path + "x").count() == 0
    inputs = spark.createDataFrame([("glasses_video", "a"), ("audio", "c")], "input_kind string, input_id string")
    assert [r.input_id for r in S.pending_inputs(inputs, done).collect()] == ["c"]
    assert S.pending_inputs(inputs, done, force=True).count() == 2
    with pytest.raises(ValueError):
        S.write_results(None, path)
    with pytest.raises(ValueError):
        S.write_results(results(spark, []), path)
    S.export(spark.range(3), str(tmp_path / "plain"), "parquet")
    with pytest.raises(ValueError):
        S.read_results(spark, str(tmp_path / "plain"))


def test_tolerant_read(spark, tmp_path):
    S.export(spark.createDataFrame([(0, 1)], "frame long, track_id long"), str(tmp_path / "a"), "parquet")
    S.export(spark.range(3), str(tmp_path / "b"), "parquet")
    (tmp_path / "c").write_text("no parquet")
    with pytest.warns(UserWarning) as told:
        df = S.read_tolerant(spark, {k: str(tmp_path / k) for k in "abcd"})
    assert [r.input_id for r in df.collect()] == ["a"] and sum("no results" in str(w.message) for w in told) == 3


def test_embeddings_and_stale_companions(spark, tmp_path):
    path = str(tmp_path / "emb")
    inputs = spark.createDataFrame([("glasses_video", "a"), ("glasses_video", "b")], "input_kind string, input_id string")
    rows = spark.createDataFrame([("glasses_video", "a", 1, 0, 0.9, [0.1, 2.0]), ("glasses_video", "b", 1, 0, 0.9, [0.3])], "input_kind string, input_id string, track_id long, frame long, score double, embedding array<float>")
    S.write_embeddings(rows, path, inputs)
    assert S.read_embeddings(spark, path).count() == 2
    S.write_embeddings(rows.where("input_id = 'a'"), path, inputs)
    assert os.listdir(f"{path}/input_kind=glasses_video") == ["input_id=a"]
    assert S.read_embeddings(spark, path).first().embedding[0] == pytest.approx(0.0999755859375, abs=0)
    assert S.read_embeddings(spark, path + "-none").count() == 0


def test_half_file_of_another_writer(spark, tmp_path):
    column = pa.array([[struct.pack("<e", 0.5), struct.pack("<e", -2.0)]], pa.list_(pa.binary()))
    pq.write_table(pa.table({"track_id": [1], "frame": [2], "score": pa.array([0.5], pa.float32()), "embedding": column}), tmp_path / "h.parquet")
    assert "binary" in EMBEDDINGS_HALF
    assert S.read_embeddings(spark, str(tmp_path / "h.parquet"), half=True).first().embedding == [0.5, -2.0]


def test_audio_gaze_and_export(spark, tmp_path):
    audio = spark.createDataFrame([("audio", "m", 0.0, 1.75), ("audio", "m", 2.5, 4.0)], "input_kind string, input_id string, start double, end double")
    S.write_audio(audio, str(tmp_path / "audio"))
    assert S.read_audio(spark, str(tmp_path / "audio")).count() == 2
    (tmp_path / "g.tsv").write_text("participant\trectimestamp\tgaze_x\tgaze_y\tpupil_left\tpupil_right\tgaze_video_time\n7\t1.5\tNA\t2.0\tNA\t3.0\t20\n7\t2.5\t1.0\t2.0\t3.0\t3.0\t40\n")
    rows = S.read_gaze(spark, str(tmp_path / "g.tsv")).collect()
    assert rows[0].gaze_x is None and rows[1].pupil_left == 3.0 and rows[0].participant == 7
    for kind in ("csv", "json"):
        S.export(audio.withColumn("n", F.array("start")), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        S.export(audio, str(tmp_path / "x"), "xlsx")


GOOD = {"version": 1, "glasses_videos": [{"id": "cam1", "path": "cam1.mp4", "gaze_path": "cam1.tsv"}], "fixed_videos": [{"id": "room", "path": "/abs/room.mp4", "time_offset": -1.5}], "audio": [{"id": "mic1", "path": "m.wav", "glasses_video": "cam1"}], "pipeline": {"glasses_video": {"face_detection": {"det_size": 320}}, "fixed_video": {"face_detection": None}}}


def test_manifests(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(GOOD))
    (tmp_path / "bare.json").write_text("{}")
    (tmp_path / "new.json").write_text(json.dumps({"version": 2}))
    (tmp_path / "odd.json").write_text(json.dumps({"extra": 1, "audio": [{"id": "x", "path": "y", "colour": 1}], "pipeline": {"glasses_video": {"body_pose": {"confx": 1}}}}))
    inputs, pipeline, problems = M.read_manifests(spark, f"{tmp_path}/*.json")
    assert {r.problem for r in problems.collect()} == {"newer version", "unknown key extra", "unknown key audio.colour", "unknown key pipeline.glasses_video.body_pose.confx"}
    by = {r.id: r for r in inputs.collect()}
    assert set(by) == {"cam1", "room", "mic1"} and by["room"].time_offset == -1.5 and by["cam1"].time_offset == 0.0
    good = {(r.kind, r.step): r.settings for r in pipeline.where("experiment like '%good%'").collect()}
    assert set(good) == {("glasses_video", "object_tracking"), ("glasses_video", "face_detection"), ("fixed_video", "object_tracking")}
    assert good["glasses_video", "face_detection"]["det_size"] == "320" and good["glasses_video", "face_detection"]["det_thresh"] == "0.5"
    assert M.violations(inputs, pipeline).count() == 0
    M.write_manifest(inputs, pipeline, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/inputs")).count() == 3
    assert M.with_settings(inputs, pipeline).count() == 3


def test_manifest_rules(spark):
    rows = [("glasses_video", "a/b", "g", None), ("glasses_video", "ok", None, None), ("fixed_video", "..", None, None), ("audio", "m", None, "ok"), ("audio", "n", None, ".."), ("audio", "m", None, None)]
    inputs = spark.createDataFrame(rows, "kind string, id string, gaze_path string, glasses_video string")
    assert sorted((r.id, r.problem) for r in M.violations(inputs).collect()) == [("..", "bad id"), ("a/b", "bad id"), ("ok", "no gaze_path")]
    assert [r.id for r in M.duplicate_ids(inputs).collect()] == ["m"]
    assert [r.id for r in M.unknown_references(inputs).collect()] == ["n"]
    assert [r.id for r in M.referenced_glasses(inputs).collect()] == ["ok"]
    assert [r.id for r in M.distinct_ids(inputs).collect()] == sorted({r[1] for r in rows})
    steps = spark.createDataFrame([("glasses_video", "face_detection", {"det_size": "32", "det_thresh": "0.5", "embeddings_per_track": "1"}), ("fixed_video", "body_pose", {"conf": "1.5"})], "kind string, step string, settings map<string,string>")
    assert {r.problem for r in M.violations(inputs.limit(0), steps).collect()} == {"face_detection.det_size out of range", "body_pose.conf out of range"}


def test_paths(spark, tmp_path):
    (tmp_path / "a.mp4").write_text("x")
    df = spark.createDataFrame([("a.mp4",), ("/b.mp4",), ("../c.mp4",)], "p string")
    r = df.select(M.resolve(F.col("p"), F.lit(str(tmp_path))).alias("path"), M.has_parent_segments(F.col("p")).alias("up")).collect()
    assert [x.path for x in r] == [f"{tmp_path}/a.mp4", "/b.mp4", f"{tmp_path}/../c.mp4"] and [x.up for x in r] == [False, False, True]
    back = spark.createDataFrame([(x.path,) for x in r], "path string")
    assert back.select(M.store(F.col("path"), F.lit(str(tmp_path)))).first()[0] == "a.mp4"
    assert M.missing_files(back, M.list_files(spark, str(tmp_path))).count() == 2
    inputs = back.withColumn("id", F.concat(F.lit("in-"), F.monotonically_increasing_id()))
    with pytest.raises(FileNotFoundError, match="in-"):
        M.require_files(inputs, M.list_files(spark, str(tmp_path)))
    found = inputs.where(F.col("path") == f"{tmp_path}/a.mp4")
    assert M.require_files(found, M.list_files(spark, str(tmp_path))) is found
