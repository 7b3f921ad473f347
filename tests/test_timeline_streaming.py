import random
import time

import pytest

from trackloom import sources as S
from trackloom import streaming as T
from trackloom.operators import timeline as L


def test_on_timeline(spark):
    inputs = spark.createDataFrame([("a", 1.5, 50.0), ("b", 0.0, None)], "input_id string, time_offset double, fps double")
    df = spark.createDataFrame([("a", 50), ("b", 50)], "input_id string, frame long")
    assert {r.input_id: r.t_exp for r in L.on_timeline(df, inputs).collect()} == {"a": 2.5, "b": 2.0}
    both = L.experiment_table({"a": df.drop("input_id"), "b": df.drop("input_id")}, inputs)
    assert both.count() == 4


def test_asof_equals_brute_force(spark):
    rnd = random.Random(1)
    samples = [(p, rnd.randrange(0, 5000), rnd.random()) for p in range(3) for _ in range(60)]
    frames = [(p, t) for p in range(4) for t in range(0, 5000, 37)]
    got = L.asof(spark.createDataFrame(frames, "p long, t long"), spark.createDataFrame(samples, "p long, t long, x double"), ["p"], "t", 100, ["x"]).collect()
    assert len(got) == len(frames)
    for r in got:
        near = max(((t, x) for p, t, x in samples if p == r.p and r.t - 100 <= t <= r.t), default=(None, None))
        assert (r.sample_time, r.x) == near


def test_gaze_hits_and_summary(spark):
    gaze = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 100.0, 5.0), (3, 0, None, 1.0), (4, 0, 10.0, 10.0)], "event long, frame long, gaze_x double, gaze_y double")
    tracks = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 4.0, 4.0, 6.0, 6.0), (0, 3, 0.0, 0.0, 10.0, 10.0)], "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r.event: r.track_id for r in L.gaze_hits(gaze, tracks, ["frame"]).collect()} == {1: 2, 4: 1}
    s = L.gaze_summary(gaze.withColumnsRenamed({"frame": "participant", "event": "gaze_video_time"})).first()
    assert (s.samples, s.valid, s.missing, s.largest_step) == (4, 3, 1, 1)


def test_valid_gaze_has_both_coordinates(spark):
    nan = float("nan")
    gaze = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 5.0), (3, 5.0, None), (4, nan, 5.0), (5, 5.0, nan), (6, None, None)], "n int, gaze_x double, gaze_y double")
    assert [r.n for r in L.valid_gaze(gaze).collect()] == [1]
    assert L.valid_gaze(gaze.limit(0)).count() == 0


def test_asof_without_tolerance(spark):
    rnd = random.Random(3)
    samples = [(p, rnd.randrange(0, 5000), rnd.random()) for p in (0, 1, 2, None) for _ in range(12)] + [(1, None, 0.5)]
    frames = [(p, t) for p in (0, 1, 2, 3, None) for t in range(0, 9000, 77)] + [(1, None)]
    left, right = spark.createDataFrame(frames, "p long, t long"), spark.createDataFrame(samples, "p long, t long, x double")
    for bucket in (50.0, 1000.0, 1e6):
        got = L.asof(left, right, ["p"], "t", None, ["x"], bucket=bucket).collect()
        assert len(got) == len(frames)
        for r in got:
            near = max(((t, x) for p, t, x in samples if p == r.p and t is not None and r.t is not None and t <= r.t), default=(None, None))
            assert (r.sample_time, r.x) == near


def test_long_segments_equal_brute_force(spark):
    rnd = random.Random(5)
    seg = [(a, i, (s := rnd.uniform(-50, 90_000)), s + 10 ** rnd.uniform(-2, 5)) for a in range(2) for i in range(60)] + [(0, 99, 5.0, 5.0), (0, 100, 0.0, 1e9)]
    fr = [(a, i, (s := rnd.uniform(-100, 100_000)), s + 10 ** rnd.uniform(-2, 4)) for a in range(2) for i in range(150)]
    left, right = spark.createDataFrame(seg, "a long, i long, seg_start double, seg_end double"), spark.createDataFrame(fr, "a long, frame long, f_start double, f_end double")
    want = sorted((a, i, f) for a, i, s, e in seg for b, f, x, y in fr if a == b and s < y and x < e and e > s)
    assert sorted((r.a, r.i, r.frame) for r in L.segment_frames(left, right, "a").collect()) == want
    short = left.where("i < 99")
    assert sorted((r.a, r.i, r.frame) for r in L.segment_frames(short, right, "a", bucket=100.0, top=2).collect()) == [w for w in want if w[1] < 99]


def test_segment_totals_equal_brute_force(spark):
    rnd = random.Random(9)
    seg = [(a, i % 50, float(s := rnd.randrange(-300, 4000)), s + 10 ** rnd.uniform(-2, 3.5)) for a in (0, 1, 4) for i in range(60)] + [(0, 98, 0.0, 0.0), (0, 99, 5.0, 5.0), (0, 100, -1e9, 1e9), (None, 101, 0.0, 9.0), (1, 102, float("nan"), 9.0), (2, 103, None, 9.0)]
    fr = [(a, i, float(s), s + rnd.choice([0.4, 1.0, 7.0, 500.0])) for a in (0, 1, 2) for i, s in enumerate(sorted(rnd.randrange(-100, 3000) for _ in range(200)))] + [(0, 500, 9000.0, 9000.0), (None, 501, 0.0, 9.0), (0, 502, 9000.0, None)]
    left, right = spark.createDataFrame(seg, "a long, i long, seg_start double, seg_end double"), spark.createDataFrame(fr, "a long, frame long, f_start double, f_end double")
    want: dict = {}
    for a, i, s, e in seg:
        for b, f, x, y in fr:
            if a is not None and a == b and None not in (s, y) and x < y and s < e and s < y and x < e:
                want.setdefault(i, []).append(f)
    want_rows = sorted((i, len(f), min(f), sum(f)) for i, f in want.items())
    for bucket in (0.7, 60.0, 1e6):
        assert sorted(map(tuple, L.segment_totals(left, right, "a", ["i"], bucket=bucket).collect())) == want_rows
    assert L.segment_totals(left.limit(0), right, "a", ["i"]).count() == L.segment_totals(left, right.limit(0), "a", ["i"]).count() == 0


def test_long_segments_make_no_row_for_each_pair(spark, tmp_path):
    """30,000 frames and 300,000 segments of one recording: over a thousand million pairs, which took some minutes row by row."""
    import numpy as np

    from trackloom import plans

    spark.range(300_000).selectExpr("id as o_orderkey", "76L as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    lines = "150 * id + 76 as l_orderkey, 1 as l_linenumber, 1L as l_partkey, 1L as l_suppkey, 1.0D as l_quantity, 0.0D as l_discount"
    spark.range(30_000).selectExpr(*lines.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    started = time.monotonic()
    got = plans.long_segments(spark, str(tmp_path)).toPandas().sort_values("seg")
    seg, n = np.arange(300_000), np.arange(30_000)
    start, begin = (seg % 5000).astype(float), n * 0.4
    low, high = np.searchsorted(begin + 0.4, start, "right"), np.searchsorted(begin, start + 60 * (seg % 13) * 9.5, "left")
    some, sums = (high > low) & (seg % 13 > 0), np.concatenate([[0], np.cumsum(150 * n + 76)])
    assert (high - low)[some].sum() > 1_000_000_000 and time.monotonic() - started < 120
    assert got[["seg", "n", "first_frame", "frames"]].to_numpy().tolist() == np.stack([seg, high - low, 150 * low + 76, sums[high] - sums[low]], 1)[some].tolist()


def test_a_segment_of_a_day_is_few_rows(spark):
    from pyspark.sql import functions as F

    day = spark.createDataFrame([(0.3, 86_400.3), (7.0, 7.5)], "seg_start double, seg_end double")
    _, cells = L._buckets("seg_start", "seg_end", 1.0, L.LEVELS)
    assert max(r[0] for r in day.select(F.size(cells)).collect()) < 20


def test_frames_are_dealt_to_levels_of_segments_only(spark):
    """Short segments: a short frame is a row or two, not one at each level above too."""
    left = spark.range(500).selectExpr("1L as a", "id as i", "id * 2.5D as seg_start", "id * 2.5D + 1 as seg_end")
    right = spark.range(3000).selectExpr("1L as a", "id as frame", "id * 0.4D as f_start", "id * 0.4D + 0.4D as f_end")
    (one, two), met = L._dealt(left, right, 1.0, L.LEVELS), L.segment_frames(left, right, "a")
    assert one.count() <= 2 * 500 and two.count() <= 2 * 3000
    assert met.count() == sum(s * 2.5 < f * 0.4 + 0.4 and f * 0.4 < s * 2.5 + 1 for s in range(500) for f in range(3000))


def test_runs_of_frames(spark):
    from trackloom.operators import summary

    rnd = random.Random(8)
    frames = {(t, f) for t in (1, 2, None) for f in range(400) if rnd.random() < (0.98 if t == 1 else 0.6)} | {(5, f) for f in range(1000)} | {(6, f) for f in range(0, 200, 2)}
    want = []
    for t in (1, 2, 5, 6, None):
        own = sorted(f for k, f in frames if k == t)
        starts = [f for f in own if (t, f - 1) not in frames]
        ends = [f for f in own if (t, f + 1) not in frames]
        want += [(t, a, z) for a, z in zip(starts, ends, strict=True)]
    df = spark.createDataFrame([*frames, *list(frames)[:50], (1, None)], "track_id long, frame long")
    for bucket in (1, 7, 100, 10_000):
        assert sorted(map(tuple, summary.runs(df, bucket=bucket).collect()), key=repr) == sorted(want, key=repr)
    assert summary.runs(df.limit(0)).count() == 0


def test_few_rows_are_ordered_within_a_track(spark, monkeypatch):
    """Runs over the edge of each of 50,000 buckets: at most two rows of each wide bucket are left to order within the track."""
    from trackloom.operators import summary

    left, paired = [], summary._paired
    monkeypatch.setattr(summary, "_paired", lambda *x: (found := paired(*x), left.append(found[1]))[0])
    df = spark.range(200_000).where("id % 4 <> 1").selectExpr("1 as track_id", "id as frame")
    got = sorted((r.first_frame, r.last_frame) for r in summary.runs(df, bucket=4).collect())
    assert got == [(0, 0)] + [(a, min(a + 2, 199_999)) for a in range(2, 200_000, 4)]
    assert left[0].count() <= 2 * (200_000 // (4 * summary.BUCKETS_IN_ONE) + 1)


def test_streaming_top_k_equals_batch_after_a_restart(spark, folders):
    from trackloom.operators import embeddings as V

    rnd = random.Random(11)
    rows = [("a", rnd.randrange(4), f, rnd.randrange(5) / 4 if f % 17 else None, [float(f)]) for f in rnd.sample(range(2000), 600)]
    schema = "input_id string, track_id long, frame long, score double, embedding array<float>"
    for part in range(4):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(folders["in"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folders["in"])
        T.keep_top_k(stream, folders["state"], folders["cp"], 5).awaitTermination()  # each time it goes on from the checkpoint
        so_far = spark.createDataFrame([r for p in range(part + 1) for r in rows[p::4]], schema)
        want = V.top_k(so_far, 5, ties="exact")
        key = lambda df: sorted((r.input_id, r.track_id, r.frame, r.score, r.embedding) for r in df.collect())
        assert key(T.read_top_k(spark, folders["state"], ["input_id", "track_id"])) == key(want)


def test_a_batch_touches_its_own_tracks_only(spark, folders):
    schema = "track_id long, frame long, score double"
    for part in range(3):
        spark.createDataFrame([(part, f, 0.5) for f in range(9)], schema).coalesce(1).write.mode("append").parquet(folders["in"])
        stream = spark.readStream.schema(schema).parquet(folders["in"])
        T.keep_top_k(stream, folders["state"], folders["cp"], 2).awaitTermination()
        assert {r.track_id for r in spark.read.parquet(f"{folders['state']}/epoch={part}").collect()} == {part}
    assert sorted((r.track_id, r.frame) for r in T.read_top_k(spark, folders["state"], ["track_id"]).collect()) == [(t, f) for t in range(3) for f in (0, 1)]


def test_segments_equal_brute_force(spark):
    rnd = random.Random(2)
    seg = [(a, i, (s := rnd.uniform(0, 20)), s + rnd.uniform(0, 4)) for a in range(3) for i in range(20)] + [(0, 99, 5.0, 5.0)]
    fr = [(a, i, i * 0.4, i * 0.4 + 0.4) for a in range(3) for i in range(50)]
    got = L.segment_frames(spark.createDataFrame(seg, "a long, i long, seg_start double, seg_end double"), spark.createDataFrame(fr, "a long, frame long, f_start double, f_end double"), "a").collect()
    want = sorted((a, i, f) for a, i, s, e in seg for b, f, x, y in fr if a == b and s < y and x < e and e > s)
    assert sorted((r.a, r.i, r.frame) for r in got) == want
    inputs = spark.createDataFrame([("audio", "m", "cam", 1.0), ("audio", "n", None, 0.0)], "kind string, id string, glasses_video string, time_offset double")
    rows = L.attribute_audio(spark.createDataFrame([("m", 1), ("n", 2)], "audio_id string, turn int"), inputs).collect()
    assert {r.audio_id: r.participant_input for r in rows} == {"m": "cam", "n": None}


@pytest.fixture
def folders(tmp_path):
    return {k: str(tmp_path / k) for k in ("in", "faces", "staging", "results", "state", "cp", "cp2")}


def test_passes_commit_and_discard(spark, folders):
    row = lambda i, n: ("glasses_video", i, n, [[0.0, 0.0, 9.0, 9.0, 1.0, 0.9, 0.0, 0.0]], None)
    spark.createDataFrame([row("a", 1), row("a", 2), row("b", 1)], T.raw_schema("tracking")).write.parquet(folders["in"])
    T.ingest(T.read_frames(spark, folders["in"], "tracking"), folders["staging"], "tracking", "r1").awaitTermination()
    assert not S.exists(spark, folders["results"]) and T.staged(spark, folders["staging"], "tracking", "r1").count() == 3
    T.commit(spark, folders["staging"], "tracking", "r1", folders["results"])
    assert S.read_results(spark, folders["results"]).count() == 3 and T.staged(spark, folders["staging"], "tracking", "r1").count() == 0
    face = ((1.0, 1.0, 2.0, 2.0, 1), 0.8, [(1.0, 1.0)] * 5, None)
    spark.createDataFrame([("glasses_video", "a", 0, [face])], T.raw_schema("faces")).write.parquet(folders["faces"])
    stream = T.read_frames(spark, folders["faces"], "faces")
    T.ingest(stream, folders["staging"], "faces", "r2").awaitTermination()
    T.discard(spark, folders["staging"], "faces", "r2")
    assert "face_score" not in S.read_results(spark, folders["results"]).columns
    T.ingest(stream, folders["staging"], "faces", "r3").awaitTermination()
    T.commit(spark, folders["staging"], "faces", "r3", folders["results"])
    done = S.read_results(spark, folders["results"])
    assert done.count() == 3 and done.where("face_score is not null").count() == 1


def test_streaming_top_k_progress_and_live_view(spark, folders):
    rows = [("a", 1, f, (f * 7 % 10) / 10) for f in range(20)]
    for k in range(4):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], "input_id string, track_id long, frame long, score double").coalesce(1).write.mode("append").parquet(folders["in"])
    stream = spark.readStream.schema("input_id string, track_id long, frame long, score double").option("maxFilesPerTrigger", 1).parquet(folders["in"])
    T.keep_top_k(stream, folders["state"], folders["cp"], 3).awaitTermination()
    assert sorted(r.score for r in T.read_top_k(spark, folders["state"], ["input_id", "track_id"]).collect()) == [0.8, 0.9, 0.9]
    told = []
    listener = T.Progress(lambda *x: told.append(x), total=20)
    spark.streams.addListener(listener)
    T.observed(stream.withColumnRenamed("frame", "frame_idx"), "r7").writeStream.format("noop").option("checkpointLocation", folders["cp2"]).trigger(availableNow=True).start().awaitTermination()
    deadline = time.monotonic() + 20
    while (not told or told[-1][2] < 20) and time.monotonic() < deadline:
        time.sleep(0.05)
    spark.streams.removeListener(listener)
    assert told[-1] == ("r7", 19, 20, 20) and len(told) >= 4 and [t[2] for t in told] == sorted(t[2] for t in told)
    stored = spark.createDataFrame([("a", 3, 1, 0.0, 0.0, 1.0, 1.0)], "input_id string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    view = T.live_view(stream.selectExpr("input_id", "frame as frame_idx").where("frame_idx in (3, 4)"), stored)
    q = view.writeStream.format("memory").queryName("live").option("checkpointLocation", folders["cp"] + "3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.frame: r.boxes and r.boxes[0].track_id for r in spark.sql("select * from live").collect()} == {3: 1, 4: None}
