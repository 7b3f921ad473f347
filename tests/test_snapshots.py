import os
import random

import pytest

from trackloom import sources as S
from trackloom import streaming as T
from trackloom.sources import snapshots as P
from trackloom.sources import tolerant

SCHEMA = "input_kind string, input_id string, frame long, track_id long, conf double"


def rows(spark, inputs, conf):
    return spark.createDataFrame([("glasses_video", i, f, 1, conf) for i in inputs for f in range(3)], SCHEMA)


def seen(spark, root):
    return {(r.input_id, r.conf) for r in S.read_results(spark, root).collect()}


def test_commits_replace_inputs_and_keep_the_others(spark, tmp_path):
    root = str(tmp_path / "store")
    assert P.current(spark, root) is None and P.live(spark, root).count() == 0
    with pytest.raises(ValueError):
        P.read(spark, root)
    first = P.commit(rows(spark, ["007", "b"], 0.1), root)
    second = P.commit(rows(spark, ["b", "c"], 0.2).selectExpr("*", "conf * 2 as face_score"), root)
    assert P.current(spark, root) == second > first
    assert seen(spark, root) == {("007", 0.1), ("b", 0.2), ("c", 0.2)}  # ids stay text
    assert S.read_results(spark, root).where("face_score is null").count() == 3
    assert sorted(r.input_id for r in S.finished(spark, root).collect()) == ["007", "b", "c"]
    third = P.commit(rows(spark, ["007"], 0.3), root)
    assert P.vacuum(spark, root) == [f"data/version={first}", f"snapshots/{first}", f"snapshots/{second}"]
    assert seen(spark, root) == {("007", 0.3), ("b", 0.2), ("c", 0.2)} and P.current(spark, root) == third


@pytest.mark.parametrize("dies", ["between partitions", "before its snapshot", "before the pointer"])
def test_a_commit_that_dies_shows_the_old_results_whole(spark, tmp_path, monkeypatch, dies):
    root = str(tmp_path / "store")
    P.commit(rows(spark, ["a", "b"], 0.1), root)
    if dies == "between partitions":  # one input's folder is whole, the other's is not there
        rows(spark, ["a"], 0.9).write.partitionBy(*P.PARTITIONS).parquet(f"{root}/data/version=0000000002-dead")
        os.mkdir(f"{root}/data/version=0000000002-dead/_temporary")
    else:
        def die(*_):
            raise RuntimeError("killed")

        monkeypatch.setattr(P, "live" if dies == "before its snapshot" else "_point", die)
        with pytest.raises(RuntimeError, match="killed"):
            P.commit(rows(spark, ["a", "b"], 0.9), root)
        monkeypatch.undo()
    assert seen(spark, root) == {("a", 0.1), ("b", 0.1)}
    P.commit(rows(spark, ["b"], 0.5), root)  # and the next one works
    assert seen(spark, root) == {("a", 0.1), ("b", 0.5)}
    assert len(P.vacuum(spark, root)) >= 2 and seen(spark, root) == {("a", 0.1), ("b", 0.5)}


def test_a_commit_that_comes_between_is_an_error(spark, tmp_path, monkeypatch):
    root, point = str(tmp_path / "store"), P.live
    P.commit(rows(spark, ["a"], 0.1), root)

    def other(*args):
        monkeypatch.setattr(P, "live", point)
        P.commit(rows(spark, ["a"], 0.2), root)
        return point(*args)

    monkeypatch.setattr(P, "live", other)
    with pytest.raises(RuntimeError, match="between"):
        P.commit(rows(spark, ["a"], 0.3), root)
    assert seen(spark, root) == {("a", 0.2)}


def test_a_killed_pass_can_be_committed_again(spark, tmp_path, monkeypatch):
    folder = lambda n: str(tmp_path / n)
    row = lambda i, n: ("glasses_video", i, n, [[0.0, 0.0, 9.0, 9.0, 1.0, 0.9, 0.0, 0.0]], None)
    spark.createDataFrame([row("a", 1), row("b", 1)], T.raw_schema("tracking")).write.parquet(folder("in"))
    stream = T.read_frames(spark, folder("in"), "tracking")
    T.ingest(stream, folder("staging"), "tracking", "r1").awaitTermination()

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(P, "_point", die)
    with pytest.raises(RuntimeError):
        T.commit(spark, folder("staging"), "tracking", "r1", folder("results"))
    monkeypatch.undo()
    assert P.current(spark, folder("results")) is None
    T.commit(spark, folder("staging"), "tracking", "r1", folder("results"))
    assert S.read_results(spark, folder("results")).count() == 2


def test_one_long_recording_is_not_one_task(spark, tmp_path, monkeypatch):
    """Rows are not dealt by their input alone, neither where results are read nor where a pass is joined to them, however small the table that Spark itself would broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    folder, asked = lambda n: str(tmp_path / n), []
    try:
        spark.range(3000).selectExpr("'glasses_video' as input_kind", "'a' as input_id", "id + 1 as frame_idx", "array(array(0D, 0D, 9D, 9D, 1D, 0.9D, 0D, 0D)) as tracks", "cast(null as array<array<float>>) as embeddings").write.parquet(folder("tracks"))
        spark.range(0, 3000, 2).selectExpr("'glasses_video' as input_kind", "'a' as input_id", "id as frame_idx", "array(named_struct('box', named_struct('x1', 1D, 'y1', 1D, 'x2', 2D, 'y2', 2D, 'track_id', 1L), 'score', 0.8D, 'landmarks', array(named_struct('x', 1D, 'y', 1D)), 'embedding', cast(null as array<float>))) as faces").write.parquet(folder("faces"))
        commit = P.commit
        monkeypatch.setattr(P, "commit", lambda df, root: (asked.append(df._jdf.queryExecution().executedPlan().toString()), commit(df, root))[1])
        for kind in ("tracking", "faces"):
            T.ingest(T.read_frames(spark, folder("tracks" if kind == "tracking" else kind), kind), folder("staging"), kind, "r").awaitTermination()
            T.commit(spark, folder("staging"), kind, "r", folder("results"))
        done = S.read_results(spark, folder("results"))
        assert done.count() == 3000 and done.where("face_score = 0.8").count() == 1500
        for plan in (asked[1], done._jdf.queryExecution().executedPlan().toString()):
            dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
            assert not [line for line in dealt if "frame" not in line] and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_very_many_inputs_are_few_files(spark, tmp_path):
    """5,000 inputs, some of odd names, are committed in a few files; results of single ones are replaced and read."""
    root, many = str(tmp_path / "store"), spark.range(10_000).selectExpr("'glasses_video' as input_kind", "concat('in ', id div 2, '=/%') as input_id", "id % 2 as frame", "1L as track_id", "0.5D as conf")
    P.commit(many, root)
    assert sum(name.endswith(".parquet") for _, _, files in os.walk(root) for name in files) < 100
    P.commit(rows(spark, ["in 7=/%", "new"], 0.9), root)
    assert S.finished(spark, root).count() == 5001 and S.read_results(spark, root).count() == 10_000 - 2 + 6
    assert {(r.frame, r.conf) for r in S.read_results(spark, root).where("input_id = 'in 7=/%'").collect()} == {(0, 0.9), (1, 0.9), (2, 0.9)}


def test_older_stores_are_read(spark, tmp_path):
    """A version with a folder for each input, beside one without."""
    root, old = str(tmp_path / "store"), "0000000001-00000000"
    rows(spark, ["007", "b"], 0.1).write.partitionBy(*P.PARTITIONS).parquet(f"{root}/data/version={old}")
    spark.createDataFrame([("glasses_video", "007", old), ("glasses_video", "b", old)], P.LIVE).write.parquet(f"{root}/snapshots/{old}")
    P._point(spark, root, old)
    assert seen(spark, root) == {("007", 0.1), ("b", 0.1)}
    P.commit(rows(spark, ["b"], 0.2).selectExpr("*", "conf * 2 as face_score"), root)
    assert seen(spark, root) == {("007", 0.1), ("b", 0.2)} and S.read_results(spark, root).where("face_score is null").count() == 3


def test_very_many_inputs_are_one_scan_a_schema(spark, tmp_path):
    """Of 600 inputs some are missing, damaged or no results; the plan has one scan for each of the three schemas."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rnd, paths, want = random.Random(4), {}, {}
    tables = [pa.table({"frame": pa.array([0, 1]), "track_id": [1, 2]}), pa.table({"frame": pa.array([5]), "track_id": [1], "face_score": [0.5]}), pa.table({"frame": pa.array([7]), "track_id": pa.array(["text"])}), pa.table({"other": [1]})]
    for i in range(600):
        name, kind = f"in {i}+%", rnd.choice([0, 0, 0, 1, 1, 3, 4, 5])
        paths[name] = str(tmp_path / f"d{i}")
        if kind < 4:
            os.mkdir(paths[name])
            pq.write_table(tables[kind], f"{paths[name]}/part 1+.parquet")
            want[name] = tables[kind].num_rows
        elif kind == 4:
            (tmp_path / f"d{i}").write_text("damaged")
    bad = {n for n in paths if n not in want or "other" in pq.read_schema(f"{paths[n]}/part 1+.parquet").names}
    with pytest.warns(UserWarning) as told:
        df = S.read_tolerant(spark, paths)
    told = [w for w in told if "no results" in str(w.message)]
    assert len(told) == len(bad) and {str(w.message).split(":")[0].removeprefix("no results for ") for w in told} == bad
    got = {r.input_id: r["count"] for r in df.groupBy("input_id").count().collect()}
    assert got == {n: k for n, k in want.items() if n not in bad}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3
    assert S.read_tolerant(spark, {}) is None


def test_inputs_of_conflicting_schemas(spark, tmp_path):
    S.export(spark.createDataFrame([(0, 1)], "frame long, track_id long"), str(tmp_path / "a"), "parquet")
    S.export(spark.createDataFrame([(1, 2, 0.5)], "frame long, track_id long, conf double"), str(tmp_path / "b"), "parquet")
    found = tolerant.inspect(spark, {"a": str(tmp_path / "a"), "b": f"file:{tmp_path}/b", "c": str(tmp_path / "c")}).collect()
    assert {r.input_id: r.problem for r in found if r.problem} == {"c": f"nothing at {tmp_path}/c"}
    with pytest.warns(UserWarning):
        df = S.read_tolerant(spark, {"a": str(tmp_path / "a"), "b": f"file:{tmp_path}/b", "c": str(tmp_path / "c")})
    assert sorted((r.input_id, r.frame, r.conf) for r in df.collect()) == [("a", 0, None), ("b", 1, 0.5)]
