"""Passes as streams: frames are staged as they come; a pass becomes visible when it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.detections import flatten_faces, flatten_poses, flatten_tracks, join_faces, join_poses, keys_of
from ..schemas import RAW_FACES, RAW_POSES, RAW_TRACKS
from ..sources import delete, exists, snapshots
from ..sources.shared import few, forget, stow
from .ranked import keep_top_k, read_top_k

RAW = {"tracking": RAW_TRACKS, "faces": RAW_FACES, "poses": RAW_POSES}


def raw_schema(kind: str) -> str:
    return f"input_kind string, input_id string, {RAW[kind]}"


def read_frames(spark: SparkSession, path: str, kind: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of per-frame results of a pass, from Parquet files that arrive at ``path``."""
    return spark.readStream.schema(raw_schema(kind)).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def staging_path(staging: str, kind: str, run_id: str) -> str:
    return f"{staging}/{kind}/run_id={run_id}"


def ingest(frames: DataFrame, staging: str, kind: str, run_id: str) -> StreamingQuery:
    """Append each batch to the run's staging folder; nothing shows in the results. Each batch has a folder of its own, so that a
    batch run again after a failure replaces itself."""
    path = staging_path(staging, kind, run_id)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def staged(spark: SparkSession, staging: str, kind: str, run_id: str) -> DataFrame:
    path = f"{staging_path(staging, kind, run_id)}/frames"
    return spark.read.schema(raw_schema(kind)).parquet(path) if exists(spark, path) else spark.createDataFrame([], raw_schema(kind))


def commit(spark: SparkSession, staging: str, kind: str, run_id: str, results: str) -> None:
    """Make a finished run visible: tracks replace an input's results, faces and poses are joined onto its tracks.

    ``results`` is a store of ``snapshots``: all inputs of the run change at once, and a commit that dies on the way changes none. It can then be
    made again, since the run stays staged until its results are visible.
    """
    raw, inputs = staged(spark, staging, kind, run_id), None
    if raw.isEmpty():  # a run without frames: results stay as they are
        return discard(spark, staging, kind, run_id)
    if kind == "tracking":
        rows = flatten_tracks(raw)
    else:
        inputs = stow(raw.select("input_kind", "input_id").distinct(), "inputs")
        tracks = snapshots.read(spark, results).join(few(inputs), ["input_kind", "input_id"], "left_semi")
        rows = join_faces(tracks, flatten_faces(raw)) if kind == "faces" else join_poses(tracks, flatten_poses(raw))
    snapshots.commit(rows, results)
    if inputs is not None:
        forget(inputs)
    discard(spark, staging, kind, run_id)


def discard(spark: SparkSession, staging: str, kind: str, run_id: str) -> None:
    """Roll a run back (or clean up after it): results stay as they are."""
    delete(spark, staging_path(staging, kind, run_id))


def live_view(frames: DataFrame, stored: DataFrame) -> DataFrame:
    """A stream of frames with the boxes already stored for each (null where there are none)."""
    keys = [k for k in keys_of(stored) if k != "track_id"]
    boxes = stored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("track_id", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return frames.withColumnRenamed("frame_idx", "frame").join(boxes, keys, "left")


def progress(frames: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Of each input the latest frame, and of how many."""
    latest = frames.groupBy("input_id").agg(F.max("frame_idx").alias("latest"))
    return latest.join(totals, "input_id", "left") if totals is not None else latest


class Progress(StreamingQueryListener):
    """Calls ``tell`` with the run's name, the latest frame so far, how many rows it has taken in and of how many, after each batch of a query that ``observed`` names.

    Spark's own events carry the figures: no batch is computed again or collected for them.
    """

    def __init__(self, tell, total: int | None = None):
        self.tell, self.total, self.latest, self.rows = tell, total, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, seen in (event.progress.observedMetrics or {}).items():
            if name.startswith(OBSERVED):
                run = name.removeprefix(OBSERVED)
                if seen["latest"] is not None:
                    self.latest[run] = max(self.latest.get(run, seen["latest"]), seen["latest"])
                self.rows[run] = self.rows.get(run, 0) + seen["rows"]
                self.tell(run, self.latest.get(run), self.rows[run], self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


OBSERVED = "progress of "


def observed(frames: DataFrame, run: str) -> DataFrame:
    """``frames`` itself, reporting its progress under ``run`` to a ``Progress`` listener of the session."""
    return frames.observe(f"{OBSERVED}{run}", F.max("frame_idx").alias("latest"), F.count("*").alias("rows"))


__all__ = ["OBSERVED", "Progress", "RAW", "commit", "discard", "ingest", "keep_top_k", "live_view", "observed", "progress", "raw_schema", "read_frames", "read_top_k", "staged", "staging_path"]
