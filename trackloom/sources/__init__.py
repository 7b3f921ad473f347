"""Readers and writers of results, embeddings, gaze, audio results and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import from_half, to_half
from ..schemas import EMBEDDINGS, EMBEDDINGS_HALF, FRAME_BUCKET, FRAMES_A_BUCKET, GAZE
from . import snapshots
from .shared import stow
from .tolerant import read_tolerant

PARTITIONS = ["input_kind", "input_id"]


def check_results(df: DataFrame) -> DataFrame:
    """``df`` itself, if it is a table of results: it has a column ``frame``."""
    if "frame" not in df.columns:
        raise ValueError("results need a column 'frame'")
    return df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all inputs at ``path`` (a folder of partitions, or a store of ``snapshots``); inputs may have had different passes, so their columns are put together."""
    if snapshots.current(spark, path) is not None:
        return check_results(snapshots.read(spark, path))
    return check_results(spark.read.option("mergeSchema", "true").parquet(path))


def empty_embeddings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMBEDDINGS)


def read_embeddings(spark: SparkSession, path: str, half: bool = False) -> DataFrame:
    """Companion embeddings; none if the path is absent. ``half``: stored as half-precision bytes."""
    if not exists(spark, path):
        return empty_embeddings(spark)
    df = spark.read.schema(EMBEDDINGS_HALF if half else EMBEDDINGS).parquet(path)
    return df.withColumn("embedding", F.transform("embedding", from_half)) if half else df


def stack(tables: list[DataFrame]) -> DataFrame:
    """Tables one after another; a column that a table lacks is null there. Pairs are stacked, so that the plan stays shallow."""
    while len(tables) > 1:
        tables = [tables[i].unionByName(tables[i + 1], allowMissingColumns=True) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def by_input(df: DataFrame) -> list[str]:
    return [c for c in PARTITIONS if c in df.columns]


def write_results(df: DataFrame | None, path: str) -> None:
    """One partition for each input that has rows, sorted by frame; other inputs' partitions stay. An error if there is no data."""
    if df is None or df.isEmpty():
        raise ValueError("there is no data to write")
    order = [c for c in ("frame", "track_id", "seg_start", "start") if c in df.columns]
    rows = df.repartition(*by_input(df), F.floor(F.col(order[0]) / 100_000)) if by_input(df) and order else df  # a long recording is more than one file
    rows = rows.sortWithinPartitions(*by_input(df), *order) if order else rows
    _write(rows, path)


def _write(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by_input(df)) if by_input(df) else writer).parquet(path)


def write_embeddings(df: DataFrame, path: str, inputs: DataFrame) -> None:
    """Embeddings of a run over ``inputs`` (input_kind, input_id), rounded to half precision; inputs that kept none lose their old ones."""
    spark = df.sparkSession
    kinds = {"track_id": "bigint", "frame": "bigint", "score": "float"}
    rows = df.select(*by_input(df), *(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.transform("embedding", to_half).alias("embedding"))
    rows = stow(rows, "embeddings")  # ``df`` may read what is replaced
    _write(rows, path)
    kept = rows.select(*PARTITIONS).distinct()
    for r in inputs.select(*PARTITIONS).distinct().join(kept, PARTITIONS, "left_anti").collect():  # a manifest's rows
        delete(spark, f"{path}/input_kind={r['input_kind']}/input_id={r['input_id']}")


def frame_bucket(frame: str = "frame") -> Column:
    return F.floor(F.col(frame) / FRAMES_A_BUCKET).cast("int")


def write_frames(df: DataFrame, path: str) -> None:
    """Raw frames in folders by input and bucket of frames, so that a pass over few of them (``geometry.wanted_frames``) reads few files."""
    rows = df.withColumn(FRAME_BUCKET, frame_bucket())
    parts = [*by_input(df), FRAME_BUCKET]
    rows.repartition(*parts).sortWithinPartitions(*parts, "frame").write.mode("overwrite").partitionBy(*parts).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames as ``write_frames`` stored them, with frame_bucket."""
    return spark.read.parquet(path)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio results: any columns."""
    return spark.read.parquet(path)


write_audio = write_results


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """Gaze samples: tab-separated with a header, NA for missing."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=GAZE)


def export(df: DataFrame, path: str, kind: str) -> None:
    """CSV with a header, JSON lines or Parquet. Nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode("overwrite").csv(path, header=True)
    elif kind in ("json", "parquet"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown export {kind}")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(input_kind, input_id) of the inputs with a partition of results, readable or not: only folder names are read."""
    kind = f"{', '.join(f'{c} string' for c in PARTITIONS)}"
    if snapshots.current(spark, path) is not None:
        return snapshots.live(spark, path).select(*PARTITIONS)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    fs, _ = _fs(spark, path)
    found = [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/input_kind=*/input_id=*"))]
    return spark.createDataFrame([tuple(x.rsplit("=", 1)[1] for x in p.rsplit("/", 2)[1:]) for p in found], kind)


def pending_inputs(inputs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Inputs without results; all with ``force``."""
    return inputs if force else inputs.join(done, [c for c in PARTITIONS if c in inputs.columns and c in done.columns], "left_anti")


__all__ = ["check_results", "delete", "empty_embeddings", "exists", "export", "finished", "frame_bucket", "pending_inputs", "read_audio", "read_embeddings", "read_frames", "read_gaze", "read_results", "read_tolerant", "snapshots", "stack", "write_audio", "write_embeddings", "write_frames", "write_results"]
