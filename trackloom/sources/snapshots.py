"""Results of many inputs in versions behind one pointer: a commit shows whole or not at all.

A store is a folder: ``data/version=<v>/`` holds the rows that commit v wrote, sorted by input in as many files as their size asks for, not a folder for each input (older stores have such
folders, ``input_kind=<k>/input_id=<i>/``; they are read too). ``snapshots/<v>/`` is a table of which version each input's
results are in, and the file ``CURRENT`` names one snapshot. A commit writes its data, then its snapshot, and last
replaces the pointer by a rename, which the file system does at once. Readers start from the pointer, so whatever a commit that died
has left behind is never read; ``vacuum`` deletes it. One writer at a time: a commit that finds another one come between is an error and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import few

PARTITIONS = ["input_kind", "input_id"]
POINTER = "CURRENT"
LIVE = "input_kind string, input_id string, version string"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def current(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names; None if nothing was committed."""
    fs, where = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream)).readLine()
    finally:
        stream.close()


def live(spark: SparkSession, root: str) -> DataFrame:
    """(input_kind, input_id, version) of the current snapshot."""
    name = current(spark, root)
    return spark.createDataFrame([], LIVE) if name is None else spark.read.schema(LIVE).parquet(f"{root}/snapshots/{name}")


def read(spark: SparkSession, root: str) -> DataFrame:
    """All inputs' current rows; a column that an input's rows lack is null there. An error if nothing was committed."""
    inputs = live(spark, root)
    versions = sorted(r[0] for r in inputs.select("version").distinct().collect())  # at most one for each input
    if not versions:
        raise ValueError("there are no results")
    layouts: dict[bool, list[str]] = {}
    for v in versions:
        path = f"{root}/data/version={v}"
        layouts.setdefault(_in_folders(spark, path), []).append(path)
    tables = [_rows(spark, root, paths) for _, paths in sorted(layouts.items())]
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True)
    return rows.join(few(inputs), [*PARTITIONS, "version"], "left_semi").drop("version")


def _in_folders(spark: SparkSession, path: str) -> bool:
    """Whether a version was written with a folder for each input, as older ones were."""
    fs, where = _fs(spark, path)
    return any(s.getPath().getName().startswith(f"{PARTITIONS[0]}=") for s in fs.listStatus(where))


def _rows(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    reader = lambda: spark.read.option("basePath", f"{root}/data")
    found = reader().option("mergeSchema", "true").parquet(*paths).schema
    text = StructType([StructField(f.name, StringType()) if f.name in (*PARTITIONS, "version") else f for f in found.fields])  # ids stay text, whatever they look like
    return reader().schema(text).parquet(*paths)


def commit(df: DataFrame, root: str) -> str:
    """Make ``df`` (with input_kind and input_id) the results of the inputs that it has rows of; other inputs keep theirs. Returns the new version."""
    spark, base = df.sparkSession, current(df.sparkSession, root)
    name = f"{int(base.split('-')[0]) + 1 if base else 1:010d}-{uuid.uuid4().hex[:8]}"
    order = [c for c in ("frame", "track_id") if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("string") for c in PARTITIONS})
    rows = df.repartition(*PARTITIONS, F.floor(F.col("frame") / 100_000)) if "frame" in df.columns else df  # a long recording is more than one file
    rows.sortWithinPartitions(*PARTITIONS, *order).write.parquet(f"{root}/data/version={name}")
    folders = StructType([StructField(c, StringType()) for c in PARTITIONS])
    new = spark.read.schema(folders).parquet(f"{root}/data/version={name}").select(*PARTITIONS).distinct().withColumn("version", F.lit(name))
    kept = live(spark, root).join(new, PARTITIONS, "left_anti")
    kept.unionByName(new).coalesce(1).write.parquet(f"{root}/snapshots/{name}")  # a row for each input
    if current(spark, root) != base:
        raise RuntimeError("another commit came between")
    _point(spark, root, name)
    return name


def _point(spark: SparkSession, root: str, name: str) -> None:
    """Replace the pointer by one rename."""
    fs, draft = _fs(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(name.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(draft, _fs(spark, f"{root}/{POINTER}")[1], how)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete versions of which no input's current results are, and old snapshots. Nobody may be reading older ones. Returns the names."""
    name, used, gone = current(spark, root), {r[0] for r in live(spark, root).select("version").distinct().collect()}, []
    for folder, prefix, keep in (("data", "version=", used), ("snapshots", "", {name})):
        fs, where = _fs(spark, f"{root}/{folder}")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            own = status.getPath().getName()
            if own.startswith(prefix) and own.removeprefix(prefix) not in keep:
                fs.delete(status.getPath(), True)
                gone.append(f"{folder}/{own}")
    return sorted(gone)
