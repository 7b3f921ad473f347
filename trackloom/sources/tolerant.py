"""Results of very many inputs, some of them missing, damaged or no results at all.

The inputs' files are listed and their footers read in one distributed job; files are then grouped by schema, and each schema is one scan, however many inputs
have it. So the number of plans follows the number of schemas, not of inputs, and a file of another schema cannot spoil the scan of the others.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stow

FOUND = "input_id string, file string, kind string, problem string"


def files_of(path: str) -> list[tuple[str, str]]:
    """(file, its schema as text) of each Parquet file at a path; raises OSError or ValueError if there are none or one cannot be read."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        store, inside, prefix = fs.LocalFileSystem(), parts.path or path, ""
    else:
        try:
            store, inside = fs.FileSystem.from_uri(path)
        except pa.ArrowInvalid as e:  # not an input's fault: the job fails
            raise NotImplementedError(f"footers are read with Arrow, which knows no {parts.scheme}:// ({e})") from e
        prefix = f"{parts.scheme}://{parts.netloc}" if inside.startswith("/") else f"{parts.scheme}://"
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"nothing at {path}")
    every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    data = sorted(i.path for i in every if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    if not data:
        raise ValueError(f"no files at {path}")
    out = []
    for name in data:
        try:
            with store.open_input_file(name) as f:
                schema = pq.read_schema(f)
        except pa.ArrowException as e:
            raise ValueError(f"{name}: {str(e).splitlines()[0]}") from e
        out.append((prefix + name, "; ".join(f"{x.name} {x.type}" for x in schema)))
    return out


def inspect(spark: SparkSession, paths: dict[str, str], needed: str = "frame", per_task: int = 200) -> DataFrame:
    """(input_id, file, kind, problem): the files of each input (id -> path) with their schema as text, or one row with its problem."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for input_id, path in zip(batch["input_id"], batch["path"], strict=True):
                try:
                    files = files_of(path)
                    if any(needed not in (column.rsplit(" ", 1)[0] for column in kind.split("; ")) for _, kind in files):
                        raise ValueError(f"results need a column '{needed}'")
                    rows += [(input_id, f, kind, None) for f, kind in files]
                except (OSError, ValueError) as e:
                    rows.append((input_id, None, None, str(e).splitlines()[0]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    inputs = spark.createDataFrame(sorted(paths.items()), "input_id string, path string") if paths else spark.createDataFrame([], "input_id string, path string")
    return inputs.repartition(max(1, -(-len(paths) // per_task)), "input_id").mapInPandas(look, FOUND)


def read_tolerant(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """Results of all inputs (id -> path) that can be read, with input_id; a warning for each other. None if there is none."""
    found = stow(inspect(spark, paths), "footers")
    for r in found.where("problem is not null").orderBy("input_id").collect():  # one for each input at most, as the caller has them
        warnings.warn(f"no results for {r['input_id']}: {r['problem']}", stacklevel=2)
    good = found.where("problem is null").select("input_id", "file", "kind")
    scans = []
    owner = good.select("input_id", F.col("file").alias("_file"))
    for r in good.groupBy("kind").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("kind").collect():  # the reader takes paths from the driver
        rows = spark.read.parquet(*r["files"])
        # the same form on both sides: decoded, without file:
        where = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        scans.append(rows.drop("input_id").withColumn("_file", where) if "input_id" in rows.columns else rows.withColumn("_file", where))
    if not scans:
        return None
    every = scans[0]
    for more in scans[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return every.join(owner, "_file").drop("_file")
