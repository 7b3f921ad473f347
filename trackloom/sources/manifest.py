"""Manifests of experiments: one table of inputs and one of settings, their checks and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Keys and defaults of a manifest.
LISTS = {"glasses_videos": "glasses_video", "fixed_videos": "fixed_video", "audio": "audio"}
INPUT_KEYS = {"glasses_video": ["id", "path", "time_offset", "gaze_path"], "fixed_video": ["id", "path", "time_offset"], "audio": ["id", "path", "time_offset", "glasses_video"]}
STEPS = {
    "object_tracking": {"detector": "yolo26m", "reid": "osnet_x1_0_msmt17", "tracker": "botsort", "object_classes": "[0]", "embeddings_per_track": "32"},
    "face_detection": {"model_name": "antelopev2", "det_size": "640", "det_thresh": "0.5", "embeddings_per_track": "32"},
    "body_pose": {"model_name": "yolo26m-pose.pt", "conf": "0.25"},
}
KINDS = ["glasses_video", "fixed_video"]
_MAP = "map<string,string>"


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inputs, pipeline, problems) of all JSON manifests at ``path``.

    inputs: experiment, kind, id, path, time_offset, gaze_path, glasses_video. pipeline: experiment, kind, step, settings (map) for
    each stage that runs: tracking always, faces and poses where given; absent settings take their defaults. problems: experiment,
    problem, for unknown keys and versions newer than ours; their experiments are left out of the other two.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("experiment"), F.from_json("value", _MAP).alias("m"))
    raw = raw.withColumn("p", F.coalesce(F.from_json(F.col("m")["pipeline"], _MAP), F.create_map().cast(_MAP)))
    found = _problems(raw)
    good = raw.join(found.select("experiment").distinct(), "experiment", "left_anti")
    rows = [
        good.select("experiment", F.lit(kind).alias("kind"), F.explode(F.from_json(F.col("m")[name], f"array<{_MAP}>")).alias("i")).select(
            "experiment", "kind", F.col("i")["id"].alias("id"), F.col("i")["path"].alias("path"), F.coalesce(F.col("i")["time_offset"].cast("double"), F.lit(0.0)).alias("time_offset"), F.col("i")["gaze_path"].alias("gaze_path"), F.col("i")["glasses_video"].alias("glasses_video")
        )
        for name, kind in LISTS.items()
    ]
    inputs = rows[0].unionByName(rows[1]).unionByName(rows[2])
    kinds = F.explode(F.array(*(F.lit(k) for k in KINDS))).alias("kind")
    blocks = good.select("experiment", "p", kinds).withColumn("b", F.from_json(F.col("p")[F.col("kind")], _MAP))
    steps = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col("b")[s].alias("given"), F.create_map(*(F.lit(x) for kv in d.items() for x in kv)).alias("defaults")) for s, d in STEPS.items()))).alias("s")
    stages = blocks.select("experiment", "kind", steps).select("experiment", "kind", "s.*").where("step = 'object_tracking' or (given is not null and given <> 'null')")
    own = F.coalesce(F.from_json("given", _MAP), F.create_map().cast(_MAP))
    pipeline = stages.select("experiment", "kind", "step", F.map_concat(F.map_filter("defaults", lambda k, v: ~F.map_contains_key(own, k)), own).alias("settings"))
    return inputs, pipeline, found


def _unknown(keys: Column, allowed: list[str], where: str) -> Column:
    return F.transform(F.array_except(keys, F.array(*(F.lit(k) for k in allowed))), lambda k: F.concat(F.lit(f"unknown key {where}"), k))


def _problems(raw: DataFrame) -> DataFrame:
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    lists = [_unknown(keys("m"), ["version", *LISTS, "pipeline"], ""), _unknown(keys("p"), [*KINDS, "audio"], "pipeline.")]
    for name, kind in LISTS.items():
        items = F.coalesce(F.from_json(F.col("m")[name], f"array<{_MAP}>"), F.array().cast(f"array<{_MAP}>"))
        lists.append(_unknown(F.array_distinct(F.flatten(F.transform(items, F.map_keys))), INPUT_KEYS[kind], f"{name}."))
    for kind in KINDS:
        block = F.from_json(F.col("p")[kind], _MAP)
        lists.append(_unknown(keys(block), list(STEPS), f"pipeline.{kind}."))
        for step, settings in STEPS.items():
            lists.append(_unknown(keys(F.from_json(block[step], _MAP)), list(settings), f"pipeline.{kind}.{step}."))
    lists.append(F.when(F.coalesce(F.col("m")["version"].cast("int"), F.lit(VERSION)) > VERSION, F.array(F.lit("newer version"))).otherwise(F.array().cast("array<string>")))
    lists.append(F.when(F.col("m").isNull(), F.array(F.lit("not a manifest"))).otherwise(F.array().cast("array<string>")))
    return raw.select("experiment", F.explode(F.concat(*lists)).alias("problem"))


def write_manifest(inputs: DataFrame, pipeline: DataFrame, path: str) -> None:
    """Both tables, always, as JSON lines."""
    inputs.write.mode("overwrite").json(f"{path}/inputs")
    pipeline.write.mode("overwrite").json(f"{path}/pipeline")


def violations(inputs: DataFrame, pipeline: DataFrame | None = None) -> DataFrame:
    """(kind, id, problem) for each row rule that is broken: ids, gaze paths and ranges of settings."""
    bad_id = F.coalesce(F.col("id"), F.lit("")).rlike(r"^$|[/\\]|^\.{1,2}$")
    tests = [(bad_id, "bad id")]
    if "gaze_path" in inputs.columns:
        tests.append(((F.col("kind") == "glasses_video") & (F.coalesce("gaze_path", F.lit("")) == ""), "no gaze_path"))
    out = inputs.select("kind", "id", F.explode(F.array(*(F.when(t, F.lit(p)) for t, p in tests))).alias("problem")).where("problem is not null")
    if pipeline is None:
        return out
    ranges = [("face_detection", "det_size", 64, 2048), ("face_detection", "det_thresh", 0, 1), ("body_pose", "conf", 0, 1), ("object_tracking", "embeddings_per_track", 0, float("inf")), ("face_detection", "embeddings_per_track", 0, float("inf"))]
    value = lambda name: F.col("settings")[name].cast("double")
    broken = F.explode(F.array(*(F.when((F.col("step") == s) & ~F.coalesce(value(n).between(lo, hi), F.lit(False)), F.lit(f"{s}.{n} out of range")) for s, n, lo, hi in ranges)))
    return out.unionByName(pipeline.select("kind", F.col("step").alias("id"), broken.alias("problem")).where("problem is not null"))


def duplicate_ids(inputs: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of ids that more than one input has, over all kinds."""
    return inputs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_references(inputs: DataFrame) -> DataFrame:
    """Audio inputs whose glasses_video names no glasses input (a fixed video of that id doesn't count)."""
    audio = inputs.where("kind = 'audio' and glasses_video is not null")
    glasses = inputs.where("kind = 'glasses_video'").select(F.col("id").alias("glasses_video")).distinct()
    return audio.join(glasses, "glasses_video", "left_anti").select("id", "glasses_video")


def referenced_glasses(inputs: DataFrame) -> DataFrame:
    """Glasses inputs that audio still refers to: they can't be removed."""
    used = inputs.where("kind = 'audio'").select(F.col("glasses_video").alias("id"))
    return inputs.where("kind = 'glasses_video'").join(used, "id", "left_semi")


def with_settings(inputs: DataFrame, pipeline: DataFrame) -> DataFrame:
    """A row for each input and stage that runs over it: each kind has settings of its own, audio has no stage."""
    return inputs.join(pipeline, [c for c in ("experiment", "kind") if c in inputs.columns and c in pipeline.columns])


def distinct_ids(inputs: DataFrame) -> DataFrame:
    return inputs.select("id").distinct().orderBy("id")


def resolve(path: Column, folder: Column) -> Column:
    """A relative path joined to its folder; an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), path))


def store(path: Column, folder: Column) -> Column:
    """The inverse: a path inside the folder becomes relative."""
    inside = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(inside), F.substr(path, F.length(inside) + 1)).otherwise(path)


def has_parent_segments(path: Column) -> Column:
    """Whether a path holds ``..``: flagged, not resolved."""
    return path.rlike(r"(^|/)\.\.(/|$)")


def missing_files(inputs: DataFrame, listing: DataFrame) -> DataFrame:
    """Inputs whose resolved ``path`` is not in ``listing`` (path)."""
    return inputs.join(listing.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")).distinct(), "path", "left_anti")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def require_files(inputs: DataFrame, listing: DataFrame, name: int = 20) -> DataFrame:
    """``inputs`` itself if all their files are there; else an error that names the first of those without."""
    missing = missing_files(inputs, listing)
    lost = [r["id"] for r in missing.select("id").orderBy("id").limit(name + 1).collect()]
    if lost:
        raise FileNotFoundError(f"no file for {', '.join(map(str, lost[:name]))}{' and more' if len(lost) > name else ''}")
    return inputs
