"""The driver's tables seen as tables of an experiment. SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """SELECT frame, track_id, x1, y1, x1 + q*4.0 AS x2, y1 + q*3.0 AS y2, 0.5 + d*4.0 AS conf, cls FROM (
  SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS track_id, CAST(min(l_partkey) % 1280 AS DOUBLE) + 0.5 AS x1,
         CAST((min(l_suppkey)*7) % 720 AS DOUBLE) + 0.5 AS y1, min(l_quantity) AS q, min(l_discount) AS d, min(l_partkey) % 3 AS cls
  FROM lineitem GROUP BY l_orderkey, l_linenumber) t"""

CANDIDATES = """SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS track_id, l_partkey AS cand_id, 0.4 + l_discount*5.0 AS score,
       l_tax*100.0 AS bx1, l_discount*100.0 AS by1, l_tax*100.0 + l_quantity AS bx2, l_discount*100.0 + l_quantity AS by2 FROM lineitem WHERE """
FACES = CANDIDATES + "l_returnflag <> 'N'"
POSES = CANDIDATES + "l_linestatus = 'F'"

EMBEDDINGS = "SELECT CAST(label AS BIGINT) AS track_id, vec_id AS frame, CAST((vec_id*37) % 20 AS DOUBLE)/20.0 AS score, embedding FROM embeddings"

INPUTS = """SELECT s_name AS id, 'in-' || CAST(s_nationkey AS STRING) AS short_id, CASE s_suppkey % 3 WHEN 0 THEN 'glasses_video' WHEN 1 THEN 'fixed_video' ELSE 'audio' END AS kind,
       s_acctbal/1000.0 AS time_offset, CASE WHEN s_suppkey % 3 = 2 THEN 'Supplier#' || lpad(CAST(s_suppkey - 1 - (s_suppkey % 2) AS STRING), 9, '0') END AS glasses_video FROM supplier"""

#: Milliseconds since the first of January 2024: Spark's and DuckDB's form.
GAZE = """SELECT event_id, user_id AS participant, {ms} - 1704067200000 AS gaze_video_time,
       CASE WHEN event_type <> 'error' THEN value*10.0 END AS gaze_x, CASE WHEN event_type <> 'error' THEN value*5.0 END AS gaze_y FROM events"""
GAZE_SPARK, GAZE_DUCK = GAZE.format(ms="unix_millis(CAST(ts AS TIMESTAMP))"), GAZE.format(ms="epoch_us(ts)//1000")

SEGMENTS = """SELECT conv_id AS audio_id, turn, CAST(turn AS DOUBLE)*2.5 AS seg_start,
       CAST(turn AS DOUBLE)*2.5 + CAST(length(text) % 20 AS DOUBLE)/10.0 AS seg_end, role FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The rows of ``sql`` over one table of ``sf_dir``."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def tracks(spark, sf_dir):
    return made(spark, sf_dir, TRACKS, "lineitem")


def faces(spark, sf_dir):
    return made(spark, sf_dir, FACES, "lineitem")


def poses(spark, sf_dir):
    return made(spark, sf_dir, POSES, "lineitem")


def embeddings(spark, sf_dir):
    return made(spark, sf_dir, EMBEDDINGS, "embeddings")


def inputs(spark, sf_dir):
    return made(spark, sf_dir, INPUTS, "supplier")


def gaze(spark, sf_dir):
    return made(spark, sf_dir, GAZE_SPARK, "events")


def segments(spark, sf_dir):
    return made(spark, sf_dir, SEGMENTS, "conversations")
