"""The best K rows of each track of a stream, in keyed state.

The state of a track is what the exact rule needs of its history, whatever the order in which it came: the rows above its k-th score s, and of
those of score s the first k by arrival. That is fewer than 2 k rows, and two such states make that of both histories together, so a restart from
the checkpoint, late files and hot tracks change nothing. From it the rows of a heap of k fed by arrival follow: of the rows of score s, those among
the first k arrivals of score s or more may stay, and of them the latest do.

A batch reads and writes the state of its own tracks only (RocksDB keeps it), and hands on these tracks' rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import present
from ..operators.detections import keys_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needed(rows: pd.DataFrame, k: int, arrival: str) -> pd.DataFrame:
    """Of a track's rows those that may matter later: all above the k-th score, and the first k of that score."""
    if len(rows) <= k:
        return rows
    least = rows["score"].nlargest(k).iloc[-1]
    ties = rows[rows["score"] == least].sort_values(arrival, kind="stable").head(k)
    return pd.concat([rows[rows["score"] > least], ties])


def chosen(rows: pd.DataFrame, k: int, arrival: str) -> pd.DataFrame:
    """Of the rows that ``needed`` left, those of a heap of k."""
    if len(rows) <= k:
        return rows
    least = rows["score"].nlargest(k).iloc[-1]
    above, first = rows[rows["score"] > least], rows.sort_values(arrival, kind="stable").head(k)
    return pd.concat([above, first[first["score"] == least].tail(k - len(above))])


class Ranked(StatefulProcessor):
    """One value a track: the rows that are needed of its history."""

    def __init__(self, k: int, arrival: str, columns: list[str]):
        self.k, self.arrival, self.columns = k, arrival, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rows", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        for part in rows:
            part = part[self.columns]
            held = needed(part if held is None else pd.concat([held, part], ignore_index=True), self.k, self.arrival)
        if held is not None:
            self.state.update((pickle.dumps(held),))
            yield chosen(held, self.k, self.arrival)

    def close(self) -> None:
        pass


def keep_top_k(scored: DataFrame, state: str, checkpoint: str, k: int, keys: list[str] | None = None, arrival: str = "frame") -> StreamingQuery:
    """Keep the k best rows of each track of a stream, ties as ``embeddings.top_k(ties="exact")``: scores missing, or without a vector, take no part.

    Each batch writes the rows of the tracks that it touched to a folder of its own (a batch that runs again replaces it); ``read_top_k`` gives each track's latest.
    """
    if k <= 0:
        raise ValueError("k is at least 1")
    spark, keys = scored.sparkSession, keys or [c for c in keys_of(scored) if c != "frame"]
    rows = scored.where(present("score") & (F.col("embedding").isNotNull() if "embedding" in scored.columns else F.lit(True)))
    ranked = rows.groupBy(*keys).transformWithStateInPandas(Ranked(k, arrival, rows.columns), rows.schema, "Update", "None")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/epoch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query takes it from the session when it starts
    try:
        return ranked.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def read_top_k(spark: SparkSession, state: str, keys: list[str]) -> DataFrame:
    """The rows that ``keep_top_k`` has kept: of each track those of its latest epoch."""
    every = spark.read.parquet(state)
    latest = every.groupBy(*keys).agg(F.max("epoch").alias("_latest"))
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"latest.{c}")) for c in keys]
    return every.alias("rows").join(latest.alias("latest"), [*same, F.col("rows.epoch") == F.col("latest._latest")], "left_semi").drop("epoch")
