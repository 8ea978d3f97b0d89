"""Structured Streaming: stores kept up to date by file and the debounce state as a stream.

These run the same merges and folds continuously. The event
windows at the end are an extension.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.stats import CLEAN_RUNS, DIRTY_RUNS, DOWN, LEAST, MOST, UP
from loomgraph.operators.store import BucketedStore


def maintain(store: BucketedStore, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Every micro-batch replaces the rows of the files that it brings. A batch that is replayed
    writes the same rows again."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.checkpoint()
        store.replace_files(batch, batch.select("file_path").distinct())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounce_stream(runs: DataFrame) -> DataFrame:
    """linter_name, work_dir, factor after each micro-batch of executions, which come in time order per key."""
    import pandas as pd

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        factor, clean, dirty = state.get if state.exists else (1.0, 0, 0)
        for count in pd.concat(list(frames)).sort_values(["executed_at", "violation_count"])["violation_count"]:
            clean, dirty = (clean + 1, 0) if count == 0 else (0, dirty + 1)
            if clean >= CLEAN_RUNS:
                factor = min(MOST, factor * UP)
            elif dirty >= DIRTY_RUNS:
                factor = max(LEAST, factor * DOWN)
        state.update((factor, clean, dirty))
        yield pd.DataFrame({"linter_name": [key[0]], "work_dir": [key[1]], "factor": [factor]})

    return runs.groupBy("linter_name", "work_dir").applyInPandasWithState(update, "linter_name string, work_dir string, factor double", "factor double, clean int, dirty int", "update", "NoTimeout")


def daily(events: DataFrame) -> DataFrame:
    """Extension: events per day and type; on a stream, a day closes an hour after its end."""
    timed = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions per user."""
    timed = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def read_stream(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
