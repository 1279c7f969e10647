"""Streaming extensions, beyond what batch ledgers need: event-time windows with watermarks, ledger tails, and exactly-once
sinks. All take and return streaming or batch DataFrames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of append-only Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and sums by window; later rows than the watermark are dropped once their window is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Windows that close after a gap without rows."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch under its number, so a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drift(events: DataFrame, by: str = "user_id") -> DataFrame:
    """(key, n, mean): running counts and means kept as state for each key; updates in every batch that has its rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [total / n if n else 0.0]})

    return events.groupBy(by).applyInPandasWithState(step, "key bigint, n bigint, mean double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it put out (a table in memory, for tests and small queries)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
