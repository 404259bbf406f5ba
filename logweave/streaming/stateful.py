"""Plugins that keep state between events, on Structured Streaming.

The state of a key is a few numbers, with a timeout on event time, so it stays bounded by the keys that are
active within the watermark. On batches the same plugins are window functions (plans.runtime).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.plans.runtime import Runtime, run_parser
from logweave.sources.folders import shared_path


def run_parser_stream(code: str, events: DataFrame, runtime: Runtime | None = None, fields: list[str] | None = None) -> DataFrame:
    """A compiled parser on a stream. Plugins that look at other events are refused: use the functions below."""
    if not events.isStreaming:
        raise ValueError("events must be a stream")
    return run_parser(code, events, runtime, fields)


def _timeout(state: GroupState, seconds: int) -> None:
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + seconds * 1000 + 1)


def elapsed_stream(events: DataFrame, key: str, time: str, tie: str, watermark: str = "1 hour", timeout_s: int = 86_400) -> DataFrame:
    """(key, tie, seconds): time since the previous event of the key, null for its first."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["micros", "tie"], kind="stable")
        last = state.get[0] if state.exists else None
        before = [last, *rows["micros"].tolist()[:-1]]
        state.update((int(rows["micros"].iloc[-1]),))
        _timeout(state, timeout_s)
        yield pd.DataFrame({"key": str(k[0]), "tie": rows["tie"].to_numpy(), "seconds": [None if b is None else (m - b) / 1e6 for m, b in zip(rows["micros"], before, strict=True)]})

    slim = events.withWatermark(time, watermark).select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), F.col(time).alias("at"), F.unix_micros(F.col(time)).alias("micros"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, tie long, seconds double", "micros long", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_stream(events: DataFrame, key: str, time: str, tie: str, after_count: int, watermark: str = "1 hour", timeout_s: int = 3600) -> DataFrame:
    """(key, tie, throttled): whether the key has had more than after_count events; the count ends with the timeout."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["micros", "tie"], kind="stable")
        seen = state.get[0] if state.exists else 0
        state.update((seen + len(rows),))
        _timeout(state, timeout_s)
        yield pd.DataFrame({"key": str(k[0]), "tie": rows["tie"].to_numpy(), "throttled": [seen + n + 1 > after_count for n in range(len(rows))]})

    slim = events.withWatermark(time, watermark).select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), F.col(time).alias("at"), F.unix_micros(F.col(time)).alias("micros"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, tie long, throttled boolean", "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def aggregate_stream(events: DataFrame, task: str, time: str, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """(task, start, end, n): the events of a task until it rests for ``gap``, as a session window."""
    held = events.withWatermark(time, watermark)
    sessions = held.groupBy(F.session_window(F.col(time), gap).alias("w"), F.col(task).cast("string").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("task", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, append the result to the shared folder, and read it."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).outputMode("append").start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
