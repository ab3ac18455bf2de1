"""Streams: latest job state, retention, incremental ingest, windowed activity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.schema import EVENTS


def event_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(path)


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, last_event, last_type, last_ts, n): the latest state per job; works on streams (update, complete) and tables."""
    at = F.struct("ts", "event_id")
    return events.groupBy(key).agg(
        F.max_by("event_id", at).alias("last_event"), F.max_by("event_type", at).alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): counts per window and type; late rows within the watermark count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def retained(events: DataFrame, key: str = "user_id", seconds: int = 1800) -> DataFrame:
    """Per job and arrival the state that is still held: jobs are forgotten `seconds` after their last event (event time)."""
    out = "job bigint, n bigint, last_ts timestamp, expired boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, ms = state.get
            state.remove()
            yield pd.DataFrame({"job": [k[0]], "n": [n], "last_ts": [pd.Timestamp(ms, unit="ms")], "expired": [True]})
            return
        n, ms = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            ms = max(ms, int(pdf["ts"].max().timestamp() * 1000))
        state.update((n, ms))
        state.setTimeoutTimestamp(max(ms + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [k[0]], "n": [n], "last_ts": [pd.Timestamp(ms, unit="ms")], "expired": [False]})

    return events.withWatermark("ts", "0 seconds").groupBy(key).applyInPandasWithState(step, out, "n bigint, ms bigint", "append", "EventTimeTimeout")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n): activity without a pause of `gap`."""
    s = events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def ingest(stream: DataFrame, key: str, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Runs what has arrived into a Parquet table exactly once per key and returns; a rerun takes only new files.

    Batches are idempotent: a batch number that was written before is overwritten, and ids already in
    the table are left out by an anti-join. Only ids between the batch's smallest and largest are read for that, so
    files of other ranges are skipped by their statistics where ids grow with time.
    """

    def write(batch: DataFrame, number: int) -> None:
        from folioscope.sources.readers import exists

        spark = batch.sparkSession
        fresh = transform(batch).dropDuplicates([key])
        if exists(spark, f"{path}/batch=*"):
            low, high = fresh.agg(F.min(key), F.max(key)).first()
            old = spark.read.parquet(path).where((F.col("batch") != number) & F.col(key).between(low, high)).select(key)
            fresh = fresh.join(old, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that has arrived, through a memory sink (small results only)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
