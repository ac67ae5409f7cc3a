"""Streaming forms of the event operators; with all data at hand they end in the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, directory: str, glob: str = "events.parquet") -> DataFrame:
    """Events of a directory as a file stream, times with a zone."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 64).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(events: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    """Sessions by gaps; rows later than the watermark are left out, closed sessions come out once."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "events", "value")


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one key at least a minute after the last one taken; the state is that one time, dropped once no row can depend on it."""
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"])  # of one key in one micro-batch, whose files are bounded
    taken = []
    for us, event in zip(rows["us"], rows["event_id"]):
        if last is None or us - last >= 60_000_000:
            last = int(us)
            taken.append(event)
    state.update((last,))
    state.setTimeoutTimestamp(max(last // 1000 + 60_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"event_id": taken, "user_id": key[0], "event_type": key[1]})


def stream_accepted(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The 60-second rule as a stateful operator: one long of state per user and type, for a minute beyond the watermark.

    Rows that arrive out of order within a micro-batch are put in order; a row older than what was already taken, or than the watermark, is dropped.
    """
    keyed = events.withWatermark("ts", late).select("user_id", "event_type", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("user_id", "event_type").applyInPandasWithState(_accept, "event_id bigint, user_id bigint, event_type string", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write everything that is there now and stop; started again, it goes on where it stopped."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
