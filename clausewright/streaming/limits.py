"""The rate limiter as a stream: per user the accepted call times of the last window are the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch

SCHEMA = "event_id bigint, accepted boolean"


def rate_limit_stream(events: DataFrame, most: int = 20, seconds: int = 60) -> DataFrame:
    """(event_id, accepted) of a stream of event_id, user_id, ts.

    Calls are taken in the order of time within a batch, batches as they come. A refused call is not
    counted. The watermark is a window behind; a user's state is dropped once it has passed the
    user's last window, so the state holds active users only. Null users and times take no part."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = list(state.get[0]) if state.exists else [], 0.0
        for df in _in_order(batches):
            out = []
            for t in df["ts"]:
                last = max(last, t.timestamp())
                kept = [k for k in kept if k > t.timestamp() - seconds]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(t.timestamp())
            yield pd.DataFrame({"event_id": df["event_id"], "accepted": out})
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    calls = events.where("user_id is not null and ts is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{seconds} seconds")
    return calls.groupBy("user_id").applyInPandasWithState(step, SCHEMA, "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One user's calls of one batch, sorted; a batch is what came since the last trigger."""
    parts = list(batches)
    if parts:
        yield pd.concat(parts).sort_values(["ts", "event_id"])


def run_files(spark: SparkSession, folder: str, schema: str, most: int, seconds: int, per_batch: int = 1) -> DataFrame:
    """The decisions over a folder of Parquet files as a stream, `per_batch` files a batch, oldest first;
    it ends when all files are read. Output and progress stand in the shared folder."""
    out = scratch(spark, "limits")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = rate_limit_stream(events, most, seconds).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{out}/rows")
