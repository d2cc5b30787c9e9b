"""A session's turns as a stateful stream: what a user says opens a turn; the state outlives batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.streaming.windows import read_stream


def count_turns(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The state is the count and the messages seen within the time-out, so that a row delivered twice counts once; a session silent for that long is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    n, seen = state.get if state.exists else (0, [])
    known, last = set(seen), 0
    for batch in batches:
        fresh = [m for m in batch.message_id.tolist() if m not in known]
        known.update(fresh)
        last = max(last, int(batch["at"].max().timestamp() * 1000))
    n = n + len(known) - len(seen)
    state.update((n, sorted(known)))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + SILENCE_MS)
    yield pd.DataFrame({"session_id": [key[0]], "n_turns": [n]})


#: A session is over after a day of event time without messages; rows that come later than the watermark's delay are not waited for.
SILENCE_MS, DELAY = 86_400_000, "90 days"


def stream_turn_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = read_stream(spark, path)
    spoken = rows.where(F.lower(F.trim("speaker")).isin("user", "human", "you") & ~F.col("is_meta") & ~F.col("is_sidechain")).select("session_id", "message_id", F.col("turn_timestamp").cast("timestamp").alias("at")).where("at is not null").withWatermark("at", DELAY)
    return spoken.groupBy("session_id").applyInPandasWithState(count_turns, "session_id string, n_turns bigint", "n bigint, seen array<bigint>", "update", "EventTimeTimeout")
