"""Removal of repeated segments in a stream, with the last accepted segments of each track as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from versetime.functions.text import normalized
from versetime.operators.windows import accepted_segments


def without_repeats_stream(segments: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Segments ``(track_id, text, start_ms, end_ms)`` of a stream without repeats, in order within a batch.

    A segment is compared with the last accepted of its track, which the state keeps, so what came in an
    earlier batch counts as earlier.  The state goes when a track has had no segment for ``idle_ms``; Spark then
    runs batches without data for ever to see to that, so a query that is to end (``availableNow``) takes None,
    which keeps the state.
    """
    rows = segments.select("track_id", "text", "start_ms", "end_ms", normalized(F.col("text")).alias("_norm"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        own = pd.concat(list(batches)).sort_values("start_ms", kind="stable")
        keep = list(accepted_segments(zip(own["start_ms"].astype(int), own["_norm"], strict=True), kept))
        state.update(([int(s) for s, _ in kept], [t for _, t in kept]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield own[keep].drop(columns="_norm")

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("track_id").applyInPandasWithState(
        step, "track_id string, text string, start_ms long, end_ms long", "starts array<long>, norms array<string>", "append", timeout
    )
