"""Overlapping analysis windows, recognised segments in them, and removal of repeated segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetime.functions.text import LINE_BREAK, clock_ms, normalized, trimmed

RATE = 16_000
# Fixed value: a line of a recogniser's output.
SEGMENT = r"^\[(\d{2}:\d{2}:\d{2}\.\d{3}) --> (\d{2}:\d{2}:\d{2}\.\d{3})\]:\s*(.*)$"
#: A segment lasts so long at least; equal texts that begin closer than this repeat each other, if not more
#: than so many accepted segments lie between.
LEAST_SEGMENT_MS, REPEAT_MS, LOOK_BACK = 80, 3000, 3


@dataclass(frozen=True)
class WindowPlan:
    """Length and overlap of windows in milliseconds, and how many workers share them."""

    chunk_ms: int = 28_000
    overlap_ms: int = 1_000
    turbo: bool = True

    def __post_init__(self) -> None:
        if not 10_000 <= self.chunk_ms <= 30_000:
            raise ValueError("a window lasts 10 to 30 seconds")
        if not 0 <= self.overlap_ms < self.chunk_ms:
            raise ValueError("the overlap must be shorter than the window")


def window_rows(tracks: DataFrame, plan: WindowPlan = WindowPlan(), samples: str = "sample_count") -> DataFrame:  # noqa: B008
    """Windows ``(…, idx, start_sample, n_samples, unique_samples, start_ms, end_ms)`` of each track.

    The number of windows follows from the length, so this is one generator without a shuffle.  A window adds
    one step of new samples, the whole of a track that fits one window, or what is left.
    """
    size, overlap = plan.chunk_ms * RATE // 1000, plan.overlap_ms * RATE // 1000
    step = max(1, size - overlap)
    n = F.col(samples).cast("long")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("long")
    others = [c for c in tracks.columns if c != samples]
    rows = tracks.where(n > 0).select(*others, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx"))
    start = F.col("idx") * step
    rows = rows.withColumn("start_sample", start).withColumn("n_samples", F.least(F.lit(size), F.col("_n") - start).cast("int"))
    unique = F.when(F.col("_n") <= size, F.col("n_samples").cast("long")).otherwise(F.least(F.lit(step), F.col("_n") - start))
    return rows.select(
        *others, F.col("idx").cast("int").alias("idx"), "start_sample", "n_samples", unique.cast("long").alias("unique_samples"),
        F.expr(f"start_sample * 1000 div {RATE}").alias("start_ms"), F.expr(f"(start_sample + n_samples) * 1000 div {RATE}").alias("end_ms"),
    )


#: Per cent that are done when the first window begins, and those that the windows share.
READY_PERCENT, WINDOW_PERCENT = 15, 85


def window_counts(windows: DataFrame, key: str = "track_id") -> DataFrame:
    """``(key, completed, skipped, processed_ms)`` of windows with ``silent``: all, the silent ones, and the new samples' time.

    A window whose ``silent`` is null is not skipped; tracks without windows have no row.
    """
    return windows.groupBy(key).agg(
        F.count("*").alias("completed"), F.count_if("silent").alias("skipped"), (F.sum("unique_samples") * 1000).alias("_samples")
    ).select(key, "completed", "skipped", F.expr(f"_samples div {RATE}").alias("processed_ms"))


def window_progress(windows: DataFrame, key: str = "track_id") -> DataFrame:
    """``(key, idx, percent, processed_ms, skipped)`` after each window of a track, taken in order."""
    track = Window.partitionBy(key)
    so_far = track.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = windows.select(
        key, "idx", F.count("*").over(so_far).alias("_done"), F.count("*").over(track).alias("_all"), F.sum("unique_samples").over(so_far).alias("_samples"),
        F.sum(F.when(F.col("silent"), 1).otherwise(0)).over(so_far).alias("skipped"),
    )
    return rows.select(key, "idx", F.expr(f"{READY_PERCENT} + _done * {WINDOW_PERCENT} div _all").alias("percent"), F.expr(f"_samples * 1000 div {RATE}").alias("processed_ms"), "skipped")


def worker_of(idx: Column, windows: Column, plan: WindowPlan = WindowPlan()) -> Column:  # noqa: B008
    """The worker that takes a window: two take turns if there are two windows and the plan is turbo."""
    return F.when((windows >= 2) & F.lit(plan.turbo), idx % 2).otherwise(0)


def segment_rows(windows: DataFrame, plan: WindowPlan = WindowPlan(), raw: str = "raw_text") -> DataFrame:  # noqa: B008
    """Segments ``(…, idx, line_no, text, start_ms, end_ms)`` of the recogniser's output for each window.

    Local times become those of the track; a segment ends with its window.  All windows but the first leave
    out segments whose middle lies in the overlap, which the window before has; so are empty ones.
    """
    others = [c for c in windows.columns if c not in (raw, "start_ms", "end_ms")]
    lines = windows.select(*others, F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"), F.posexplode(F.split(raw, LINE_BREAK, -1)).alias("line_no", "_line"))
    lines = lines.withColumn("_line", trimmed(F.col("_line"))).where(F.col("_line").rlike(SEGMENT))
    part = lambda i: F.regexp_extract("_line", SEGMENT, i)
    rows = lines.withColumn("_start", clock_ms(part(1))).withColumn("_end", F.greatest(clock_ms(part(2)), F.col("_start") + LEAST_SEGMENT_MS))
    rows = rows.select(*others, "line_no", "_from", trimmed(part(3)).alias("text"), (F.col("_from") + F.col("_start")).alias("start_ms"), F.least(F.col("_from") + F.col("_end"), F.col("_to")).alias("end_ms"))
    middle = F.col("start_ms") + F.expr("(end_ms - start_ms) div 2")
    accepted = F.col("_from") + F.when(F.col("idx") == 0, 0).otherwise(plan.overlap_ms)
    return rows.where((F.col("text") != "") & (middle >= accepted) & (F.col("end_ms") > F.col("start_ms"))).drop("_from")


def accepted_segments(segments: Iterable[tuple[int, str]], kept: list[tuple[int, str]] | None = None) -> Iterator[bool]:
    """Whether each (start, normalised text), in order of start, is kept: not empty, nor a repeat of the last kept.

    ``kept`` has the last accepted segments before these and then those up to the last one given.
    """
    kept = [] if kept is None else kept
    for start, text in segments:
        keep = bool(text) and not any(text == t and abs(start - s) < REPEAT_MS for s, t in kept)
        if keep:
            kept.append((start, text))
            del kept[:-LOOK_BACK]
        yield keep


def without_repeats(segments: DataFrame, key: str = "track_id", order: list[str] | None = None) -> DataFrame:
    """Segments ``(track_id, …, text, start_ms, …)`` without repeats, in time order within each track.

    Each accepted segment changes what the next is compared with, so a stretch of a track is walked in order; of
    equal starts ``order`` decides.  A track is cut where a segment starts ``REPEAT_MS`` or more after the one
    before it, as no repeat reaches across; stretches are dealt out by themselves and streamed, so no track and no
    stretch has to fit into memory.
    """
    by = ["start_ms", *(order or [])]
    track = Window.partitionBy(key).orderBy(*by)
    opens = (F.row_number().over(track) == 1) | F.coalesce(F.col("start_ms") - F.lag("start_ms").over(track) >= REPEAT_MS, F.lit(False))
    ranked = segments.withColumns({"_norm": normalized(F.col("text")), "_opens": opens})
    ranked = ranked.withColumn("_stretch", F.count_if("_opens").over(track.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_rows = ranked.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", *by).drop("_stretch")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[int, str]] = []
        for own in batches:
            keep = []
            for opens, segment in zip(own["_opens"], zip(own["start_ms"], own["_norm"], strict=True), strict=True):
                if opens:
                    kept.clear()
                keep += accepted_segments([segment], kept)
            yield own[np.array(keep, bool)].drop(columns=["_norm", "_opens"])

    return sorted_rows.mapInPandas(walk, segments.schema)
