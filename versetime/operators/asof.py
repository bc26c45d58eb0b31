"""Which line is active at a time, and what of it is highlighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetime.functions.text import word_range
from versetime.operators.scan import RANGE_MS, Running, running


def frame_clock(tracks: DataFrame, frames_a_second: int, duration: str = "duration_ms") -> DataFrame:
    """``(…, frame_no, time_ms)`` for each frame of a track; frame times are whole microseconds, cut to milliseconds."""
    others = [c for c in tracks.columns if c != duration]
    frames = F.expr(f"({duration} * {frames_a_second} + 999) div 1000")
    rows = tracks.where(F.col(duration) > 0).select(*others, F.explode(F.sequence(F.lit(0).cast("long"), frames - 1)).alias("frame_no"))
    return rows.withColumn("time_ms", F.expr(f"frame_no * 1000000 div {frames_a_second} div 1000"))


def active_lines(clock: DataFrame, lines: DataFrame, key: str = "track_id", *, first_line: bool = True) -> DataFrame:
    """The clock's rows with the line that is active: the last by ``line_no`` of those that have started.

    Before any start it is the first line, or with ``first_line`` false none.  Adds ``line_no, text,
    start_ms, end_ms`` and ``previous_text, next_text``.  Lines ``(track_id, line_no, text, start_ms,
    end_ms)`` need not start in order.

    Lines and clock are put together and swept in order of time, keeping the greatest line seen; there is no range
    join, and the sweep is in two phases, so a long track is spread over tasks.  It carries a line's number alone, which
    no two of a track share; the texts join by it at the end.
    """
    text = F.struct("text")
    lines = running(lines, key, ["line_no"], {"_before": Running("last", text), "_after": Running("last", text, back=True)})
    row = F.struct("line_no", "text", "start_ms", "end_ms", F.col("_before.text").alias("previous_text"), F.col("_after.text").alias("next_text"))
    # Lines of one number are told apart by the order of their rows.
    alike = F.row_number().over(Window.partitionBy(key, "line_no").orderBy("_line"))
    lines = lines.select(F.col(key), row.alias("_line"), F.col("start_ms").alias("_at"), "line_no").select(key, "_line", "_at", F.struct("line_no", alike.alias("alike")).alias("_no"))
    others = [F.col(c) for c in clock.columns if c != key]
    marks = lines.select(key, "_at", F.lit(0).alias("_kind"), "_no", F.lit(None).cast(clock.select(F.struct(*others).alias("x")).schema[0].dataType).alias("_clock"))
    times = clock.select(key, F.col("time_ms").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_no"].dataType).alias("_no"), F.struct(*others).alias("_clock"))
    wanted = {"_active": Running("max", F.col("_no"), own=True), "_first": Running("min", F.col("_no"), whole=True)}
    found = running(marks.unionByName(times), key, ["_at", "_kind"], wanted, RANGE_MS)
    if first_line:
        found = found.withColumn("_active", F.coalesce("_active", "_first"))
    # A struct is never null, so lines of a null key join like any other.
    place = lambda no: F.struct(F.col(key).alias("key"), F.col(no).alias("no")).alias("_place")
    shown = found.where("_kind = 1").select(key, "_clock", place("_active")).join(lines.select(place("_no"), "_line"), "_place", "left")
    return shown.select(key, "_clock.*", "_line.*")


def line_changes(lines: DataFrame, key: str = "track_id", *, first_line: bool = True) -> DataFrame:
    """Stretches in which the shown line stays the same: ``(track_id, from_ms, until_ms, line_no, text, start_ms, end_ms,
    previous_text, next_text)``, the line of :func:`active_lines` from ``from_ms`` until before ``until_ms``.

    A row a change instead of one a frame.  ``until_ms`` is null for the last stretch of a track; ``from_ms`` is null for the
    first, which reaches back to before any start, but with ``first_line`` false there is none before the first start.  A
    line that starts after a later one is never shown, and lines that start together show the last alone.  A line without
    a start has always started.
    """
    text = F.struct("text")
    lines = running(lines, key, ["line_no"], {"_before": Running("last", text), "_after": Running("last", text, back=True)})
    row = F.struct("line_no", "text", "start_ms", "end_ms", F.col("_before.text").alias("previous_text"), F.col("_after.text").alias("next_text"))
    marks = lines.select(key, F.col("start_ms").alias("_from"), row.alias("_line"))
    if first_line:
        # The least line stands before all starts: the greatest seen is never below it.
        marks = marks.unionByName(marks.groupBy(key).agg(F.lit(None).cast(marks.schema["_from"].dataType).alias("_from"), F.min("_line").alias("_line")))
    starts = marks.groupBy(key, "_from").agg(F.max("_line").alias("_line"))
    seen = running(starts, key, ["_from"], {"_active": Running("max", F.col("_line"), own=True), "_shown": Running("max", F.col("_line"))}, RANGE_MS)
    changes = seen.where(F.col("_shown").isNull() | (F.col("_shown") < F.col("_active"))).select(key, "_from", "_active")
    until = running(changes, key, ["_from"], {"_until": Running("last", F.col("_from"), back=True)}, RANGE_MS)
    return until.select(key, F.col("_from").alias("from_ms"), F.col("_until").alias("until_ms"), "_active.*")


def highlighted(words: Column, line: Column, time_ms: Column) -> Column:
    """Ranges of the words that have begun, each where its text first occurs in the line; null for words not in it."""
    begun = F.filter(words, lambda w: w["start_ms"] <= time_ms)
    return F.transform(begun, lambda w: word_range(line, w["text"]))
