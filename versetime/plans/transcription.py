"""From sampled audio and a recogniser's raw output to transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetime.operators.audio import RATE, SILENCE, near_silence, window_samples
from versetime.operators.windows import WindowPlan, segment_rows, window_rows, without_repeats, worker_of
from versetime.operators.words import segment_words, transcripts


def judged_windows(pcm: DataFrame, plan: WindowPlan = WindowPlan(), silence: float = SILENCE) -> DataFrame:  # noqa: B008
    """Windows of tracks ``(track_id, samples)`` with their samples and whether they are ``silent``.

    :func:`versetime.operators.windows.window_counts` counts them.
    """
    rows = window_rows(pcm.withColumn("sample_count", F.size("samples")), plan)
    own = rows.withColumn("samples", window_samples(F.col("samples"), F.col("start_sample"), F.col("n_samples")))
    return own.withColumn("silent", near_silence(F.col("samples"), silence))


def audible_windows(pcm: DataFrame, plan: WindowPlan = WindowPlan(), silence: float = SILENCE) -> DataFrame:  # noqa: B008
    """The windows of :func:`judged_windows` that aren't silent."""
    return judged_windows(pcm, plan, silence).where("not silent").drop("silent")


def decoded_lengths(pcm: DataFrame) -> DataFrame:
    """``(track_id, decoded_ms)`` of tracks ``(track_id, samples)``."""
    return pcm.select("track_id", F.expr(f"cast(size(samples) as bigint) * 1000 div {RATE}").alias("decoded_ms"))


def transcribe(windows: DataFrame, raw_asr: DataFrame, plan: WindowPlan = WindowPlan(), decoded: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """Segments, words and transcripts from windows and ``raw_asr(track_id, chunk_idx, raw_text)``.

    Equal starts are ordered as workers deliver them: by worker, window and line.  A transcript's ``duration_ms`` is
    its last end or, where ``decoded(track_id, decoded_ms)`` is longer, that.
    """
    own = windows.select("track_id", "idx", "start_ms", "end_ms").join(raw_asr.withColumnRenamed("chunk_idx", "idx"), ["track_id", "idx"])
    count = windows.groupBy("track_id").agg(F.count("*").alias("_windows"))
    found = segment_rows(own, plan).join(count, "track_id").withColumn("worker", worker_of(F.col("idx"), F.col("_windows"), plan)).drop("_windows")
    segments = without_repeats(found, order=["worker", "idx", "line_no"])
    ordered = segments.withColumn("ord", F.struct("start_ms", "worker", "idx", "line_no")).drop("worker", "idx", "line_no")
    texts = transcripts(ordered)
    texts = texts.withColumn("decoded_ms", F.lit(None).cast("long")) if decoded is None else texts.join(decoded, "track_id", "left")
    return segments, segment_words(ordered), texts.withColumn("duration_ms", F.greatest("end_ms", "decoded_ms")).drop("decoded_ms")
