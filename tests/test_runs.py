import threading
import time

from pyspark.sql import functions as F

from versetime.operators.windows import window_counts
from versetime.plans.runs import cancel, cancellable, observed_counts, observed_windows
from versetime.plans.transcription import judged_windows, transcribe


def pcm(spark):
    return spark.createDataFrame([("a", [0.0] * 500_000), ("b", [0.5, -0.5] * 250_000), ("c", [])], "track_id string, samples array<float>")


def test_counters_are_taken_in_the_pass_that_does_the_work(spark):
    windows = judged_windows(pcm(spark))
    counted, seen = observed_windows(windows)
    rows = counted.where("not silent").count()
    found = observed_counts(seen)
    total = window_counts(windows).agg(F.sum("completed"), F.sum("skipped")).first()
    assert (found["completed"], found["skipped"]) == tuple(total) and rows == total[0] - total[1] > 0
    samples = windows.agg(F.sum("unique_samples")).first()[0]
    assert found["processed_ms"] == samples * 1000 // 16_000
    none, empty = observed_windows(windows.limit(0))
    none.collect()
    assert observed_counts(empty) == {"completed": 0, "skipped": 0, "processed_ms": 0}


def slow(batches):
    for batch in batches:
        time.sleep(120)
        yield batch


def test_a_running_transcription_is_cancelled_and_later_queries_run(spark):
    windows = judged_windows(pcm(spark)).drop("samples")
    raw = windows.select("track_id", F.col("idx").alias("chunk_idx"), F.lit("[00:00:00.000 --> 00:00:02.000]: la la").alias("raw_text"))
    stuck = raw.mapInArrow(slow, raw.schema)
    ended = []

    def run():
        with cancellable(spark, "transcribe-1"):
            try:
                transcribe(windows, stuck)[1].count()
                ended.append("done")
            except Exception as stopped:  # whatever Spark raises for a cancelled job
                ended.append(str(stopped))

    worker = threading.Thread(target=run)
    began = time.monotonic()
    worker.start()
    tracker = spark.sparkContext.statusTracker()
    while not tracker.getActiveJobsIds() and time.monotonic() - began < 60:
        time.sleep(0.2)
    cancel(spark, "another tag")
    assert worker.is_alive() and not ended
    while worker.is_alive() and time.monotonic() - began < 90:
        cancel(spark, "transcribe-1")
        worker.join(1)
    assert not worker.is_alive() and len(ended) == 1 and "cancel" in ended[0].lower()
    assert transcribe(windows, raw)[1].count() > 0
