"""What a running job tells, and how it is stopped: counters taken in the pass that does the work, and cancellation by tag."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from versetime.operators.audio import RATE


def observed_windows(windows: DataFrame, name: str = "windows") -> tuple[DataFrame, Observation]:
    """``windows`` as they are, and an observation of all that pass: ``completed, skipped, samples``.

    The counters of :func:`versetime.operators.windows.window_counts` over all tracks, without a scan of their own: they are
    there when the first action on the returned table ends (see :func:`observed_counts`), for a stream after each batch.
    A window whose ``silent`` is null is not skipped.
    """
    seen = Observation(name)
    counted = windows.observe(seen, F.count(F.lit(1)).alias("completed"), F.count_if("silent").alias("skipped"), F.coalesce(F.sum("unique_samples"), F.lit(0)).cast("long").alias("samples"))
    return counted, seen


def observed_counts(seen: Observation) -> dict[str, int]:
    """``completed``, ``skipped`` and ``processed_ms`` of an observation, once an action has ended; waits for it."""
    own = seen.get
    return {"completed": own["completed"], "skipped": own["skipped"], "processed_ms": own["samples"] * 1000 // RATE}


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts within the block bear ``tag``, so that :func:`cancel` stops them and no others."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs that run under ``tag``, from any thread; the action there raises.  What was written before stays."""
    spark.sparkContext.cancelJobsWithTag(tag)
