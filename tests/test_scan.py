import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versetime.operators.align import filled_gaps
from versetime.operators.asof import active_lines, frame_clock
from versetime.operators.scan import Running, running
from versetime.operators.words import line_numbers


def plain(rows, kind, own, back, whole):
    """Each row's value by a loop over its track."""
    out = {}
    for key in {r[0] for r in rows}:
        track = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=back)
        for i, r in enumerate(track):
            seen = [x[3] for x in (track if whole else track[: i + own]) if x[3] is not None]
            out[r[2]] = {"last": lambda s: s[-1], "max": max, "min": min, "sum": sum}[kind](seen) if seen else None
    return out


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_values_are_those_of_a_loop(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-30, 60)]), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "track_id string, at int, no int, v int").repartition(5)
    kinds = [(k, o, b, w) for k in ("last", "max", "min", "sum") for o, b, w in ((False, False, False), (True, False, False), (False, True, False), (False, False, True)) if not (w and k == "last")]
    wanted = {f"x{i}": Running(k, F.col("v"), *rest) for i, (k, *rest) in enumerate(kinds)}
    got = running(df, "track_id", ["at", "no"], wanted, width).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["track_id", "at", "no", "v", *wanted]
    for i, kind in enumerate(kinds):
        assert {r.no: r[f"x{i}"] for r in got} == plain(rows, *kind), kind


def test_no_rows_and_doubles(spark):
    df = spark.createDataFrame([("a", 2.5, 1), ("a", -0.5, 2), ("a", 99.0, 4)], "k string, at double, v int")
    got = running(df, "k", ["at"], {"s": Running("sum", F.col("v"), own=True)}, 10)
    assert sorted((r.at, r.s) for r in got.collect()) == [(-0.5, 2), (2.5, 3), (99.0, 7)]
    assert running(df.limit(0), "k", ["at"], {"s": Running("sum", F.col("v"))}).count() == 0


@pytest.fixture
def whole_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def largest_share(df):
    """Of the rows, the part that a task has which gets whole rows, so that nothing is pruned."""

    def count(batches):
        yield pa.record_batch({"n": pa.array([sum(len(b) for b in batches)], pa.int64())})

    counts = [r.n for r in df.mapInArrow(count, "n long").collect()]
    return max(counts) / sum(counts)


def test_one_huge_track_is_spread_over_tasks(spark, whole_partitions):
    n = 400_000
    words = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("pos"), F.lit(n).alias("n_words"), F.lit(10 * n).alias("duration_ms"))
    hit = F.col("pos") % 50_000 == 0
    words = words.withColumns({"match_start": F.when(hit, F.col("pos") * 10), "match_end": F.when(hit, F.col("pos") * 10 + 10)})
    filled = filled_gaps(words)
    assert largest_share(filled) < 0.3
    apart = "pos - pos % 50000"  # the match before; from its end the words up to the next one share the time
    assert filled.where(f"pos < 350000 and pos % 50000 > 0 and start_ms <> ({apart}) * 10 + 10 + 499990 * (pos % 50000 - 1) div 50000").count() == 0
    assert filled.where("pos % 50000 = 0 and start_ms <> pos * 10 or end_ms < start_ms + 60 or start_ms is null").count() == 0
    spoken = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("ord"), F.lit("w").alias("text"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 9).alias("end_ms"))
    numbered = line_numbers(spoken)
    assert largest_share(numbered) < 0.3 and numbered.where("line_no <> ord div 8").count() == 0
    clock = frame_clock(spark.createDataFrame([("t", 10_000_000)], "track_id string, duration_ms long"), 30)
    lines = spark.range(10_000).select(F.lit("t").alias("track_id"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"))
    shown = active_lines(clock, lines)
    assert largest_share(shown) < 0.3
    assert shown.where("line_no <> time_ms div 1000 or previous_text <> cast(line_no - 1 as string) or next_text <> cast(line_no + 1 as string)").count() == 0
