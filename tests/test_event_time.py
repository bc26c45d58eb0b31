"""Streams by event time against the batch operators on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from versetime.operators import asof
from versetime.operators.windows import without_repeats
from versetime.streaming.event_time import active_lines_stream, run_to_end, without_repeats_by_time

SCHEMA = "track_id string, ord long, text string, start_ms long, at timestamp, extra double"


def timed(spark, rows):
    """Rows ``(track, ord, text, start_ms)`` with an event time that differs as ``start_ms`` does."""
    df = spark.createDataFrame(rows, "track_id string, ord long, text string, start_ms long")
    return df.withColumn("at", F.expr("timestamp_millis(1700000000000 + start_ms)")).withColumn("extra", F.col("ord") / 3)


def appended(spark, folder, rows):
    timed(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def listed(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def segments(seed, tracks, n):
    r = random.Random(seed)
    words = ["La, la!", "la la", "oh", "OH", "hey", "...", "", None]
    return [(r.choice(tracks), i, r.choice(words), r.randrange(0, 40_000)) for i in range(n)]


def test_shuffled_batches_give_the_rows_of_the_batch_operator(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "cp"))
    rows = segments(1, ["a", "b", None], 400)
    ordered = sorted(rows, key=lambda r: r[3])
    r = random.Random(2)
    stream = without_repeats_by_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source) if not appended(spark, source, ordered[:1]) else None, delay="20 seconds", order=["ord"])
    # Rows up to 20 seconds of time late: each slice of time is mixed with the next.
    slices = [ordered[1:150], ordered[150:280], ordered[280:]]
    mixed = [slices[0][::2], slices[0][1::2] + slices[1], slices[2]]
    for part in mixed:
        r.shuffle(part)
        appended(spark, source, part)
        run_to_end(stream, out, state)  # each run goes on from the checkpoint of the one before
    held = spark.read.parquet(out).count()
    appended(spark, source, [("end", 0, "...", 10_000_000)])
    got = run_to_end(stream, out, state)
    want = without_repeats(timed(spark, rows), order=["ord"])
    assert listed(got, *want.columns) == listed(want, *want.columns)
    assert 0 < held < got.count()


def test_late_rows_and_rows_without_time(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "cp"))
    appended(spark, source, [("a", 0, "one", 0), ("a", 1, "two", 60_000), ("a", 2, "no time", None), ("a", 3, "?!", None)])
    stream = without_repeats_by_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), delay="1 second")
    run_to_end(stream, out, state)
    appended(spark, source, [("a", 4, "late", 1_000), ("b", 5, "late too", 2_000), ("a", 6, "Two!", 61_500), ("a", 7, "two", 63_001), ("a", 8, "three", 63_000)])
    run_to_end(stream, out, state)
    appended(spark, source, [("end", 9, "...", 10_000_000)])
    got = run_to_end(stream, out, state)
    assert listed(got, "ord") == [(0,), (1,), (2,), (7,), (8,)]


def test_tracks_share_the_state_of_a_group(spark, tmp_path):
    """A batch costs a state for a group of tracks, not one for each; tracks and equal times are still told apart."""
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "cp"))
    rows = [(t, n, text, at // 4 * 4) for t, n, text, at in segments(7, [f"t{i}" for i in range(150)] + [None], 3_000)]
    appended(spark, source, [r for r in rows if r[3] < 20_000])
    stream = without_repeats_by_time(spark.readStream.schema(SCHEMA).parquet(source), delay="1 second", order=["ord"], groups=5)
    run_to_end(stream, out, state)
    assert spark.read.format("statestore").load(state).count() == 5
    appended(spark, source, [r for r in rows if r[3] >= 20_000])
    run_to_end(stream, out, state)
    appended(spark, source, [("end", 0, "...", 10_000_000)])
    got = run_to_end(stream, out, state)
    want = without_repeats(timed(spark, rows), order=["ord"])
    assert len({(r[0], r[3]) for r in rows}) < len(rows)
    assert listed(got, *want.columns) == listed(want, *want.columns)
    # Groups of tracks that have ended leave no state.
    assert spark.read.format("statestore").load(state).count() == 1


def lines(spark, seed):
    r = random.Random(seed)
    rows = [(t, n, f"line {n}", r.choice([None, *range(0, 30_000, 500)]) if t == "n" else r.randrange(0, 30) * 1000, 40_000) for t in ("a", "b", "n", None) for n in range(12)]
    return spark.createDataFrame(rows, "track_id string, line_no int, text string, start_ms long, end_ms long")


@pytest.mark.parametrize("first", [True, False])
def test_changes_expand_to_the_frame_table(spark, first):
    own = lines(spark, 5)
    clock = spark.range(0, 40_000, 250).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("n"), F.lit(None))).alias("track_id"), F.col("id").alias("time_ms"))
    changes = asof.line_changes(own, first_line=first)
    frames = asof.active_lines(clock, own, first_line=first)
    inside = (F.col("c.track_id").eqNullSafe(F.col("k.track_id"))) & (F.col("time_ms") >= F.coalesce("from_ms", F.lit(-1))) & (F.col("time_ms") < F.coalesce("until_ms", F.lit(1 << 60)))
    expanded = clock.alias("k").join(changes.alias("c"), inside, "left").select("k.track_id", "time_ms", "line_no", "text", "previous_text", "next_text")
    assert listed(expanded, *expanded.columns) == listed(frames, *expanded.columns)
    # Coalesced: no two stretches of a track next to each other show one line.
    assert changes.groupBy("track_id", "line_no").count().where("count > 1").count() == 0
    assert asof.line_changes(own.limit(0)).count() == 0


@pytest.mark.parametrize("first", [True, False])
def test_streaming_clock_gives_the_rows_of_the_batch_lookup(spark, tmp_path, first):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "cp"))
    own = lines(spark, 6).where("track_id is not null")
    ticks = spark.range(0, 32_000, 400).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("n"))).alias("track_id"), F.col("id").alias("time_ms"), (F.col("id") / 7).alias("text0"))
    for part in (ticks.where("time_ms < 9000"), ticks.where("time_ms >= 20000"), ticks.where("time_ms >= 9000 and time_ms < 20000")):
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(source)
    stream = active_lines_stream(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(source), own, first_line=first)
    run_to_end(stream, out, state)
    spark.createDataFrame([("a", None, 0.5), ("no lines", 3, 0.5)], "track_id string, time_ms long, text0 double").coalesce(1).write.mode("append").parquet(source)
    got = run_to_end(stream, out, state)
    want = asof.active_lines(ticks, own, first_line=first)
    odd = "text0 = 0.5"
    assert listed(got.where(f"not ({odd})"), *want.columns) == listed(want, *want.columns)
    assert listed(got.where(odd), "track_id", "line_no") == [("a", None), ("no lines", None)]


def test_clock_reads_the_state_of_a_group_without_texts(spark, tmp_path):
    """Tracks share a state, which has times alone; a group has more rows of lines and clock than an Arrow batch."""
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "cp"))
    r = random.Random(8)
    own = [(f"t{t}" if t else None, n, f"line {t} {n}", r.randrange(0, 30) * 1000, 40_000) for t in range(30) for n in range(8)]
    own = spark.createDataFrame(own, "track_id string, line_no int, text string, start_ms long, end_ms long").coalesce(1)
    ticks = [(f"t{t}" if t else None, r.choice([None, *range(-500, 32_000, 700)])) for t in range(35) for _ in range(12)]
    ticks = spark.createDataFrame(ticks, "track_id string, time_ms long").coalesce(1)
    ticks.where("pmod(time_ms, 1400) < 700").write.mode("append").parquet(source)
    stream = active_lines_stream(spark.readStream.schema(ticks.schema).parquet(source), own, groups=3)
    with_slices = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        run_to_end(stream, out, state)
        ticks.where("time_ms is null or pmod(time_ms, 1400) >= 700").write.mode("append").parquet(source)
        got = run_to_end(stream, out, state)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_slices)
    want = asof.active_lines(ticks.where("time_ms is not null"), own)
    assert listed(got.where("time_ms is not null"), *want.columns) == listed(want, *want.columns)
    assert got.where("time_ms is null and line_no is null").count() == ticks.where("time_ms is null").count() > 0
    held = spark.read.format("statestore").option("stateVarName", "changes").load(state)
    assert held.select("key").distinct().count() == 3
    assert not [c for c in held.toPandas().astype(str).to_numpy().ravel() if "line " in c]
