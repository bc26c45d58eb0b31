"""Goldens for texts, words, windows, alignment, as-of lookups and audio."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versetime.functions import text as T
from versetime.operators import align, asof, audio, lrc, windows, words
from versetime.plans import alignment, transcription


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df, *names, order=()):
    return [tuple(r) for r in df.orderBy(*(order or names)).select(*names).collect()]


def test_lrc_stamps_offset_and_ties(spark):
    text = "[offset:+100]\n[00:01.50][00:03.000]Hello\n[00:05:25]World\n[00:01.50]Hello\n[00:01.5]Again\nno stamp\n[00:09] \n"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "[OFFSET:-99999]\n[1:99]x")], "track_id string, text string")
    got = rows(lrc.line_rows(df.select("track_id", lrc.lrc_lines(F.col("text")).alias("lines"))), "track_id", "line_no", "start_ms", "text")
    assert got == [("a", 0, 1600, "Hello"), ("a", 1, 1600, "Again"), ("a", 2, 3100, "Hello"), ("a", 3, 5350, "World"), ("d", 0, 59001, "x")]


def test_offset_that_is_no_number(spark):
    assert one(spark, lrc.offset_ms(F.lit("[offset:99999999999999999999]")))[0] == 0


def test_timed_alignment(spark):
    df = spark.createDataFrame([("t", "[00:01.00]First line\n[00:03.50]Second line", 6000)], "track_id string, text string, audio_ms long")
    got = rows(alignment.timed_words(df), "line_no", "word_no", "text", "start_ms", "end_ms")
    assert got == [(0, 0, "First", 1000, 2250), (0, 1, "line", 2250, 3500), (1, 0, "Second", 3500, 4750), (1, 1, "line", 4750, 6000)]


def test_scalars(spark):
    got = one(
        spark, T.format_duration(F.lit(-1)), T.format_duration(F.lit(61_000)), T.format_duration(F.lit(3_661_000)), T.format_bytes(F.lit(1536)), T.format_bytes(F.lit(5)),
        T.encoder_dimensions(F.lit(4000), F.lit(3000)), T.encoder_dimensions(F.lit(101), F.lit(51)), T.encoder_dimensions(F.lit(1), F.lit(1)), T.utf16_length(F.lit("😀a")),
        T.clock_ms(F.lit("00:00:01.001")), T.clock_ms(F.lit("01:00:01.001")), T.trimmed(F.lit("\0  a\u001c")), T.clean_spacing(F.lit(" a , b !")), T.normalized(F.lit("Don’T Stop'É9-𝒳")),
        T.language_of_model(F.lit("ggml.EN-q5.bin")), T.is_lyric_key(F.lit(" Un-synced_Lyrics ")), T.is_lyric_key(F.lit("mood")), T.display_name(F.lit("ID3"), F.lit("USLT"), F.lit(True)),
    )
    assert list(got) == ["Unknown", "1:01", "1:01:01", "1.5 KB", "5 B", (1920, 1440), (100, 50), (2, 2), 3, 1000, 3_601_001, "a", "a, b!", "dontstop'é9", "en", True, False, "ID3 • USLT • timed"]


@pytest.mark.parametrize(("a", "b", "near"), [("hello", "hallo", True), ("cat", "cats", False), ("brother", "brothers", True), ("", "", False), ("abcd", "abce", True), ("abc", "abd", False), ("a" * 13, "a" * 12 + "b", False), ("same", "same", True)])
def test_near_match(spark, a, b, near):
    assert one(spark, T.near_match(F.lit(a), F.lit(b)))[0] is near


def literal_near(a, b):
    if not a or not b:
        return False
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b)) >= 4
    if max(len(a), len(b)) > 12 or min(len(a), len(b)) < 4:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1] <= 1


def literal_align(ref, words):
    sub = lambda a, b: 0 if a == b else 1 if literal_near(a, b) else 2
    n, m = len(ref), len(words)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + sub(ref[i - 1], words[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [-1] * n, n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (s := sub(ref[i - 1], words[j - 1])):
            i, j = i - 1, j - 1
            if s <= 1:
                out[i] = j
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def test_alignment_is_the_literal_one():
    rng = random.Random(5)
    pool = ["", "a", "la", "hello", "hallo", "hellos", "brother", "brothers", "brothel", "cat", "cats", "world", "word", "abcdefghijkl", "abcdefghijkm", "abcdefghijklm"]
    for _ in range(300):
        ref, heard = ([rng.choice(pool) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        assert align.align_words(ref, heard) == literal_align(ref, heard)
    assert align.align_words([], ["a"]) == [] and align.align_words(["a"], []) == [-1]


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(6)
    pool = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(60)})
    left, right = pool[::2], pool[1::2] + pool[:10]
    got = align.near_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in left for b in right if literal_near(a, b)}


PLAIN = [
    ("Hello from\nthe other side", "hello 100 500 from 600 900 the 950 1100 other 1200 1700 side 1800 2300", 3000, [(100, 500), (600, 900), (950, 1100), (1200, 1700), (1800, 2300)]),
    ("Hello big blue world", "hello 100 500 world 1000 1400", 3000, [(100, 500), (500, 666), (666, 833), (1000, 1400)]),
    ("oh yeah hello", "hello 900 1300", 3000, [(0, 450), (450, 900), (900, 1300)]),
    ("hello oh yeah", "hello 100 500", 3000, [(100, 500), (500, 1750), (1750, 3000)]),
    ("foo bar", "zzz 100 500", 3000, [(0, 1500), (1500, 3000)]),
    ("Hallo brother cats", "hello 0 400 brothers 500 900 cat 1000 1010", 2000, [(0, 400), (500, 900), (900, 2000)]),
    ("- hello", "... 0 50 hello 100 500", 2000, [(0, 60), (100, 500)]),
    ("[Chorus]\n\nhello", "hello 100 500", 2000, [(100, 500)]),
]


def heard(spark, texts):
    out = [(str(k), i // 3, w[i], int(w[i + 1]), int(w[i + 2])) for k, t in enumerate(texts) for w in (t.split(),) for i in range(0, len(w), 3)]
    return spark.createDataFrame(out, "track_id string, ord long, text string, start_ms long, end_ms long")


def test_plain_alignment(spark):
    tracks = spark.createDataFrame([(str(k), p[0], p[2], None) for k, p in enumerate(PLAIN)], "track_id string, text string, audio_ms long, transcript_ms long")
    got = alignment.plain_words(tracks, heard(spark, [p[1] for p in PLAIN]))
    found = {}
    for track, *times in rows(got, "track_id", "line_no", "word_no", "start_ms", "end_ms"):
        found.setdefault(track, []).append(tuple(times[2:]))
    assert found == {str(k): p[3] for k, p in enumerate(PLAIN)}
    summary = align.alignment_summary(align.aligned_lines(got))
    first = summary.where("track_id = '0'").first()
    assert (first.n_lines, first.n_words, first.n_matched, first.confidence, first.duration_ms) == (2, 5, 5, 1.0, 2300)


def test_align_takes_each_kind_of_track_its_way(spark):
    tracks = spark.createDataFrame([("0", "hello", 900, None), ("1", "[00:01]hi", 900, None), ("2", " ", 900, None), ("3", "la la", 900, None), ("4", "la", 0, None), ("5", "x " * 2501, 0, None)], "track_id string, text string, audio_ms long, transcript_ms long")
    spoken = heard(spark, ["hello 100 500", "", "one 0 100 two. 200 300 three 400 500", "", "", "x 0 100"])
    segments = spark.createDataFrame([("3", 0, "la la", 0, 1000)], "track_id string, ord long, text string, start_ms long, end_ms long")
    found, lines = alignment.align(tracks, spoken, segments)
    assert rows(found, "track_id", "line_no", "word_no", "text", "start_ms", "status") == [
        ("0", 0, 0, "hello", 100, "ok"), ("1", 0, 0, "hi", 1000, "ok"), ("2", 0, 0, "one", 0, "ok"), ("2", 0, 1, "two.", 200, "ok"), ("2", 1, 0, "three", 400, "ok"),
        ("3", 0, 0, "la", 0, "ok"), ("3", 0, 1, "la", 500, "ok"), ("4", None, None, None, None, "no words in the transcript"), ("5", None, None, None, None, "text too long"),
    ]
    assert lines.count() == 5
    labelled = alignment.results(tracks.withColumn("source", F.lit("ID3")), lines)
    assert rows(labelled, "track_id", "source", "n_words", "n_matched", "confidence", "duration_ms") == [
        ("0", "ID3", 1, 1, 1.0, 500), ("1", "ID3", 1, 1, 1.0, 3000), ("2", "Transcription", 3, 3, 1.0, 500 + 100), ("3", "ID3", 2, 2, 1.0, 1000),
    ]


def test_lines_of_a_transcript_are_the_literal_ones(spark):
    rng = random.Random(7)
    data, expected = [], []
    for track in range(40):
        at, line, size = 0, 0, 0
        for i in range(rng.randrange(1, 40)):
            text = rng.choice(["a", "b", "c.", "d?", "e:"]) if rng.random() < 0.3 else "w"
            start, end = at, at + rng.randrange(10, 300)
            at = end + rng.choice([0, 100, 850, 851, 2000])
            data.append((track, i, text, start, end))
            expected.append((track, i, line))
            size += 1
            if size >= 8 or text[-1] in ".!?;:" or at - end > 850:
                line, size = line + 1, 0
    df = spark.createDataFrame(data, "track_id long, ord long, text string, start_ms long, end_ms long")
    assert rows(words.line_numbers(df), "track_id", "ord", "line_no") == expected


def test_window_plan(spark):
    cases = {60.0: [(0, 28, 27), (27, 28, 27), (54, 6, 6)], 5.0: [(0, 5, 5)], 54.5: [(0, 28, 27), (27, 27.5, 27)], 0.0: []}
    df = spark.createDataFrame([(str(k), int(k * 16000)) for k in cases], "track_id string, sample_count long")
    got = {}
    for track, _, *x in rows(windows.window_rows(df), "track_id", "idx", "start_sample", "n_samples", "unique_samples"):
        got.setdefault(track, []).append(tuple(v / 16000 for v in x))
    assert got == {str(k): v for k, v in cases.items() if v}
    for bad in ({"chunk_ms": 9_999}, {"chunk_ms": 30_001}, {"overlap_ms": 28_000}, {"overlap_ms": -1}):
        with pytest.raises(ValueError):
            windows.WindowPlan(**bad)


def test_repeats_look_back_at_the_last_three_accepted(spark):
    lines = [(0, "la la"), (1000, "b"), (1500, "c"), (1800, "d"), (2500, "La, la!"), (2600, "D"), (2700, "...")]
    df = spark.createDataFrame([("t", s, s + 100, x) for s, x in lines], "track_id string, start_ms long, end_ms long, text string")
    assert [r[0] for r in rows(windows.without_repeats(df), "start_ms")] == [0, 1000, 1500, 1800, 2500]


def test_repeats_by_stretches_are_those_of_whole_tracks(spark):
    rng = random.Random(9)
    data, want = [], []
    for track in [None, *range(12)]:
        at, own = 0, []
        for i in range(rng.randrange(1, 60)):
            at += rng.choice([0, 10, 500, 2999, 3000, 9000])
            own.append((track, i, rng.choice(["a", "b", "B!", "c", "..."]), at))
        norm = ["".join(c for c in x.lower() if c.isalnum()) for _, _, x, _ in own]
        keep = windows.accepted_segments(zip((r[3] for r in own), norm, strict=True))
        want += [r for r, k in zip(own, keep, strict=True) if k]
        data += own
    rng.shuffle(data)
    df = spark.createDataFrame(data, "track_id int, ord int, text string, start_ms long")
    assert sorted(map(str, map(tuple, windows.without_repeats(df, order=["ord"]).collect()))) == sorted(map(str, want))
    assert windows.without_repeats(df.limit(0)).count() == 0


def test_transcription(spark):
    pcm = spark.range(1).select(F.lit("t").alias("track_id"), F.array_repeat(F.lit(0.1).cast("float"), 16_000 * 40).alias("samples"))
    own = transcription.audible_windows(pcm)
    raw = [("t", 0, "[00:00:00.000 --> 00:00:02.000]:  Hello there\nnoise\n[00:00:27.500 --> 00:00:29.000]: late"), ("t", 1, "[00:00:00.100 --> 00:00:00.200]: overlap\n[00:00:01.001 --> 00:00:01.002]: next one")]
    segments, spoken, texts = transcription.transcribe(own, spark.createDataFrame(raw, "track_id string, chunk_idx int, raw_text string"))
    assert rows(segments, "start_ms", "end_ms", "text") == [(0, 2000, "Hello there"), (27500, 28000, "late"), (28000, 28080, "next one")]
    assert rows(spoken.where("word_no = 1"), "text", "start_ms", "end_ms") == [("one", 28070, 28140), ("there", 1000, 2000)]
    assert texts.first().text == "Hello there late next one" and texts.first().duration_ms == 28080
    decoded = transcription.decoded_lengths(pcm)
    assert transcription.transcribe(own, spark.createDataFrame(raw, "track_id string, chunk_idx int, raw_text string"), decoded=decoded)[2].first().duration_ms == 40_000
    quiet = spark.range(1).select(F.lit("q").alias("track_id"), F.array_repeat(F.lit(0.001).cast("float"), 20_000).alias("samples"))
    assert transcription.audible_windows(quiet).count() == 0
    counts = windows.window_counts(transcription.judged_windows(pcm.unionByName(quiet)))
    assert rows(counts, "track_id", "completed", "skipped", "processed_ms") == [("q", 1, 1, 1250), ("t", 2, 0, 40_000)]


def test_active_line_before_the_first_and_out_of_order(spark):
    lines = spark.createDataFrame([("t", 0, "a", 1000, 2000), ("t", 1, "b", 3000, 4000), ("t", 2, "c", 2500, 5000)], "track_id string, line_no int, text string, start_ms long, end_ms long")
    clock = spark.createDataFrame([("t", x) for x in (0, 999, 1000, 2499, 2500, 3000, 9000)] + [("u", 5)], "track_id string, time_ms long")
    got = rows(asof.active_lines(clock, lines), "track_id", "time_ms", "line_no", "previous_text", "next_text")
    assert [g[2] for g in got] == [0, 0, 0, 0, 2, 2, 2, None] and got[4][3:] == ("b", None)
    assert [g[2] for g in rows(asof.active_lines(clock, lines, first_line=False), "track_id", "time_ms", "line_no")] == [None, None, 0, 0, 2, 2, 2, None]
    frames = asof.frame_clock(spark.createDataFrame([("t", 100)], "track_id string, duration_ms long"), 30)
    assert [r[0] for r in rows(frames, "time_ms")] == [0, 33, 66]


def test_highlight_is_the_first_occurrence(spark):
    spoken = T.spread(F.lit(["la", "La", "zz"]).cast("array<string>"), F.lit(0).cast("long"), F.lit(300).cast("long"), 10)
    assert one(spark, asof.highlighted(spoken, F.lit("la la la"), F.lit(150)))[0] == [(0, 2), (0, 2)]
    assert one(spark, asof.highlighted(spoken, F.lit("la la la"), F.lit(250)))[0] == [(0, 2), (0, 2), None]


def literal_resample(x, rate):
    out, position, ratio = [np.float32(x[0])], rate / 16000, rate / 16000
    for i in range(1, len(x)):
        while position <= i:
            f = np.float32(min(max(position - (i - 1), 0), 1))
            out.append(np.float32(x[i - 1]) + (np.float32(x[i]) - np.float32(x[i - 1])) * f)
            position += ratio
    return np.array(out, np.float32)


@pytest.mark.parametrize("rate", [8000, 11025, 16000, 22050, 44100, 48000])
def test_resampling_is_the_literal_loop(rate):
    x = np.random.default_rng(1).uniform(-1, 1, 3001).astype(np.float32)
    assert (audio.resample(x, rate) == literal_resample(x, rate)).all()


def test_audio_columns(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5, 0.5, 9.0],)], "s array<float>")
    got = df.select(audio.downmixed(F.col("s"), 2).alias("m"), audio.to_pcm16(F.array(F.lit(1.5), F.lit(-1.0), F.lit(0.5), F.lit(-0.5))).alias("p")).first()
    assert got.m == [0.0, 0.5] and got.p == [32767, -32767, 16384, -16383]
    quiet = lambda s, t=0.0035: one(spark, audio.near_silence(F.lit(s).cast("array<float>"), t))[0]
    assert quiet([]) and quiet([0.0] + [1.0] * 15) and not quiet([0.0140] + [0.0] * 400) and not quiet([0.0035] * 17)
    assert one(spark, audio.resampled(F.lit(None).cast("array<float>"), F.lit(8000)))[0] is None


def test_pcm_bytes_are_read_from_any_sample(spark):
    df = spark.createDataFrame([([1, -2, 3, -32768, 32767],), ([],), (None,), ([7, None],)], "s array<smallint>").select("s", audio.pcm16_bytes(F.col("s")).alias("b"))
    got = df.select("b", audio.read_pcm16(F.col("b"), F.lit(1), F.lit(3)).alias("three"), audio.read_pcm16(F.substring("b", 1, 5), F.lit(0), F.lit(9)).alias("odd")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [np.array([1, -2, 3, -32768, 32767], "<i2").tobytes(), b"", None, b"\x07\0\0\0"]
    assert [r.three for r in got] == [[-2 / 32768, 3 / 32768, -1.0], [], None, [0.0]]
    assert [r.odd for r in got] == [[1 / 32768, -2 / 32768], [], None, [7 / 32768, 0.0]]
