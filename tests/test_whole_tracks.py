"""Tracks aligned whole, in one pass and without a table where both sides agree."""

import random

import numpy as np
import pytest

from tests.test_timed_text import literal_align
from versetime import queries as Q
from versetime.operators import align
from versetime.plans import alignment

POOL = ["", "a", "la", "hello", "hallo", "hellos", "stone", "stones", "tone", "store", "word", "sword", "words", "abcdefghijkl", "abcdefghijkm", "abcdefghijklm"]


def noisy(words, rng):
    """A copy with words left out, put in, replaced, misheard and shortened."""
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < 0.06 else [w, rng.choice(POOL)] if x < 0.12 else [rng.choice(POOL)] if x < 0.18 else [f"zq{rng.randrange(99)}"] if x < 0.24 else [w[:-1]] if x < 0.28 else [w]
    return out


@pytest.mark.parametrize("most", [None, 10**9])
def test_states_near_the_script_give_the_matches_of_the_table(monkeypatch, most):
    rng, inner, sparse = random.Random(8), align._reached, 0
    if most:
        monkeypatch.setattr(align, "_reached", lambda a, b, _: inner(a, b, most))
    for k in range(300):
        a = [rng.choice(POOL) for _ in range(rng.randrange(40))]
        b = noisy(a, rng) if k % 2 else [rng.choice(POOL) for _ in range(rng.randrange(40))]
        found, want = align._sparse_words(a, b), literal_align(a, b)
        assert found in ([want] if most else [want, None]) and align.table_words(a, b) == want
        sparse += found is not None
    assert sparse > 150


def test_a_long_text_heard_well_needs_no_table(monkeypatch):
    monkeypatch.setattr(align, "table_words", lambda *_: pytest.fail("a table of 400 million pairs"))
    text = [f"word{i % 977}" for i in range(20_000)]
    heard = [f"zq{i:012d}" if i % 17 == 5 else w for i, w in enumerate(text)]
    assert align.align_words(text, heard) == [-1 if i % 17 == 5 else i for i in range(20_000)]


def test_gap_times_are_those_of_filled_gaps(spark):
    rng, data, want = random.Random(4), [], []
    for track in range(60):
        n, duration = rng.randrange(1, 12), rng.randrange(0, 5000)
        begin = [rng.choice([None, rng.randrange(-900, 4000)]) for _ in range(8)]
        end = [rng.choice([None, rng.randrange(-900, 4000)]) for _ in range(8)]
        hits = [rng.choice([-1, -1, rng.randrange(8)]) for _ in range(n)]
        given = ([x or 0 for x in begin], [x or 0 for x in end], [x is not None for x in begin], [x is not None for x in end])
        start, stop, matched, untimed = (x.tolist() for x in align.gap_times(hits, *map(np.array, given), duration))
        for i, h in enumerate(hits):
            there = h >= 0 and begin[h] is not None
            data.append((track, i, n, duration, begin[h] if there else None, end[h] if there else None))
            want.append((track, i, None if untimed[i] else start[i], None if untimed[i] else stop[i], matched[i]))
    rows = spark.createDataFrame(data, "track_id int, pos int, n_words long, duration_ms long, match_start long, match_end long")
    assert sorted(map(tuple, align.filled_gaps(rows).select("track_id", "pos", "start_ms", "end_ms", "matched").collect()), key=repr) == sorted(want, key=repr)


def test_whole_words_are_the_plain_ones(spark):
    texts = [("a", "Hello\u00a0there,\tΟΔΟΣ\x0b-\n\n[x]\n  İt's  a  test \x85\r\nstones", 900, 5000), ("b", "- ", None, None), ("c", " \n[Chorus]", 5, 5), ("d", None, 5, 5), ("e", "no one hears", 5, 5), (None, "one two", 5, 5)]
    tracks = spark.createDataFrame(texts, "track_id string, text string, audio_ms long, transcript_ms long")
    said = [("a", 2, "οδος", 300, 400), ("a", 1, "hello\nthere", 0, 90), ("a", 4, "stone", 700, 800), ("a", 3, "", 500, 600), ("b", 0, "?", 10, 20), ("c", 0, "x", 0, 9), ("d", 0, "x", 0, 9), ("f", 0, "x", 0, 9)]
    words = spark.createDataFrame(said, "track_id string, ord long, text string, start_ms long, end_ms long")
    found, want = alignment.whole_words(tracks, words), alignment.plain_words(tracks, words)
    assert found.dtypes == want.dtypes and found.count() == 12
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_slices_of_words(spark, monkeypatch):
    """A batch of tracks is given on in slices."""
    rows = spark.createDataFrame([(k, None, None, "one two\nthree", "one two three", "one\nthree", [0, 5], [3, 9]) for k in range(9)], "track_id long, audio_ms long, transcript_ms long, lines string, norm string, heard string, starts array<long>, ends array<long>")
    batches = rows.coalesce(1).toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(alignment, "_SLICE", 6)
    out = list(alignment._aligned(iter(batches)))
    assert [b.num_rows for b in out] == [6, 6, 6, 6, 3]
    assert [(r["track_id"], r["line_no"], r["word_no"], r["text"], r["matched"]) for r in out[1].to_pylist()][3:] == [(3, 0, 0, "one", True), (3, 0, 1, "two", False), (3, 1, 0, "three", True)]


def test_documents_are_shuffled_as_texts_and_read_once_a_side(spark):
    plan = Q.document_align(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan parquet") == 2 and plan.count("InArrow") == 1
