import random

import numpy as np
import pytest

from versetime.operators.align import align_words
from versetime.operators.anchors import chained, cuts, long_matches


def noisy(words, rng):
    """A copy with words left out, put in and replaced."""
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < 0.04 else [w, f"extra{rng.randrange(9)}"] if x < 0.08 else [f"wrong{rng.randrange(9)}"] if x < 0.12 else [w]
    return out


def frames(spark, tracks):
    schema = "track_id string, pos long, norm string"
    left = spark.createDataFrame([(k, i, w) for k, (a, _) in tracks.items() for i, w in enumerate(a)], schema).repartition(5)
    right = spark.createDataFrame([(k, i, w) for k, (_, b) in tracks.items() for i, w in enumerate(b)], schema).repartition(3)
    return left, right, spark.createDataFrame([(k, len(a), len(b)) for k, (a, b) in tracks.items()], "track_id string, r long, t long")


@pytest.mark.parametrize("seed", range(20))
def test_chain_is_the_longest_that_grows(seed):
    rng = np.random.default_rng(seed)
    t = rng.permutation(40)
    got = chained(np.arange(40), t)
    assert (np.diff(got) > 0).all() and (np.diff(t[got]) > 0).all()
    best = np.ones(40, int)
    for i in range(40):
        best[i] += max([best[j] for j in range(i) if t[j] < t[i]], default=0)
    assert len(got) == best.max()


def test_cuts_leave_both_sides_of_a_piece_long_enough():
    r, t = np.array([5, 400, 401, 900, 950]), np.array([7, 390, 800, 810, 1300])
    assert cuts(r, t, 400) == [(0, 0), (401, 800), (950, 1300)]
    assert cuts(r[:0], t[:0]) == [(0, 0)]


def test_matches_are_those_of_the_whole_table(spark):
    rng = random.Random(3)
    tracks = {}
    for k in range(6):
        words = [f"w{rng.randrange(40 * (k + 1))}" if rng.random() < 0.9 else "" for _ in range(700)]
        tracks[f"t{k}"] = (words, noisy(words, rng))
    matches, status = long_matches(*frames(spark, tracks), most_reference=400, most_transcript=400, least=60)
    got = {}
    for m in matches.collect():
        got.setdefault(m.track_id, {})[m.pos] = m.hit
    by_status = {r.track_id: r.status for r in status.collect()}
    assert by_status.keys() == tracks.keys() and sum(s == "ok" for s in by_status.values()) >= 4
    for k, (a, b) in tracks.items():
        want = {i: j for i, j in enumerate(align_words(a, b)) if j >= 0}
        assert got.get(k, {}) == (want if by_status[k] == "ok" else {})


def test_without_anchors_there_is_a_status(spark):
    tracks = {"same": (["la"] * 900, ["la"] * 900), "short": (["la"] * 90, ["la"] * 80), "one side": (["la"] * 90, ["so"] * 900)}
    matches, status = long_matches(*frames(spark, tracks), most_reference=400, most_transcript=400)
    assert {r.track_id: r.status for r in status.collect()} == {"same": "text too long", "short": "ok", "one side": "transcript too long"}
    assert {(m.track_id, m.hit - m.pos) for m in matches.collect()} == {("short", -10)}


def test_a_hundred_thousand_words(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    heard = noisy(words, rng)
    matches, status = long_matches(*frames(spark, {"t": (words, heard)}))
    assert status.first().status == "ok"
    got = sorted((m.pos, m.hit) for m in matches.collect())
    assert len(got) > 90_000 and all(b[0] > a[0] and b[1] > a[1] for a, b in zip(got, got[1:], strict=False))
    assert sum(words[i] == heard[j] for i, j in got) > 0.99 * len(got)
