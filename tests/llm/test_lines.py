import random

import numpy as np
import pytest

from versetime.llm import lines as L

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least=L.DOCUMENTS, points=1):
    """(kept text, lines, dropped) of each text, with the counts of all of them in one dict."""
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    counts = {}
    for own in split:
        for k in set(map(key, own)):
            counts[k] = counts.get(k, 0) + 1
    out = []
    for t, own in zip(texts, split, strict=True):
        kept = [x for x in own if len(key(x)) < points or counts[key(x)] < least]
        out.append((None if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    common = [f" Rep{i} ÄLine \t" for i in range(60)]
    texts = []
    for i in range(n):
        own = [f"own {i} {j}" for j in range(rng.randrange(4))] + [rng.choice((str.upper, str.lower, str))(c) for c in rng.sample(common, rng.randrange(9))]
        own += ["Very common"] * rng.randrange(3) + ["", " "][: rng.randrange(3)]
        rng.shuffle(own)
        texts.append("\n".join(own))
    return texts + [None, "", "\n\n", "\r\nVERY COMMON\r\n", "x" * 50_000] + ["twice\nrow"] * 12


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_lines int, key string").repartition(5)


def rows(df):
    return sorted((repr(r["doc_id"]), repr(r["text"]), r["n_lines"], r["n_dropped"]) for r in df.collect())


def wanted(texts, numbers=None, **more):
    numbers = range(len(texts)) if numbers is None else numbers
    return sorted((repr(i if i % 7 else None), repr(t), n, d) for i, (t, n, d) in zip(numbers, plain(texts, **more), strict=True))


def some_keys(n, seed):
    return np.frombuffer(np.random.default_rng(seed).bytes(16 * n), "V16")


def test_filter_holds_what_was_put_in_and_not_taken_out():
    keys = some_keys(3000, 1)
    own = L.CuckooFilter.sized(3000)
    assert own.insert(keys) and own.contains(keys).all()
    own.delete(keys[:1500])
    assert own.contains(keys[1500:]).all() and own.contains(keys[:1500]).sum() <= 1
    assert own.contains(some_keys(20000, 2)).sum() <= 1
    own.delete(keys[1500:])
    assert not own.slots.any()


def test_full_filter_is_made_anew():
    keys = some_keys(500, 3)
    before, now = np.zeros(500, np.int64), np.where(np.arange(500) < 20, 10, 0)
    small, _ = L.changed_filter(None, keys, before, now, 10)
    large, wrong = L.changed_filter(small, keys, now, np.full(500, 11), 10)
    assert len(large) > len(small) and L.CuckooFilter(np.frombuffer(large, np.uint32)).contains(keys).all() and not len(wrong)


def test_keys_for_which_a_filter_is_wrong_are_listed():
    keys = some_keys(200, 4).copy()
    raw = keys.view(np.uint8).reshape(-1, 16)
    raw[100:] = raw[:100]
    raw[100:, 8:12] ^= 1  # other keys with the same mark and buckets
    now = np.where(np.arange(200) < 100, 10, 9)
    slots, wrong = L.changed_filter(None, keys, np.zeros(200, np.int64), now, 10)
    assert sorted(x.tobytes() for x in wrong) == sorted(x.tobytes() for x in keys[100:])
    shards = L.Filters(0, [(0, slots, wrong.tobytes())])
    assert shards.repeated([k.tobytes() for k in keys]).tolist() == [True] * 100 + [False] * 100


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_are_those_of_the_plain_version(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(L, "FILTER_BYTES", 0)
    texts = corpus(300)
    assert rows(L.deduplicated_lines(frame(spark, texts), ["doc_id"])) == wanted(texts)


def test_other_thresholds_and_empty_tables(spark):
    texts = corpus(60, 2)
    assert rows(L.deduplicated_lines(frame(spark, texts), ["doc_id"], documents=3, code_points=12)) == wanted(texts, least=3, points=12)
    assert L.deduplicated_lines(frame(spark, texts).limit(0), ["doc_id"]).count() == 0


def test_insertions_and_deletions_leave_the_index_of_what_is_in(spark, tmp_path):
    """Documents come in two parts and some go: rows and counts are those of an index made of what is left."""
    texts = corpus(250, 3)
    first, second, gone = texts[:120], texts[120:], texts[40:200]
    whole = frame(spark, texts)
    index = L.LineIndex.empty(spark).inserted(frame(spark, first)).inserted(frame(spark, second))
    assert rows(index.cleaned(whole, ["doc_id"])) == wanted(texts)
    less = index.deleted(frame(spark, gone), path=str(tmp_path / "index"))
    numbers = [*range(40), *range(200, len(texts))]
    left = [texts[i] for i in numbers]
    rest = spark.createDataFrame([(i if i % 7 else None, texts[i]) for i in numbers], "doc_id long, text string")
    read = L.LineIndex.read(spark, str(tmp_path / "index"))
    assert rows(read.cleaned(rest, ["doc_id"])) == wanted(left, numbers)
    alone = L.LineIndex.empty(spark).inserted(rest)
    table = lambda i: sorted((bytes(r["key"]), r["n"]) for r in i.counts.collect())
    assert table(less) == table(alone)
    # The old index is as it was, and putting the documents in again gives it back.
    assert rows(index.cleaned(whole, ["doc_id"])) == wanted(texts)
    again = less.inserted(frame(spark, gone))
    assert table(again) == table(index) and rows(again.cleaned(whole, ["doc_id"])) == wanted(texts)
    nothing = again.deleted(whole)
    assert table(nothing) == [] and not any(any(bytes(r["slots"])) for r in nothing.filters.collect())
    with pytest.raises(ValueError, match="not in the index"):
        less.deleted(whole)
