import os
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from versetime.llm import jaccard
from versetime.llm.common import scratch, staged
from versetime.llm.simhash import fingerprint


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that stay of (id, text), by all pairs whose sets have a Jaccard similarity of 0.8 or more."""
    ids, sets = [i for i, _ in rows], [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(top(k), []).append(i)
    return {min(g) for g in groups.values()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r.doc_id for r in P.near_dedup(spark, docs, f"/root/testdata/{sf}").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == plain_kept(rows)


@pytest.mark.parametrize("common", [8, 2])
def test_edited_copies_go_and_texts_less_alike_stay(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON_ROWS", common)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)] + "a line that very many of these texts have".split()
        rows.append((10 * k, " ".join(words)))
        for edit in range(1, 6):
            own = list(words)
            for at in rng.choice(120, edit, replace=False):
                own[at] = "edited"
            rows.append((10 * k + edit, " ".join(own)))
    base = fingerprint(rows[0][1])
    assert any((fingerprint(t) ^ base).bit_count() > 2 for _, t in rows[1:3])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert 40 <= len(want) < len(rows)
    assert {r.doc_id for r in P.near_dedup(spark, df, "").collect()} == want


def test_odd_rows(spark):
    long = "alone " + " ".join("qrstuvwxyz")
    data = [(1, None), (2, ""), (3, "x y z"), (3, "x y z"), (None, "x y z"), (4, "other words are here"), (None, long), (None, long), (5, "lone"), (5, "lone"), (5, "not the same text")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"code": F.lit(1), "root": F.lit("x"), "_id": F.lit(2)})
    kept = jaccard.deduplicated_by_jaccard(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", "None"), ("3", "x y z"), ("4", data[5][1]), ("None", long), ("5", "lone"), ("5", "not the same text")])
    assert jaccard.deduplicated_by_jaccard(df.limit(0)).count() == 0


def test_scratch_tables_go_and_staged_ones_stay(spark):
    paths = lambda df: [p.removeprefix("file://") for p in df.inputFiles()]
    with scratch(spark) as stage:
        short = paths(stage(spark.range(3), "short"))
        kept = staged(spark.range(2), "kept")
        assert all(map(os.path.exists, short))
    assert short and not any(map(os.path.exists, short)) and kept.count() == 2
