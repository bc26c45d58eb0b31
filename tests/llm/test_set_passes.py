"""How often and in what form near_dedup holds and moves shingle sets."""

import numpy as np

import corpus_pipeline as P
from versetime import staging
from versetime.llm import jaccard


def test_a_prefix_does_not_hold_its_set():
    own = jaccard.shingle_set(" ".join(f"w{i}" for i in range(2000)))
    held = jaccard.prefix(own, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert held.base is None and (held == own[: len(held)]).all()


def test_sets_are_read_in_two_passes_and_once_each(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(5)]
    rows = [*enumerate(texts), *((i + 5, f"{t} one") for i, t in enumerate(texts)), (5, texts[1] + " two"), (None, texts[2] + " two"), (None, texts[2] + " two")]
    made, written = [], staging._written
    monkeypatch.setattr(staging, "_written", lambda df, path: made.append(path.rsplit("/", 1)[1].rsplit("-", 1)[0]) or written(df, path))
    kept = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5))
    assert made.count("sets") == 2
