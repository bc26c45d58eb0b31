"""The pipeline's near-duplicates meet by fingerprints in the vantage-point tree."""

import numpy as np

import corpus_pipeline as P
from versetime.llm import jaccard
from versetime.llm.simhash import fingerprint, majority_bits


def test_bits_are_counted_in_blocks(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 1001, np.uint64)
    want = sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes) * 2 > len(hashes))
    monkeypatch.setattr("versetime.llm.simhash.HASH_BLOCK", 100)
    assert majority_bits(hashes) == want and majority_bits(hashes[:0]) == 0 == fingerprint("")


def test_near_copies_meet_by_their_fingerprints_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 900)) for _ in range(6)]
    near = [f"{t} one" for t in texts]
    prints = [[majority_bits(jaccard.shingle_set(t)) for t in own] for own in (texts, near)]
    assert all((a ^ b).bit_count() <= jaccard.RADIUS for a, b in zip(*prints, strict=True))
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    met = []
    pairs = jaccard._print_pairs
    monkeypatch.setattr(jaccard, "_print_pairs", lambda *own: met.append(pairs(*own)) or met[0])
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == list(range(6))
    assert len(met) == 1
    # Without shingles in common prefixes the fingerprints find them too.
    monkeypatch.setattr(jaccard, "_print_pairs", pairs)
    monkeypatch.setattr(jaccard, "_near", lambda *names: jaccard.F.lit(False))
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == list(range(6))
