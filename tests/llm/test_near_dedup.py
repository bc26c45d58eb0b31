import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from versetime.llm import simhash
from versetime.llm.graph import connected_components
from versetime.llm.queries import op1_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(codes, radius=2):
    """Lowest position reachable from each position, by all pairs."""
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    label = np.arange(len(codes))
    while True:
        best = np.where(near, label[None, :], len(codes)).min(axis=1)
        if (best == label).all():
            return label
        label = best


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c d " * 50, "É x \x85y z\x00 w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_is_counted_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(3000))
    monkeypatch.setattr(simhash, "HASH_BLOCK", 64)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(rng, n):
    centre = rng.integers(0, 1 << 64, max(1, n // 12), np.uint64)
    out = rng.choice(centre, n)
    for _ in range(4):
        out ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(out)


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_shard(seed):
    codes = clustered(np.random.default_rng(seed), 1500)
    assert (simhash.local_links(codes, 2) == components(codes)).all()


def test_links_of_one_ball():
    codes = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64)
    codes = np.unique(codes)
    assert (simhash.local_links(codes, 2) == components(codes)).all()


def test_boundary_points_go_to_every_shard_they_need():
    rng = np.random.default_rng(9)
    codes = clustered(rng, 1200)
    tree = simhash.build_tree(codes[::3], 5)
    shards = [set(at.tolist()) for _, at in tree.route(codes, 2)]
    assert len(shards) > 8 and set().union(*shards) == set(range(len(codes)))
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    assert all(any(a in s and b in s for s in shards) for a, b in near.tolist())


def test_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 50)
    codes = clustered(np.random.default_rng(5), 1500)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)] + [(None,)], "code long")
    pairs = connected_components(simhash.hamming_links(df)).collect()
    root = {r.node: r.root for r in pairs}
    label = components(codes)
    groups = lambda own: {frozenset(k for k in own if own[k] == v) for v in own.values()}
    want = {int(c): int(codes[k].view(np.int64)) for c, k in zip(codes.view(np.int64), label, strict=True)}
    assert groups({c: root.get(c, c) for c in want}) == groups(want)


def test_query_against_all_pairs(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    codes = [plain_fingerprint(t) for _, t in rows]
    label = components(codes)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_near_dedup(spark, SF).collect()}
    assert found == {i: (f"{c:016x}", rows[k][0]) for (i, _), c, k in zip(rows, codes, label, strict=True)}
    assert len(set(label)) < len(rows)


ODD = [(1, None, 5), (2, "", 6), (3, "x y z", None), (3, "x y z", 8), (None, "x y z", 9), (4, "other words are here", 1), (None, "alone " + "q " * 9, 2), (5, "lone", 3), (5, "lone", 3)]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, code long").withColumns({"fingerprint": F.lit(1), "component_id": F.lit("x")})
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (4, 4), (None, None), (5, 5), (5, 5)], key=str)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", None), ("3", "x y z"), ("4", ODD[5][1]), ("None", ODD[6][1]), ("5", "lone")], key=str)
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.deduplicated(empty).count()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (7, None)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {200: 200, 201: 200}
