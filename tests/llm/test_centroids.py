import hashlib

import numpy as np
import pytest

from versetime.llm.centroids import DIMENSIONS, clustered, nearest


def plain(rows, k=16, rounds=3, dimensions=DIMENSIONS):
    """The contract word by word: every distance, in Python's whole numbers."""
    kept = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]
    assign = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *assign(v)) for i, v in kept]
    own = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), n, d, own[n], sum(own.values()), digest[n]) for i, d, n in found)


def listed(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_pruned_assignment_is_that_of_all_distances(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (12, 8))
    x = (centres[rng.integers(0, 12, 500)] + rng.integers(-3, 4, (500, 8))).astype(np.int64)
    x = np.concatenate([x, rng.integers(-2, 3, (200, 8)), centres])  # many ties too
    centroids = np.concatenate([centres, centres[:2], np.zeros((2, 8), np.int64)]).astype(np.int64)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    start = every.argmin(axis=1) if seed else rng.integers(0, len(centroids), len(x))
    cluster, best, computed = nearest(x, centroids, start)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    if seed:
        assert computed < every.size / 2


def test_rows_are_those_of_the_plain_version(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (20, DIMENSIONS))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.2, DIMENSIONS)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector very often
    rows += [rows[3], rows[3], (None, rows[5][1])]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, cluster string").repartition(5)
    found, centroids = clustered(df)
    assert len(centroids) == 16 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert listed(found) == plain(rows + odd)


def test_few_vectors_huge_ones_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [float(i)] * DIMENSIONS) for i in range(5)]
    assert listed(clustered(spark.createDataFrame(rows, schema))[0]) == plain(rows)
    huge = spark.createDataFrame([*rows, (9, [1e300] * DIMENSIONS)], schema)
    found = listed(clustered(huge)[0])
    assert [r for r in found if r[0] != "9"] == plain(rows)
    assert [r for r in found if r[0] == "9"] == [("9", None, None, None, None, None)]
    assert clustered(spark.createDataFrame([], schema))[0].count() == 0
    assert listed(clustered(huge.where("vec_id = 9"))[0]) == [("9", None, None, None, None, None)]
    assert listed(clustered(spark.createDataFrame([(None, [1.0] * DIMENSIONS)], schema))[0]) == [("None", None, None, None, None, None)]


def test_other_parameters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(60)]
    found, _ = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, rounds=6, dimensions=3)
    assert listed(found) == plain(rows, 4, 6, 3)
