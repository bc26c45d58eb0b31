"""Centroid clustering of integer vectors by sort-means: exact assignments with few distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import rolling, staged

#: Components of a vector, what a component is multiplied by before it is floored, and the bound of the product, which
#: keeps every squared distance and four of its roots within a long.
DIMENSIONS, SCALE, LIMIT = 64, 64, 1 << 27


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``y``, a point or as many rows."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def nearest(x: np.ndarray, centroids: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of each row of ``x``; the smaller number wins a tie.

    From the centroid c that a row had before, others are tried in order of their distance to c.  One that is more than
    twice as far from c as the row is cannot be as near to the row as c, by the triangle inequality, nor can any after it.
    """
    gaps = np.stack([squared(centroids, c) for c in centroids])
    order = np.argsort(gaps, axis=1, kind="stable")
    cluster, best = previous.copy(), squared(x, centroids[previous])
    computed = len(x)
    for c in np.unique(previous):
        own = np.flatnonzero(previous == c)
        reach = best[own].copy()
        for other in order[c]:
            if other == c:
                continue
            within = -(-gaps[c, other] // 4) <= reach
            own, reach = own[within], reach[within]
            if not len(own):
                break
            far = squared(x[own], centroids[other])
            computed += len(own)
            better = (far < best[own]) | ((far == best[own]) & (other < cluster[own]))
            cluster[own[better]], best[own[better]] = other, far[better]
    return cluster, best, computed


def whole_numbers(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as doubles multiply; null if one is beyond ``LIMIT``."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    return F.when(F.forall(scaled, lambda x: F.abs(x) < LIMIT), F.transform(scaled, lambda x: F.floor(x).cast("int")))


def is_whole(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right number of components, all of them finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, before = batch.column("v"), batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.float64)
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            cluster, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            missing = np.ones(len(batch), bool)
            if len(there):
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(there), -1)
                found, far, _ = nearest(x, shared.value, np.nan_to_num(before[there]).astype(np.int64))
                cluster[there], distance[there], missing[there] = found, far, False
            new = {"cluster": pa.array(cluster, mask=missing), "distance": pa.array(distance, mask=missing)}
            yield pa.record_batch({name: new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)})

    return rows.mapInArrow(assign, rows.schema)


def _first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    hashed = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    chosen = hashed.where("v is not null and h is not null").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; empty ones stay.  One row a cluster and task is shuffled."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for cluster, n, *total in rows.where("cluster is not null").groupBy("cluster").agg(F.count("*"), *sums).collect():
        out[cluster] = [s // n for s in total]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 16, rounds: int = 3, seed: int = 1,
    dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector, and the centroids.

    Vectors of ``dimensions`` finite components become whole numbers ``floor(scale * x)``.  The first centroids are the
    ``k`` vectors whose ``<seed>:<id>`` have the smallest SHA-256, in that order.  A round assigns every vector to its
    nearest centroid (:func:`nearest`) and moves each centroid to the exact floored mean of its vectors; after the last
    round vectors are assigned once more.  Each round writes the vectors with their clusters, as the next one starts its
    search there, and deletes those of the round before; only ``k`` sums reach the driver.

    Vectors that are null, of another length, or with a null or non-finite component give no row.  One with a component
    of ``LIMIT / scale`` or more, whose distances do not fit a long, gives a row of nulls and moves no centroid.  A null
    id is no first centroid but is clustered; repeated rows are each returned, and as first centroids equal hashes go by
    their components; fewer than ``k`` vectors are as many centroids; sums beyond a long are null; an empty table gives
    no rows.  Other columns are not read.
    """
    spark, vector = vectors.sparkSession, F.col(vector_col)
    kept = vectors.where(is_whole(vector, dimensions)).select(F.col(id_col).alias("vec_id"), whole_numbers(vector, dimensions, scale).alias("v"))
    stage = rolling(spark)
    rows = stage(kept.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "vectors")
    centroids = _first_centroids(rows, k, seed)
    if len(centroids):
        for _ in range(rounds):
            rows = stage(_assigned(rows, centroids), "clusters")
            centroids = _moved(rows, centroids)
        rows = _assigned(rows, centroids)
    else:
        rows = rows.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
    found = staged(rows.select("vec_id", "cluster", "distance"), "clustered")
    inertia = {r[0]: r[1] for r in found.where("cluster is not null").groupBy("cluster").agg(F.try_sum("distance")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    total = total if total is None or total < 1 << 63 else None
    of_cluster = pa.table({
        "cluster": pa.array(list(inertia), pa.int32()), "cluster_inertia": pa.array(list(inertia.values()), pa.int64()),
        "inertia": pa.array([total] * len(inertia), pa.int64()), "centroid_sha256": pa.array([centroid_digest(centroids[c]) for c in inertia], pa.string()),
    })
    return found.join(F.broadcast(spark.createDataFrame(of_cluster)), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
