"""SimHash fingerprints and exact Hamming links between them by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import staged
from versetime.llm.graph import connected_components

#: Hashes whose bits are counted at once, which bounds a task's memory whatever a text's length.
HASH_BLOCK = 1 << 15
#: A tree node of so few points is compared pair by pair.
LEAF_POINTS = 160
#: Distinct fingerprints a shard of the shared tree is planned for, its depth at most, and sampled
#: fingerprints a shard: the tree is built from at most SAMPLE_PER_SHARD * 2 ** MAX_DEPTH fingerprints.
SHARD_POINTS, MAX_DEPTH, SAMPLE_PER_SHARD = 4096, 16, 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, repeats included, as an unsigned integer.

    A-Z is lower-cased and words are runs without ASCII white space.  A text of fewer than ``words`` words
    is one shingle; a null text or one without words has fingerprint zero.  A bit is set if it is set in
    over half of the XXH64 hashes.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, ones = max(1, len(tokens) - words + 1), np.zeros(64, np.int64)
    for begin in range(0, total, HASH_BLOCK):
        own = tokens[begin : begin + HASH_BLOCK + words - 1]
        grams = zip(*(own[i:] for i in range(words)), strict=False) if len(own) >= words else [own]
        hashes = np.array([digest(join(g), seed) for g in grams], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes, counted in blocks; none of no hashes."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), HASH_BLOCK):
        own = np.ascontiguousarray(hashes[begin : begin + HASH_BLOCK])
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash64(text: Column, words: int = 3, seed: int = 42) -> Column:
    """Column of SimHash fingerprints as signed 64-bit integers; see :func:`fingerprint`."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex_fingerprint(code: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))


@dataclass
class VantageTree:
    """Inner nodes: a vantage point, a radius and two children (``~n`` is shard n)."""

    points: np.ndarray
    radii: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def route(self, codes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions) such that two codes within ``radius`` of each other share a shard.

        A point belongs inside its node's ball or outside it.  By the triangle inequality a link across the
        boundary has its inner end within ``radius`` of it, so just those inner points also go outside; the
        other branch is pruned for all the rest.
        """
        todo = [(0 if len(self.points) else ~0, np.arange(len(codes)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield ~node, own
                continue
            far = np.bitwise_count(codes[own] ^ self.points[node])
            todo += [
                (int(self.inner[node]), own[far <= self.radii[node]]),
                (int(self.outer[node]), own[far > self.radii[node] - radius]),
            ]


def _split(codes: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius nearest the median that leaves points on both sides, if any."""
    for point in codes[:: max(1, len(codes) // 3)][:3]:
        far = np.bitwise_count(codes ^ point).astype(np.int64)
        below = np.cumsum(np.bincount(far, minlength=65))[:64]
        radius = int(np.abs(below * 2 - len(codes)).argmin())
        if 0 < below[radius] < len(codes):
            return point, radius
    return None


def build_tree(sample: np.ndarray, depth: int) -> VantageTree:
    """A vantage-point tree of at most ``2 ** depth`` shards over sampled codes."""
    points, radii, inner, outer, shards = [], [], [], [], 0
    todo = [(np.unique(sample), 0, None)]
    while todo:
        own, level, parent = todo.pop()
        found = _split(own) if level < depth and len(own) > 1 else None
        if found:
            node = len(points)
            points.append(found[0])
            radii.append(found[1])
            inner.append(0)
            outer.append(0)
            within = np.bitwise_count(own ^ found[0]) <= found[1]
            todo += [(own[within], level + 1, (inner, node)), (own[~within], level + 1, (outer, node))]
        else:
            node, shards = ~shards, shards + 1
        if parent:
            parent[0][parent[1]] = node
    return VantageTree(np.array(points, np.uint64), np.array(radii, np.int64), np.array(inner), np.array(outer))


def _flood(codes: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a set that no ball divides: components grown from a front, never all of its pairs."""
    links, left = [], own
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(codes[left] ^ codes[front[-1]]) <= radius
            links.append((np.full(int(near.sum()), front[-1]), left[near]))
            front, left = np.concatenate([front[:-1], left[near]]), left[~near]
    return links


def local_links(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct codes the position of the smallest code reachable by links within ``radius``."""
    codes = np.ascontiguousarray(codes)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(codes))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF_POINTS:
            near = np.bitwise_count(codes[own][:, None] ^ codes[own][None, :]) <= radius
            if near.sum() == len(own):
                continue
            label = np.arange(len(own))
            while True:
                best = np.where(near, label[None, :], len(own)).min(axis=1)
                if (best == label).all():
                    break
                label = best
            moved = label != np.arange(len(own))
            links.append((own[moved], own[label[moved]]))
            continue
        found = _split(codes[own])
        if found:
            far = np.bitwise_count(codes[own] ^ found[0])
            sides = own[far <= found[1]], own[far > found[1] - radius]
            if max(map(len, sides)) <= 0.95 * len(own):
                todo += sides
                continue
        links += _flood(codes, own, radius)
    order = np.argsort(codes, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(codes))
    label = rank.copy()
    if links:
        a = np.concatenate([x for x, _ in links])
        b = np.concatenate([x for _, x in links])
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[order][label]  # jump: the label of the point that one's label names
            if (label == old).all():
                break
    return order[label]


def hamming_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links ``(a, b)`` between the distinct 64-bit ``codes(code)`` at ``radius`` or fewer bits.

    Codes are partitioned by a vantage-point tree fitted on a bounded sample, with every code indexed.
    Points near a ball's boundary go to both sides, so each shard finds its links alone and no link is
    lost.  A shard returns at most one link for each of its points: two codes are linked by a path exactly
    if they are within ``radius`` of each other along a chain.  Nulls are ignored.
    """
    spark = codes.sparkSession
    codes = staged(codes.where("code is not null").select(F.col("code").cast("long")).distinct(), "codes")
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, codes.count()) / SHARD_POINTS)))))
    tree = build_tree(np.zeros(0, np.uint64), 0)
    if depth:
        share = max(1, codes.count() // (SAMPLE_PER_SHARD << depth))
        rows = codes.where(F.expr(f"pmod(xxhash64(code), {share}) = 0")).limit(SAMPLE_PER_SHARD << (depth + 1))
        tree = build_tree(rows.toPandas()["code"].to_numpy(np.int64).view(np.uint64), depth)
    shared = spark.sparkContext.broadcast(tree)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for shard, at in shared.value.route(own.view(np.uint64), radius):
                yield pa.record_batch({"shard": pa.array(np.full(len(at), shard, np.int32)), "code": pa.array(own[at])})

    def linked(table: pa.Table) -> pa.Table:
        own = table.column("code").to_numpy().astype(np.int64)
        low = own[local_links(own.view(np.uint64), radius)]
        moved = own != low
        return pa.table({"a": own[moved], "b": low[moved]})

    return codes.mapInArrow(routed, "shard int, code long").groupBy("shard").applyInArrow(linked, "a long, b long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """``(code, root, component_id)`` for the codes of ``rows(doc_id, code)`` with links or copies; no others."""
    first = rows.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected_components(hamming_links(rows.select("code"), radius)).withColumnRenamed("node", "code")
    grouped = first.join(roots, "code", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "code"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(lowest, "root").select("code", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, seed: int = 42, radius: int = 2
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: which documents link, directly or by a chain.

    Documents link if their SimHash fingerprints differ in at most ``radius`` bits.  ``component_id`` is the
    smallest id that is reachable, the row's own included.  Equal fingerprints are one point of the search,
    so copies, however many, cost a combined aggregation only.

    Null and empty texts have fingerprint zero and link like any other; rows with a null id take part and
    count for ``component_id`` only if the component has no other id; repeated rows are each returned; an
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), simhash64(F.col(text_col), words, seed).alias("code")), "fingerprints")
    component = _components(rows, radius).select("code", "component_id")
    return rows.join(component, "code", "left").select(
        "doc_id", hex_fingerprint(F.col("code")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, seed: int = 42, radius: int = 2
) -> DataFrame:
    """The rows of ``docs`` with one of each group of :func:`near_duplicates`, all their columns as they were.

    The row with the smallest id stays; where that id repeats, or all ids of a group are null, one such row
    does.  The rows are written to the shared folder with their fingerprints, so texts are read once.
    """
    rows = staged(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), simhash64(F.col(text_col), words, seed).alias("code")), "fingerprints")
    component = staged(_components(rows.select("doc_id", "code"), radius), "components")
    marked = rows.join(component, "code", "left")
    lowest = F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))
    repeated = staged(marked.where(lowest).groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "repeated")
    kept = marked.where(F.col("root").isNull() | lowest)
    if not repeated.isEmpty():
        again = kept.join(repeated, "root", "left_semi").dropDuplicates(["root"])
        kept = kept.join(repeated, "root", "left_anti").unionByName(again.select(kept.columns))
    return kept.select("row.*")
