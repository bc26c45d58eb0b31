"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import staged

#: Keys over which the links of a node are dealt.
SALTS = 16


def _salted(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges(u, v)`` with the ``m`` that ``least(u, m)`` has for u."""
    repeated = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(repeated, ["u", "salt"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected ``edges(a, b)`` as ``(node, root)``; root is the smallest node.

    Every round is two minimum aggregations (combined before their shuffles, so a node with very many
    links is one row a task) and two equi-joins, in which a node's links are dealt over ``SALTS`` keys and
    its minimum is repeated for each.  Each round's edges are written to the shared folder.  Rounds grow with the logarithm of the longest path.
    Self links and nulls are ignored; roots appear with themselves as root; an empty table gives no rows.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, lowest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
