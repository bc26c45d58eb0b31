"""Near duplicates by SimHash fingerprints in a vantage-point tree and, for what it leaves apart, prefixes of the shingle sets; each link is verified."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetime.llm.common import scratch, staged
from versetime.llm.decontaminate import shingle_hashes
from versetime.llm.graph import connected_components
from versetime.llm.simhash import hamming_links, majority_bits

#: Words of a shingle.  Two sets link from a similarity of 4/5; the arithmetic below is in whole numbers.
SHINGLE = 5
#: Bits in which fingerprints of sets may differ to be compared, as in :func:`versetime.llm.simhash.near_duplicates`.
RADIUS = 2
#: Shingles for each of which a prefix is one longer; longer prefixes must share more.
MORE = 40
#: Groups, by their first bits, in which the shingles of a set are counted.
TALLIES = 128
#: Rows sampled for common shingles, rows of the sample from which one is common, and common ones at most.  They only
#: set the order in which prefixes are taken, never the result.
SAMPLE_ROWS, COMMON_ROWS, COMMON_SHINGLES = 4000, 8, 50_000


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text; fewer words are one shingle, no words are none.

    A-Z is lower-cased and words are runs without ASCII white space, as in :func:`versetime.llm.simhash.fingerprint`.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(shingle_hashes(words, SHINGLE))


def set_code(own: np.ndarray) -> int:
    """One signed 64-bit number for a set; copies of a set have the same."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``n // 5 + 1 + n // MORE`` shingles of a set in an order shared by all sets: by hash, common ones last by rank.

    Two sets of similarity 4/5 or more share shingles of their prefixes (see :func:`_need`), whatever the order, if only
    it is the same for all.
    """
    size = len(own) // 5 + 1 + len(own) // MORE if len(own) else 0
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        known = common[at] == own
        own = np.concatenate([own[~known], own[known][np.argsort(rank[at[known]], kind="stable")]])
    return own[:size].copy()  # a view would hold the whole set


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))


def _sketched(shared):
    @F.arrow_udf("struct<code:long,n:int,print:long,prefix:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        common, rank = shared.value
        codes, sizes, prints, prefixes = [], [], [], []
        for text in texts:
            own = shingle_set(text.as_py())
            codes.append(set_code(own))
            sizes.append(len(own))
            prints.append(majority_bits(own))
            prefixes.append(prefix(own, common, rank))
        return pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(prefixes)], ["code", "n", "print", "prefix"])

    return of


def _coded_set(text: str) -> Column:
    @F.arrow_udf("struct<code:long,shingles:array<long>,tally:binary>")
    def of(texts: pa.Array) -> pa.Array:
        own = [shingle_set(t.as_py()) for t in texts]
        tallies = [np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=TALLIES).astype("<u4").tobytes() for s in own]
        return pa.StructArray.from_arrays([pa.array([set_code(s) for s in own], pa.int64()), _lists(own), pa.array(tallies, pa.binary())], ["code", "shingles", "tally"])

    return of(text)


def _may_be_similar(a: str, b: str) -> Column:
    """False for tallies of two sets that cannot have a similarity of 4/5: they share no more than the smaller numbers of each tally."""

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(own.to_pylist()), "<u4").reshape(-1, TALLIES).astype(np.int64) for own in (left, right))
        both = np.minimum(x, y).sum(axis=1)
        return pa.array(5 * both >= 4 * (x.sum(axis=1) + y.sum(axis=1) - both), pa.bool_())

    return of(a, b)


def _code(text: Column) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else set_code(shingle_set(t.as_py())) for t in texts], pa.int64())

    return of(text)


def _similar(a: str, b: str) -> Column:
    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
            out.append(5 * both >= 4 * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return of(a, b)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled rows, sorted, and their ranks by the number of rows."""
    sample = rows.sample(min(1.0, SAMPLE_ROWS / max(1, rows.count())), 7).select(F.explode(_coded_set("text")["shingles"]).alias("s"))
    found = sample.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_ROWS).orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).toArrow()
    own, n = found.column("s").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(own)
    return own[order], np.lexsort((own, n)).argsort()[order]


def _near(n: str, limit: str, other: str, other_limit: str) -> Column:
    """Whether the sizes of two sets, and four times the greatest that each can link to, allow a similarity of 4/5."""
    a, b = F.col(n), F.col(other)
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (4 * b <= F.col(limit)) & (4 * a <= F.col(other_limit))


def _need(n: str, other: str) -> Column:
    """How many shingles the prefixes of two sets of similarity 4/5 share at least.

    The sets share 4/9 of both their sizes.  One of the prefixes ends first in the order of all shingles; what they
    share up to there is in both prefixes, and after it no more is left than that set has beyond its prefix.
    """
    beyond = lambda c: F.expr(f"{c} - ({c} div 5 + 1 + {c} div {MORE})")
    return F.greatest(F.lit(1), F.ceil(4 * (F.col(n) + F.col(other)) / 9) - F.greatest(beyond(n), beyond(other)))


def _print_pairs(sketches: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs ``(a, b)`` of codes whose fingerprints are equal or linked in the vantage-point tree: each set with the first
    of its fingerprint, and those firsts along the tree's spanning links."""
    prints = stage(sketches.select("code", "print").distinct(), "prints")
    first = prints.groupBy("print").agg(F.min("code").alias("first"))
    equal = prints.join(first, "print").where("code <> first").select("code", F.col("first").alias("other"))
    near = hamming_links(prints.select(F.col("print").alias("code")), RADIUS)
    side = lambda c, name: first.select(F.col("print").alias(c), F.col("first").alias(name))
    linked = near.join(side("a", "code"), "a").join(side("b", "other"), "b").select("code", "other")
    return equal.unionByName(linked).select(F.least("code", "other").alias("a"), F.greatest("code", "other").alias("b")).distinct()


def _links(rows: DataFrame, sketches: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """:func:`jaccard_links`, with a way to stage tables that go once the links are written."""
    block = Window.partitionBy("s")
    held = sketches.select("code", "n", F.explode("prefix").alias("s")).withColumns({"low": F.min("code").over(block), "high": F.max("code").over(block), "held": F.count("*").over(block)})
    own = Window.partitionBy("code")
    shared = held.where("low <> high").select("s", "code", "n", "held").distinct()
    # What of its prefix no other set has limits the size of the sets that can link to it.
    alone = F.expr(f"n div 5 + 1 + n div {MORE}") - F.count("*").over(own)
    members = stage(shared.select("s", "code", "n", (F.sum("held").over(own) / F.col("n")).alias("known"), (5 * F.col("n") - 9 * alone).alias("limit")), "members")

    def verified(met: DataFrame, name: str) -> DataFrame:
        """Those of the pairs ``met(a, b, print, need)`` that link, of a row for each shingle that their prefixes share, and one
        for a pair that fingerprints name."""
        with scratch(rows.sparkSession) as brief:
            pairs = brief(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.bool_or("print").alias("print")).where("print or n >= need").select("a", "b"), "pairs")
            codes = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).distinct()
            ids = sketches.join(codes, "code", "left_semi").groupBy("code").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
            own = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            sets = brief(own.select(_coded_set("text").alias("x")).select("x.*"), "sets")
            # Only repeated or null ids read a set twice; all others need not be shuffled for it.
            read, distinct = sets.agg(F.count("*"), F.count_distinct("code")).first()
            if read > distinct:
                sets = brief(sets.dropDuplicates(["code"]), "sets-once")
            left, right = (sets.select(F.col("code").alias(c), F.col("tally").alias(f"_{c}")) for c in "ab")
            near = brief(pairs.join(left, "a").join(right, "b").where(_may_be_similar("_a", "_b")).select("a", "b"), "near-pairs")
            left, right = (sets.select(F.col("code").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
            return staged(near.join(left, "a").join(right, "b").where(_similar("_a", "_b")).select("a", "b"), name)

    prints = _print_pairs(sketches, stage).select("a", "b", F.lit(True).alias("print"), F.lit(1).alias("need"))
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25)))
    centre = F.max(F.struct("known", "code", "n", "limit")).over(Window.partitionBy("s", "size"))
    met = members.withColumn("size", size).withColumn("centre", centre).where((F.col("code") != F.col("centre.code")) & _near("n", "limit", "centre.n", "centre.limit"))
    stars = met.select(F.least("code", "centre.code").alias("a"), F.greatest("code", "centre.code").alias("b"), F.lit(False).alias("print"), _need("n", "centre.n").alias("need"))
    first = verified(prints.unionByName(stars), "first-links")
    roots = staged(connected_components(first), "roots")
    labelled = members.join(roots.withColumnRenamed("node", "code"), "code", "left").select("s", "code", "n", "limit", F.coalesce("root", "code").alias("root"))
    mixed = labelled.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
    labelled = stage(labelled.join(mixed, "s", "left_semi"), "labelled")
    left, right = (labelled.select("s", *(F.col(c).alias(f"{c}_{side}") for c in ("code", "n", "limit", "root"))) for side in "ab")
    # A set that can link to smaller ones alone meets no other such set, so those are on one side only.
    equals = F.col("limit_b") >= 4 * F.col("n_b")
    rest = left.where("limit_a >= 4 * n_a").join(right, "s").where((~equals | (F.col("code_a") < F.col("code_b"))) & (F.col("root_a") != F.col("root_b")) & _near("n_a", "limit_a", "n_b", "limit_b"))
    rest = rest.select(F.least("code_a", "code_b").alias("a"), F.greatest("code_a", "code_b").alias("b"), F.lit(False).alias("print"), _need("n_a", "n_b").alias("need"))
    return first.unionByName(verified(rest, "links"))


def jaccard_links(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the codes of sets of similarity 4/5 or more, enough for all components.

    ``rows(doc_id, text)`` are the texts of ``sketches(doc_id, code, n, print, prefix)``.  Sets whose fingerprints meet in
    the vantage-point tree of :func:`versetime.llm.simhash.hamming_links` are compared.  At that similarity fingerprints
    can differ in more bits than a tree can search for, but sets of that similarity share
    shingles of their prefixes and so meet in the blocks of these.  In the same pass each set of a block is compared with the
    block's centre of its size, the set whose shingles most sets have: where many are edited copies of one text, that
    is the text, and all of them join it.  Then those of a block that are still in different components are compared,
    pair by pair.  Only texts of pairs with enough shingles in common are read again, and only pairs whose tallies
    allow the similarity get their sets.
    """
    with scratch(rows.sparkSession) as stage:
        return _links(rows, sketches, stage)


def deduplicated_by_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates, all their columns as they were.

    Documents link if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more; a group is all that
    link by a chain.  Candidates are complete (:func:`jaccard_links`) and each link is verified.

    The row with the smallest id stays; where that id repeats, or all ids of a group are null, one such row does.
    Texts without words, null ones too, are copies of each other; rows with a null id count for the smallest id
    only if the group has no other; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(_common(texts))
    with scratch(docs.sparkSession) as stage:
        sketches = stage(texts.select("doc_id", _sketched(shared)("text").alias("x")).select("doc_id", "x.*"), "sketches")
        first = sketches.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        roots = connected_components(jaccard_links(texts, sketches)).withColumnRenamed("node", "code")
        grouped = first.join(roots, "code", "left").where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "code"))
        lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
        component = staged(grouped.join(lowest, "root").select("code", "root", "component_id"), "components")
        ids = staged(sketches.join(component, "code", "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "grouped-ids")
        repeats = sketches.join(component, "code").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.count("*").alias("n"))
        repeated = staged(repeats.where("n > 1").select("root"), "repeated")
    # Only rows with an id of a group are hashed again; all others stay.
    marked = rows.join(ids.withColumn("_in", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    marked = marked.withColumn("code", _code(F.when(F.col("_in"), F.coalesce("text", F.lit(""))))).join(component, "code", "left").select("row", "doc_id", "root", "component_id")
    lowest = F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = marked.where(F.col("root").isNull() | lowest)
    if not repeated.isEmpty():
        again = kept.join(repeated, "root", "left_semi").dropDuplicates(["root"])
        kept = kept.join(repeated, "root", "left_anti").unionByName(again)
    return kept.select("row.*")
