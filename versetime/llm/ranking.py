"""Ranked lexical search by block-max pruning over a forward index of document ranges."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versetime.llm.common import rolling, scratch, staged

#: Documents of a block, and terms of one, with repeats, from which it ends.
BLOCK_DOCUMENTS, BLOCK_TERMS = 256, 1 << 18
#: Blocks of each item that the first round scores, how many times as many ones each further round has, and results of an item.
FIRST_BLOCKS, GROWTH, RESULTS = 4, 8, 10
#: Items, and bytes of their texts, that are searched for at once, and numbers of blocks that are broadcast at most.
ITEMS, ITEM_BYTES, BLOCK_NUMBERS = 1024, 4 << 20, 1 << 20

# Bytes that separate terms, and those that are lower-cased.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
# Numbers of the score.
_UNIT, _MILLI, _FREQUENCY, _PERCENT, _LENGTH = 1_000_000_000, 1000, 8, 100, 90

#: Columns of the index.  A block's terms are one text with spaces between; numbers are packed, see :func:`packed`.
INDEX = (
    "block long, n_docs long, n_terms long, doc_ids array<long>, terms binary, lengths binary, df binary, entry_docs binary, entry_tf binary, "
    "peaks binary, peak_tf binary, peak_length binary"
)
PEAKS = ("peaks", "peak_tf", "peak_length")


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from zero up as bytes of the narrowest of four widths, which is the first byte."""
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(numbers) or int(numbers.max()) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def unpacked(own: bytes) -> np.ndarray:
    return np.frombuffer(own, f"<u{own[0]}", offset=1).astype(np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(_MILLI * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied by: grows with its occurrences, falls with the document's length."""
    m = _PERCENT - _LENGTH + (_LENGTH * lengths * n) // total
    return (_UNIT * tf) // (_MILLI * tf + _FREQUENCY * m)


def block_of(number: int, ids: list[int | None], counts: list[Counter]) -> dict:
    """One block: its documents by growing length, its terms, and for each term its entries (document, occurrences) and peaks.

    A term's peaks are the entries with more occurrences than those of all documents before: whatever the corpus's counts
    become, one of them has the term's greatest impact in the block.
    """
    lengths = np.array([c.total() for c in counts], np.int64)
    by_length = np.argsort(lengths, kind="stable")
    ids, counts, lengths = [ids[i] for i in by_length], [counts[i] for i in by_length], lengths[by_length]
    terms = list(dict.fromkeys(chain.from_iterable(counts)))
    place = {t: i for i, t in enumerate(terms)}
    docs = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    own = np.fromiter(map(place.__getitem__, chain.from_iterable(counts)), np.int64, len(docs))
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, len(docs))
    order = np.argsort(own, kind="stable")
    own, docs, tf = own[order], docs[order], tf[order]
    # A running maximum within each term, as those of later terms are above all of earlier ones.
    running = np.maximum.accumulate((own << 32) + tf)
    peak = np.ones(len(own), bool)
    peak[1:] = running[1:] > running[:-1]
    numbers = {
        "lengths": lengths, "df": np.bincount(own, minlength=len(terms)), "entry_docs": docs, "entry_tf": tf,
        "peaks": np.bincount(own[peak], minlength=len(terms)), "peak_tf": tf[peak], "peak_length": lengths[docs[peak]],
    }
    return {"block": number, "n_docs": len(counts), "n_terms": int(lengths.sum()), "doc_ids": ids, "terms": b" ".join(terms)} | {k: packed(x) for k, x in numbers.items()}


def index_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The forward index of ``docs`` in blocks of consecutive rows (see :data:`INDEX`); nothing is shuffled.

    A row of the index is a block: documents in the order in which they are stored, exact terms, no hashes.  Documents
    without terms, null texts too, are in no block; null ids and repeated rows are; an empty table gives no rows.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, counts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def sent() -> pa.RecordBatch:
            row = block_of(number, ids, counts)
            return pa.RecordBatch.from_pylist([row], _INDEX_TYPE)

        for batch in batches:
            for one, text in zip(batch.column(0), batch.column(1), strict=True):
                own = terms_of(text.as_py() or b"")
                if not own:
                    continue
                ids.append(one.as_py())
                counts.append(Counter(own))
                held += len(own)
                if len(ids) == BLOCK_DOCUMENTS or held >= BLOCK_TERMS:
                    yield sent()
                    number, ids, counts, held = number + 1, [], [], 0
        if ids:
            yield sent()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(blocks, INDEX)


_INDEX_TYPE = pa.schema([
    ("block", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    *((c, pa.binary()) for c in ("terms", "lengths", "df", "entry_docs", "entry_tf", "peaks", "peak_tf", "peak_length")),
])


class Queries:
    """A block of items: the terms of all, and of each item its terms' places and weights."""

    def __init__(self, texts: list[bytes], n: int, total: int, df: dict[bytes, int]) -> None:
        self.n, self.total = n, total
        own = [[t for t in dict.fromkeys(terms_of(text)) if df.get(t)] for text in texts]
        self.terms = sorted(set().union(*own)) if own else []
        place = {t: i for i, t in enumerate(self.terms)}
        weights = np.array([weight(n, df[t]) for t in self.terms], np.int64)
        self.ends = np.cumsum([0, *map(len, own)])
        self.places = np.array([place[t] for terms in own for t in terms], np.int64)
        self.weights = weights[self.places] if len(self.places) else np.zeros(0, np.int64)
        self.items = np.repeat(np.arange(len(own)), np.diff(self.ends))
        self.place = place

    def bounds(self, found: tuple[np.ndarray, np.ndarray], peaks: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each item the sum of its terms' greatest contributions in the block: no document has a higher score.

        ``found`` are the block's terms that an item has, see :func:`shared_terms`.
        """
        own, at = found
        best = np.zeros(max(1, len(self.terms)), np.int64)
        if len(own):
            begin = np.cumsum(peaks) - peaks
            best[at] = np.maximum.reduceat(impacts(tf, lengths, self.n, self.total), begin)[own]
        out = np.zeros(len(self.ends) - 1, np.int64)
        np.add.at(out, self.items, self.weights * best[self.places])
        return out

    def scores(self, item: int, entries: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int) -> np.ndarray:
        """The item's score of each document of a block with ``entries`` of (documents, impacts) by term."""
        out = np.zeros(n_docs, np.int64)
        for k in range(self.ends[item], self.ends[item + 1]):
            if (own := entries.get(int(self.places[k]))) is not None:
                out[own[0]] += self.weights[k] * own[1]  # a document is there once a term
        return out


def shared_terms(terms: bytes, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the block, place in ``place``) of a block's terms that ``place`` has."""
    both = [(i, place[t]) for i, t in enumerate(terms.split(b" ")) if t in place]
    return np.array([i for i, _ in both], np.int64), np.array([q for _, q in both], np.int64)


def _numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return unpacked(batch.column(name)[row].as_py())


def _bounds(index: DataFrame, shared) -> DataFrame:
    """``(item, block, bound)`` for bounds above zero."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                own = shared.value.bounds(shared_terms(batch.column("terms")[row].as_py(), shared.value.place), *(_numbers(batch, row, c) for c in PEAKS))
                item = np.flatnonzero(own)
                yield pa.record_batch({"item": pa.array(item, pa.int32()), "block": pa.array([batch.column("block")[row].as_py()] * len(item), pa.int64()), "bound": pa.array(own[item], pa.int64())})

    return index.select("block", "terms", *PEAKS).mapInArrow(bounds, "item int, block long, bound long")


def _best(scores: np.ndarray, least: int, ids: list[int | None], results: int) -> np.ndarray:
    """Positions of the ``results`` best of the scores that are ``least`` at least; equal ones by id, null last."""
    own = np.flatnonzero(scores >= least)
    if len(own) > results:
        cut = np.partition(scores[own], len(own) - results)[len(own) - results]
        own = own[scores[own] >= cut]
    return np.array(sorted(own.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:results], np.int64)


@dataclass(frozen=True)
class Round:
    """Which ranges a round scores for each item: after ``begins`` and up to ``ends``, by (bound, block), bound ``least`` or more."""

    begins: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    least: np.ndarray

    def items(self, block: int, bounds: np.ndarray) -> list[int]:
        (high, after), (low, last) = self.begins, self.ends
        own = (bounds < high) | ((bounds == high) & (block > after))
        own &= (bounds > low) | ((bounds == low) & (block <= last))
        return np.flatnonzero(own & (bounds >= np.maximum(self.least, 1))).tolist()


def _hits(index: DataFrame, shared, now: Round, results: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of the ranges of a round."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for row in range(len(batch)):
                terms = shared_terms(batch.column("terms")[row].as_py(), queries.place)
                items = now.items(batch.column("block")[row].as_py(), queries.bounds(terms, *(_numbers(batch, row, c) for c in PEAKS)))
                if not items:
                    continue
                lengths, df, tf, docs = (_numbers(batch, row, c) for c in ("lengths", "df", "entry_tf", "entry_docs"))
                ids, begin = batch.column("doc_ids")[row].as_py(), np.cumsum(df) - df
                own = impacts(tf, lengths[docs], queries.n, queries.total)
                entries = {int(q): (docs[begin[i] : begin[i] + df[i]], own[begin[i] : begin[i] + df[i]]) for i, q in zip(*terms, strict=True)}
                found = []
                for item in items:
                    scores = queries.scores(item, entries, len(lengths))
                    found += [(item, ids[i], int(scores[i])) for i in _best(scores, max(1, int(now.least[item])), ids, results)]
                yield pa.record_batch({"item": pa.array([x[0] for x in found], pa.int32()), "doc_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.int64())})

    return index.select("block", "terms", *PEAKS, "doc_ids", "lengths", "df", "entry_docs", "entry_tf").mapInArrow(score, "item int, doc_id long, score long")


def _top(hits: DataFrame, results: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= results)


def _frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of an item block's terms is."""
    shared = index.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                own, at = shared_terms(batch.column("terms")[row].as_py(), shared.value)
                total[at] += _numbers(batch, row, "df")[own]
        own = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(own, pa.int32()), "n": pa.array(total[own], pa.int64())})

    found = index.select("terms", "df").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r["term"]]: r["n"] for r in found}


def _searched(index: DataFrame, texts: list[bytes], totals: tuple[int, int], results: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` of one block of items, whose positions are ``item``."""
    spark = index.sparkSession
    df = _frequencies(index, sorted({t for text in texts for t in terms_of(text)}))
    shared = spark.sparkContext.broadcast(Queries(texts, *totals, df))
    best, count = rolling(spark), len(texts)
    begins, least = (np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)), np.zeros(count, np.int64)
    with scratch(spark) as stage:
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
        bounds = stage(_bounds(index, shared).withColumn("place", F.row_number().over(by_bound)), "bounds")
        begin, size, hits = 0, FIRST_BLOCKS, None
        while True:
            ends = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
            for r in bounds.where(F.col("place") == begin + size).collect():
                ends[0][r["item"]], ends[1][r["item"]] = r["bound"], r["block"]
            blocks = stage(_left(bounds, least, begin).where(F.col("place") <= begin + size).select("block").distinct(), "blocks")
            # Where few ranges are meant the others do not leave the scan; which items they are for each task knows from its bounds.
            few = blocks.count() <= BLOCK_NUMBERS
            meant = index.join(F.broadcast(blocks), "block", "left_semi") if few else index
            found = _hits(meant, shared, Round(begins, ends, least), results)
            hits = best(_top(found if hits is None else hits.select("item", "doc_id", "score").unionByName(found), results), "hits")
            least = np.zeros(count, np.int64)
            for r in hits.where(F.col("rank") == results).select("item", "score").collect():
                least[r["item"]] = r["score"]
            begins, begin, size = ends, begin + size, size * GROWTH
            if _left(bounds, least, begin).isEmpty():
                return hits


def _left(bounds: DataFrame, least: np.ndarray, begin: int) -> DataFrame:
    """Ranges that come after the first ``begin`` of an item and have bounds not below its lowest result: equal scores may still win by id."""
    limits = bounds.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(least)), pa.int32()), "least": pa.array(least, pa.int64())}))
    return bounds.where(F.col("place") > begin).join(F.broadcast(limits), "item").where("bound >= least")


def searched(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", *, results: int = RESULTS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each of ``items`` its highest-scoring documents of ``index``.

    ``index`` is a written :func:`index_blocks`.  Items are taken in blocks of ``ITEMS`` or ``ITEM_BYTES``.  For each
    block one pass over the peaks bounds every item's score in every document range; ranges are put in order of bound,
    and rounds of growing size score them until no range that is left has a bound as high as the item's lowest result so
    far.  Each task scores its ranges' documents whole and returns the best; what is broadcast is a block of items.

    Only scores above zero count; equal ones go by id, null last.  Items without terms, null ones too, give no rows; each
    row of ``items`` is one, repeated and null ids too; no items or documents give no rows.  Other columns are not read.
    """
    spark, found = index.sparkSession, None
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    ids, texts, size = [], [], 0

    def search() -> None:
        nonlocal found
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), item_col: pa.array(ids, items_type)}))
        one = staged(_searched(index, texts, (n, total), results).join(F.broadcast(names), "item").select(item_col, "rank", "doc_id", "score"), "ranked")
        found = one if found is None else found.unionByName(one)

    items_type = pa.string() if dict(items.dtypes)[item_col] == "string" else pa.int64()
    for row in items.select(item_col, F.col(text_col).cast("binary").alias("text")).toLocalIterator() if n else ():
        ids.append(row[0])
        texts.append(bytes(row[1] or b""))
        size += len(texts[-1])
        if len(ids) == ITEMS or size >= ITEM_BYTES:
            search()
            ids, texts, size = [], [], 0
    if ids:
        search()
    if found is None:
        return items.select(item_col).limit(0).selectExpr(item_col, "cast(0 as int) as rank", "0L as doc_id", "0L as score")
    return found


def ranked(docs: DataFrame, items: DataFrame, *, results: int = RESULTS) -> DataFrame:
    """:func:`searched` over an index of ``docs(doc_id, text)`` made for it."""
    return searched(staged(index_blocks(docs), "lexical-index"), items, results=results)
