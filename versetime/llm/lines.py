"""Line dedup that can be taken back: cuckoo filters of the repeated lines, in shards, over exact reference counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetime.llm.common import new_shared_path, scratch, staged

#: Documents from which a line is repeated, and code points of a line's key from which it can be.
DOCUMENTS, CODE_POINTS = 10, 1
#: Slots of a bucket, moves before a filter counts as full, and the share of its slots that are planned for.
SLOTS, MOVES, LOAD = 4, 500, 0.8
#: Keys that a shard is planned for, bytes of filters that are broadcast at most, and parts into which a line's
#: documents are dealt where the filters are larger.
SHARD_KEYS, FILTER_BYTES, SALTS = 1 << 20, 64 << 20, 16
#: Keys that a counting task gathers before it sends them on.
GATHERED_KEYS = 1 << 18

_SPACE = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.dtype("V16")


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def line_keys(lines: list[bytes], least: int = CODE_POINTS) -> list[bytes | None]:
    """For each line a 128-bit digest of it without outer white space and with A-Z lower-cased; None if that is too short."""
    own = [line.strip(_SPACE).lower() for line in lines]
    return [hashlib.blake2b(key, digest_size=16).digest() if _long_enough(key, least) else None for key in own]


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(keys).view(">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _marks(low: np.ndarray) -> np.ndarray:
    """A key's 32-bit mark, which is never zero, as zero is a free slot."""
    return np.maximum(low & np.uint64(0xFFFFFFFF), np.uint64(1)).astype(np.uint32)


def _turn(marks: np.ndarray) -> np.ndarray:
    """What takes a mark from either of its buckets to the other."""
    return (marks.astype(np.uint64) * _MIX) >> np.uint64(32)


class CuckooFilter:
    """Marks of 128-bit keys, each in one of two buckets; holds all keys put in, and very seldom seems to hold another."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots.reshape(-1, SLOTS)
        self.mask = len(self.slots) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros(SLOTS << max(0, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))), np.uint32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high, low = _halves(keys)
        marks = _marks(low)
        first = high & np.uint64(self.mask)
        return marks, first.astype(np.int64), (first ^ _turn(marks) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(keys)
        return ((self.slots[first] == marks[:, None]) | (self.slots[second] == marks[:, None])).any(axis=1)

    def _put(self, mark: int, at: int) -> bool:
        row = self.slots[at]
        free = np.flatnonzero(row == 0)
        if len(free):
            row[free[0]] = mark
        return bool(len(free))

    def insert(self, keys: np.ndarray) -> bool:
        """Put keys in; False if there was no room, and then the filter has lost one and must be made anew."""
        for mark, first, second in zip(*self._places(keys), strict=True):
            if self._put(mark, first) or self._put(mark, second):
                continue
            at = second
            for move in range(MOVES):
                slot = move % SLOTS
                mark, self.slots[at][slot] = self.slots[at][slot], mark
                at ^= int(_turn(np.array([mark], np.uint32))[0]) & self.mask
                if self._put(mark, at):
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in."""
        for mark, first, second in zip(*self._places(keys), strict=True):
            at = first if (self.slots[first] == mark).any() else second
            self.slots[at][np.flatnonzero(self.slots[at] == mark)[0]] = 0


def changed_filter(slots: bytes | None, keys: np.ndarray, before: np.ndarray, now: np.ndarray, least: int) -> tuple[bytes, np.ndarray]:
    """A shard's filter after its counts went from ``before`` to ``now``, and the keys that it wrongly seems to hold.

    Keys that are no longer repeated are taken out of the filter ``slots`` and new ones are put in.  Without a filter, or
    when it is full, one is made of all repeated keys.
    """
    was, is_now = before >= least, now >= least
    own = CuckooFilter(np.frombuffer(slots, np.uint32).copy()) if slots else CuckooFilter.sized(int(is_now.sum()))
    if slots:
        own.delete(keys[was & ~is_now])
    room, size = own.insert(keys[is_now & ~was] if slots else keys[is_now]), own.slots.size
    while not room:
        size *= 2
        own = CuckooFilter(np.zeros(size, np.uint32))
        room = own.insert(keys[is_now])
    other = keys[~is_now & (now > 0)]
    return own.slots.tobytes(), other[own.contains(other)]


class Filters:
    """The filters of all shards as one array, with the few keys for which they are wrong."""

    def __init__(self, bits: int, rows: list[tuple[int, bytes, bytes]]) -> None:
        self.bits = np.uint64(64 - bits)
        own = {shard: np.frombuffer(slots, np.uint32).reshape(-1, SLOTS) for shard, slots, _ in rows}
        sizes = np.array([len(own[s]) if s in own else 1 for s in range(1 << bits)])
        self.begins, self.masks = np.cumsum(sizes) - sizes, (sizes - 1).astype(np.uint64)
        self.slots = np.concatenate([own.get(s, np.zeros((1, SLOTS), np.uint32)) for s in range(1 << bits)])
        self.wrong = {x[i : i + 16] for _, _, x in rows for i in range(0, len(x), 16)}

    def repeated(self, keys: list[bytes]) -> np.ndarray:
        high, low = _halves(np.frombuffer(b"".join(keys), _KEY))
        shard = (high >> self.bits if self.bits < 64 else np.zeros_like(high)).astype(np.int64)
        marks, mask, begin = _marks(low), self.masks[shard], self.begins[shard]
        first = high & mask
        second = first ^ _turn(marks) & mask
        held = [self.slots[begin + place.astype(np.int64)] == marks[:, None] for place in (first, second)]
        found = (held[0] | held[1]).any(axis=1)
        if self.wrong:
            for i in np.flatnonzero(found):
                found[i] = keys[i] not in self.wrong
        return found


def _counts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """``(key, n)``: how many rows of ``docs`` hold a line; combined within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.record_batch({"key": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for key in set(line_keys((text.as_py() or b"").split(b"\n"), least)) - {None}:
                    held[key] = held.get(key, 0) + 1
                    if len(held) >= GATHERED_KEYS:
                        yield sent()
        yield sent()

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "key binary, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


_CLEANED = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
_CLEANED_DDL = "struct<text:string,n_lines:long,n_dropped:long>"


def _without(lines: list[bytes], drop: list[bool], there: bool) -> dict:
    kept = b"\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone)
    return {"text": kept.decode("utf-8", "replace") if there else None, "n_lines": len(lines), "n_dropped": sum(drop)}


def _cleaned_by(shared, least: int):
    @F.arrow_udf(_CLEANED_DDL)
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            lines = (text.as_py() or b"").split(b"\n")
            keys = line_keys(lines, least)
            drop = [False] * len(lines)
            at = [i for i, key in enumerate(keys) if key]
            if at:
                for i, gone in zip(at, shared.value.repeated([keys[i] for i in at]).tolist(), strict=True):
                    drop[i] = gone
            out.append(_without(lines, drop, text.is_valid))
        return pa.array(out, _CLEANED)

    return of


def _cleaned_of(text: Column, keys: Column, least: int) -> Column:
    @F.arrow_udf(_CLEANED_DDL)
    def of(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, dropped, strict=True):
            lines, gone = (text.as_py() or b"").split(b"\n"), set(own.as_py() or ())
            out.append(_without(lines, [key in gone for key in line_keys(lines, least)], text.is_valid))
        return pa.array(out, _CLEANED)

    return of(text, keys)


def _shard(bits: int) -> Column:
    return F.expr(f"shiftright(cast(conv(hex(substring(key, 1, 4)), 16, 10) as bigint), {32 - bits})").cast("int")


_PARAMETERS = "bits int, documents long, code_points int"


@dataclass(frozen=True)
class LineIndex:
    """Which lines are in how many documents, as a folder: exact ``counts(key, n)`` and ``filters(shard, slots, wrong)``.

    Filters hold the keys that are in at least ``documents`` documents, and each shard of them lists the keys of its
    counts for which it is wrong, so that what a filter says of a counted key is exact.  Every change writes a new folder
    and leaves the old one as it is: taking documents out again, or reading the old folder, restores their lines.
    """

    spark: SparkSession
    path: str
    bits: int
    documents: int
    code_points: int

    @classmethod
    def empty(cls, spark: SparkSession, *, documents: int = DOCUMENTS, code_points: int = CODE_POINTS, path: str | None = None) -> LineIndex:
        """An index without documents.  A ``path`` keeps it; else it goes when the driver's JVM ends."""
        made = cls(spark, path or new_shared_path(spark, "lines"), 0, documents, code_points)
        made._write(spark.createDataFrame([], "key binary, n long"), spark.createDataFrame([], "shard int, slots binary, wrong binary"))
        return made

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LineIndex:
        return cls(spark, path, *spark.read.schema(_PARAMETERS).parquet(f"{path}/parameters").first())

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("key binary, n long").parquet(f"{self.path}/counts")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, slots binary, wrong binary").parquet(f"{self.path}/filters")

    def _write(self, counts: DataFrame, filters: DataFrame) -> None:
        """Parameters come last: a folder that has them is whole."""
        counts.write.option("compression", "zstd").parquet(f"{self.path}/counts")
        filters.write.option("compression", "zstd").parquet(f"{self.path}/filters")
        self.spark.createDataFrame([(self.bits, self.documents, self.code_points)], _PARAMETERS).coalesce(1).write.parquet(f"{self.path}/parameters")

    def _changed(self, docs: DataFrame, text_col: str, sign: int, path: str | None) -> LineIndex:
        with scratch(self.spark) as stage:
            change = _counts(docs, text_col, self.code_points).withColumnRenamed("n", "d")
            joined = self.counts.join(change, "key", "full_outer").select("key", F.coalesce("n", F.lit(0)).alias("before"), F.coalesce("d", F.lit(0)).alias("d"))
            rows = stage(joined.select("key", "before", (F.col("before") + sign * F.col("d")).alias("now")), "line-counts")
            least, total = rows.agg(F.min("now"), F.count_if(F.col("now") > 0)).first()
            if (least or 0) < 0:
                raise ValueError("documents to take out are not in the index")
            bits = max(self.bits, int(np.ceil(np.log2(max(1, total) / SHARD_KEYS))), 4)
            made = LineIndex(self.spark, path or new_shared_path(self.spark, "lines"), bits, self.documents, self.code_points)
            documents = self.documents
            # Shards of another number have other keys: their filters are made anew.
            old = self.filters if bits == self.bits else self.filters.limit(0)

            def change_shard(keys: pa.Table, filters: pa.Table) -> pa.Table:
                own = np.frombuffer(b"".join(keys.column("key").to_pylist()), _KEY)
                before, now = (keys.column(c).to_numpy().astype(np.int64) for c in ("before", "now"))
                slots, wrong = changed_filter(filters.column("slots")[0].as_py() if len(filters) else None, own, before, now, documents)
                return pa.table({"shard": pa.array(keys.column("shard")[:1].to_pylist(), pa.int32()), "slots": pa.array([slots], pa.binary()), "wrong": pa.array([wrong.tobytes()], pa.binary())})

            held = rows.withColumn("shard", _shard(bits)).groupBy("shard").cogroup(old.groupBy("shard"))
            # A shard whose keys have all gone has rows here too, with counts of zero.
            made._write(rows.where("now > 0").select("key", F.col("now").alias("n")), held.applyInArrow(change_shard, "shard int, slots binary, wrong binary"))
        return made

    def inserted(self, docs: DataFrame, text_col: str = "text", *, path: str | None = None) -> LineIndex:
        """The index with the documents of ``docs``, each row one, put in."""
        return self._changed(docs, text_col, 1, path)

    def deleted(self, docs: DataFrame, text_col: str = "text", *, path: str | None = None) -> LineIndex:
        """The index with the documents of ``docs`` taken out; a ``ValueError`` if some line was in fewer documents."""
        return self._changed(docs, text_col, -1, path)

    def cleaned(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """``keep`` columns of documents that are in the index, with ``text, n_lines, n_dropped``.

        A line is a stretch between line feeds; its key is the line without outer ASCII white space and with A-Z
        lower-cased.  All lines of keys that ``documents`` or more documents hold are dropped, the rest are joined as
        they were.  Lines whose key has fewer than ``code_points`` characters stay.

        Filters of up to ``FILTER_BYTES`` are broadcast and no line is shuffled.  Beyond that documents are written with
        row numbers and their lines are joined with the counts, a line's documents being dealt over ``SALTS`` keys.

        A null text counts as one empty line and stays null; each row is a document, repeated ones too; null ids are
        kept; an empty table gives no rows.  Only the named columns are read.
        """
        text = F.col(text_col).cast("binary")
        size = self.filters.agg(F.sum(F.octet_length("slots") + F.octet_length("wrong"))).first()[0] or 0
        if size <= FILTER_BYTES:
            rows = [(r["shard"], bytes(r["slots"]), bytes(r["wrong"])) for r in self.filters.collect()]
            shared = self.spark.sparkContext.broadcast(Filters(self.bits, rows))
            return docs.select(*keep, _cleaned_by(shared, self.code_points)(text).alias("_x")).select(*keep, "_x.*")
        numbered = staged(docs.select(F.struct(*keep).alias("kept"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
        least = self.code_points

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column(0), batch.column(1), strict=True):
                    keys = list(set(line_keys((text.as_py() or b"").split(b"\n"), least)) - {None})
                    yield pa.record_batch({"row": pa.array([row.as_py()] * len(keys), pa.int64()), "key": pa.array(keys, pa.binary())})

        lines = numbered.select("row", "text").mapInArrow(keyed, "row long, key binary").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        repeated = self.counts.where(F.col("n") >= self.documents).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dropped = lines.join(repeated, ["key", "salt"], "left_semi").groupBy("row").agg(F.collect_list("key").alias("keys"))
        return numbered.join(dropped, "row", "left").select("kept", _cleaned_of(F.col("text"), F.col("keys"), least).alias("_x")).select("kept.*", "_x.*")


def deduplicated_lines(docs: DataFrame, keep: list[str], text_col: str = "text", *, documents: int = DOCUMENTS, code_points: int = CODE_POINTS) -> DataFrame:
    """:meth:`LineIndex.cleaned` of all ``docs`` by an index of themselves."""
    index = LineIndex.empty(docs.sparkSession, documents=documents, code_points=code_points)
    return index.inserted(docs, text_col).cleaned(docs, keep, text_col)
