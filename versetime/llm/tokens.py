"""Token ids in binary files: fixed-width bit packing in blocks, with an index for random access.

A file is a sequence of sections, each followed by one line feed (byte 10), as Spark's text writer puts them
down: a header, blocks of ``BLOCK_IDS`` ids (the last may be shorter), and the index.

* header: magic ``VTOK``, then ``<BxHI``: bits an id, zero, format version, number of the file;
* block: its ids, each in ``bits`` bits, lowest bit first, filled up with zero bits to a whole byte;
* index: ``<q`` arrays of block offsets, document ids, document starts (ids of the file before the document)
  and null flags, then ``<IQQQ4s``: ids a block, number of blocks, documents and ids, and the magic.

Files are read through Spark, so any store that Spark reaches will do, and the output committer removes what
a lost executor had half written.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC, VERSION = b"VTOK", 1
HEADER, TRAILER = struct.Struct("<4sBxHI"), struct.Struct("<IQQQ4s")
BLOCK_IDS = 1 << 16
#: Units whose ids an encoder remembers in each of two generations, characters of a text encoded at once, and
#: bytes of ids in a batch that a task returns.
REMEMBERED, SLICE_CHARS, BATCH_BYTES = 300_000, 1 << 18, 4 << 20
#: Bytes of text in a file, on average, at most.
FILE_BYTES = 128 << 20


def bits_needed(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(block: bytes | memoryview, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block, without reading the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(block, f"<u{bits // 8}", end - begin, begin * bits // 8).astype("<u4")
    at = np.arange(begin, end, dtype=np.int64) * bits
    low = begin * bits // 8
    own = np.frombuffer(bytes(block[low : (end * bits + 7) // 8]) + bytes(8), np.uint8)
    word = np.zeros(len(at), np.uint64)
    for i in range((bits + 14) // 8):
        word |= own[(at >> 3) - low + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts by a ``tokenizers`` file, with the ids of recurring words remembered.

    The pattern of a byte-level tokenizer never joins a character that isn't white space to white space after
    it, nor a letter to punctuation after it, so a text may be cut before any single blank or line feed
    between such characters, and its ids are those of the parts.  Words of letters alone are one piece each
    and go to the model at once; other parts, texts with other white space, and all texts of tokenizers of
    another kind are encoded as they are.  A special token's string in a text gets the token's id, as the
    library gives it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.by_word = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and kind["normalizer"] is None and not any(self._spans_units(x) for x in kind["added_tokens"])
        )
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _spans_units(token: dict) -> bool:
        """Whether an added token may take in white space, or stand in what goes to the model at once."""
        text = token["content"]
        return token["lstrip"] or token["rstrip"] or len(text.split()) != 1 or text != text.strip() or all(c.isalpha() or c in ".,;:!?" for c in text)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, text: str) -> bytes:
        """Ids of one piece of the pattern."""
        shown = text.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a part of a text: with a blank before it, or a line feed, or neither where it begins with NUL."""
        first, core = unit[:1], unit
        lead = " "
        if first in ("\n", "\0"):
            lead, core = "", unit[1:]
        word = core.rstrip(".,;:!?")
        if not word.isalpha():
            return self._whole(unit if first == "\n" else lead + core)
        ids = self._piece(lead + word)
        if len(word) < len(core):
            ids += self._remembered(core[len(word) :])
        return self._remembered("\n") + ids if first == "\n" else ids

    def _remembered(self, mark: str) -> bytes:
        key = "\0" + mark
        if key not in self.new:
            self.new[key] = self.old.get(key) or self._piece(mark)
        return self.new[key]

    def __call__(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids of a text, by slices of bounded length."""
        at = 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + SLICE_CHARS) if self.by_word else None
            stop = cut.start() if cut else len(text)
            yield self._slice(text[at:stop], at > 0)
            at = stop

    def _slice(self, text: str, later: bool) -> bytes:
        own = text[1:] if later else text
        if not self.by_word or "\0" in own or len(own.split()) != own.count(" ") + own.count("\n") + 1:
            return self._whole(text)
        units = own.replace("\n", " \n").split(" ")
        if not later:
            units[0] = "\0" + units[0]
        found = list(map(self.new.get, units))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[i]
            ids = self.new.get(unit) or self.old.get(unit) or self._unit(unit)
            self.new[unit] = found[i] = ids
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new
        return b"".join(found)


#: A blank between two characters that are not white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _sections(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The sections of a partition's file, from rows (doc_id, text) in their order."""
    encode, begun = _encoder(tokenizer), False
    offsets, ids, starts, nulls = [], array("q"), array("q"), array("q")
    at, total, waiting, held = HEADER.size + 1, 0, [], 0
    end = struct.pack("<I", end_id)

    def blocks(last: bool) -> Iterator[bytes]:
        nonlocal waiting, held, at
        own = np.frombuffer(b"".join(waiting), "<u4")
        whole = len(own) if last else len(own) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            section = pack(own[i : min(whole, i + BLOCK_IDS)], bits)
            offsets.append(at)
            at += len(section) + 1
            yield section
        waiting = [own[whole:].tobytes()]
        held = len(waiting[0])

    def out(sections: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch({"section": pa.array(sections, pa.binary())})

    for batch in batches:
        if batch.num_rows and not begun:
            yield out([HEADER.pack(MAGIC, bits, VERSION, TaskContext.get().partitionId())])
            begun = True
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc = doc.as_py()
            ids.append(doc or 0)
            nulls.append(doc is None)
            starts.append(total)
            for part in encode(text.as_py() or ""):
                waiting.append(part)
                held += len(part)
                total += len(part) // 4
                if held >= 16 * BLOCK_IDS:
                    yield out(list(blocks(False)))
            waiting.append(end)
            held += 4
            total += 1
    if begun:
        yield out(list(blocks(True)))
        index = np.array(offsets, "<i8").tobytes() + b"".join(np.array(x, "<i8").tobytes() for x in (ids, starts, nulls))
        yield out([index + TRAILER.pack(BLOCK_IDS, len(offsets), len(ids), total, MAGIC)])


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of id to files in ``path``.

    Rows are dealt out by ranges of the id (and of a hash of the text, so that an id that repeats very often
    does not fill one file), one file a range, as many as the session's shuffles have partitions or, for more text,
    one for each ``file_bytes``.  Null texts are empty (one end id); null ids come first;
    repeated rows are each written; an empty table leaves no files.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // file_bytes))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    bits = bits_needed(vocabulary)
    sections = ranged.select("doc_id", "text").mapInArrow(lambda own: _sections(own, tokenizer, end_id, bits), "section binary")
    sections.select(F.col("section").cast("string")).write.text(path)


@dataclass
class TokenFile:
    """One file's content: header, index and random access to ids."""

    content: memoryview

    def __post_init__(self) -> None:
        magic, self.bits, version, self.number = HEADER.unpack_from(self.content, 0)
        end = len(self.content) - 1
        self.block_ids, blocks, docs, self.total, closing = TRAILER.unpack_from(self.content, end - TRAILER.size)
        if magic != MAGIC or closing != MAGIC or version != VERSION:
            raise ValueError("not a whole token file")
        at = end - TRAILER.size - 8 * (blocks + 3 * docs)
        index = np.frombuffer(self.content[at : end - TRAILER.size], "<i8")
        self.offsets, rest = index[:blocks], index[blocks:]
        self.doc_ids, self.starts, nulls = rest[:docs], rest[docs : 2 * docs], rest[2 * docs :]
        self.null = nulls.astype(bool)
        self.stops = np.append(self.starts[1:], self.total)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the file, from the blocks that hold them alone."""
        out = [np.zeros(0, "<u4")]
        for b in range(begin // self.block_ids, -(-end // self.block_ids)):
            first = b * self.block_ids
            block = self.content[int(self.offsets[b]) :]
            out.append(unpack(block, self.bits, max(begin, first) - first, min(end, first + self.block_ids) - first))
        return np.concatenate(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            file = TokenFile(memoryview(content.as_buffer()))
            at, docs = 0, len(file.doc_ids)
            while at < docs:
                stop = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + BATCH_BYTES // 4)))
                own = memoryview(file.ids(int(file.starts[at]), int(file.stops[stop - 1])).tobytes())
                edge = np.append(file.starts[at:stop], file.stops[stop - 1]) - file.starts[at]
                yield pa.record_batch({
                    "file": pa.array(np.full(stop - at, file.number)), "position": pa.array(np.arange(at, stop)),
                    "doc_id": pa.array(file.doc_ids[at:stop], mask=file.null[at:stop]), "file_start": pa.array(file.starts[at:stop]),
                    "ids": pa.Array.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer((edge * 4).astype("<i8")), pa.py_buffer(own)]),
                })
                at = stop


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files in ``path``: ``(file, position, doc_id, file_start, ids)``.

    ``file`` counts files in the order of their documents, ``position`` documents in their file,
    ``file_start`` the file's ids before the document; ``ids`` are little-endian unsigned 32-bit integers.
    """

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_documents, "file long, position long, doc_id long, file_start long, ids binary")


def with_global_start(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before it, to staged rows ``(file, file_start, n_tokens, ...)``.

    One row a file is summed up in order; the rows themselves are joined to those sums.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("own"))
    before = totals.select("file", (F.sum("own").over(Window.orderBy("file")) - F.col("own")).alias("before"))
    return rows.join(before, "file").withColumn("start", F.col("before") + F.col("file_start"))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
