"""Files of any size read by range, and digests of what comes in chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes read at least at once, and bytes of a chunk.
AHEAD, CHUNK = 1 << 16, 4 << 20


class Ranges(Protocol):
    """What can be read by range: its size, and up to ``n`` bytes from ``offset``."""

    size: int

    def peek(self, offset: int, n: int) -> bytes: ...


class Held:
    """Bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def peek(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]


class Opened:
    """A file, of which a stretch is held: walks over small heads that are near each other read once."""

    def __init__(self, path: str) -> None:
        local = re.sub(r"^file:/+", "/", path)
        system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/@%"))
        self.file = system.open_input_file(name)
        self.size, self.begin, self.held = self.file.size(), 0, b""

    def peek(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0 or offset < 0:
            return b""
        if not self.begin <= offset <= offset + n <= self.begin + len(self.held):
            own = self.file.read_at(min(max(n, AHEAD), self.size - offset), offset)
            if n > AHEAD:
                return own
            self.begin, self.held = offset, own
        return self.held[offset - self.begin : offset - self.begin + n]

    def chunks(self) -> Iterator[bytes]:
        for offset in range(0, self.size, CHUNK):
            yield self.file.read_at(min(CHUNK, self.size - offset), offset)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def joined(file: Ranges, ranges: list[dict]) -> bytes:
    """The bytes of ``(offset, length)`` ranges, one after the other."""
    return b"".join(file.peek(r["offset"], r["length"]) for r in ranges)


def file_sha256(path: Column) -> Column:
    """SHA-256 of files of any size, read once from start to end in chunks; null paths give null."""

    @F.arrow_udf("string")
    def of(paths: pa.Array) -> pa.Array:
        out = []
        for path in paths.to_pylist():
            own = hashlib.sha256()
            if path is not None:
                with Opened(path) as file:
                    for chunk in file.chunks():
                        own.update(chunk)
            out.append(None if path is None else own.hexdigest())
        return pa.array(out, pa.string())

    return of(path)


def chunk_digests(chunks: DataFrame, key: str = "track_id", order: str = "chunk_no", data: str = "data") -> DataFrame:
    """``(key, n_chunks, n_bytes, sha256)`` of what the chunks of a key make in their order.

    Chunks are dealt by key and sorted within their partition, which Spark spills; each partition is then folded as it
    streams by, so a task holds one batch and one running digest, whatever the size of a key.  A digest cannot be put
    together from parts, so a key is one task's.

    Null data are no bytes; a null key is a key; chunks of equal order go by their bytes; an empty table gives no rows.
    """
    key_type = dict(chunks.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, size, digest = None, 0, 0, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{key: now, "n_chunks": count, "n_bytes": size, "sha256": digest.hexdigest()}], schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([(key, batch.schema.field(0).type), ("n_chunks", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
            for own, piece in zip(batch.column(0), batch.column(1), strict=True):
                if count and own.as_py() != now:
                    yield row()
                    count, size, digest = 0, 0, hashlib.sha256()
                piece = piece.as_py() or b""
                now, count, size = own.as_py(), count + 1, size + len(piece)
                digest.update(piece)
        if count:
            yield row()

    ordered = chunks.repartition(key).sortWithinPartitions(key, order, data).select(key, F.col(data).cast("binary").alias("data"))
    return ordered.mapInArrow(fold, f"`{key}` {key_type}, n_chunks long, n_bytes long, sha256 string")


def cut(content: Column, size: int) -> Column:
    """Array of ``(chunk_no, data)``: bytes in pieces of ``size``; no bytes are one empty piece."""
    count = F.greatest(F.ceil(F.octet_length(content) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), F.substring(content, i * size + 1, F.lit(size)).alias("data")))
