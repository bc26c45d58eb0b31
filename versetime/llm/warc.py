"""WARC archives: pages written as response and revisit records, and read back with segments put together.

Archives are gzip files of WARC/1.1 records.  A record longer than a segment goes on in continuation records;
payloads are HTTP bodies in chunked transfer framing.  Both directions go through Spark's own file readers
and writers, so archives can be in any store that Spark reaches and a lost executor leaves no half of a file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetime.llm.common import staged

#: Bytes of a record's block in one segment, of one chunk of the transfer framing, and of records that a task
#: returns at once or reads from a compressed file at once.
SEGMENT_BYTES, CHUNK_BYTES, BATCH_BYTES = 64 << 10, 8 << 10, 4 << 20
#: Records of one archive at most: with their segments' bound, 512 MiB before compression.
ARCHIVE_RECORDS = 8192
#: Equal payloads of fewer bytes are not referred to.
LEAST_REVISIT_BYTES = 100
#: Field for the number of the page that a record holds, and of that which a revisit refers to.
PAGE_FIELD, REFERS_FIELD = "X-Page-ID", "X-Refers-To-Page-ID"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORDS = "record string, kind string, page_id long, refers_to long, digest string, origin string, segment int, total long, block binary"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends that close it, which the text writer puts between rows."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        own = payload[at : at + CHUNK_BYTES]
        parts += (b"%x\r\n" % len(own), own, b"\r\n")
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked transfer framing; chunk extensions and trailers are passed over; None if broken."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:stop]) if stop >= 0 else None
        if not size:
            return None
        n = int(size[1], 16)
        if not n:
            return b"".join(parts)
        if body[stop + 2 + n : stop + 4 + n] != b"\r\n":
            return None
        parts.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; None if its framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _written(batches: Iterator[pa.RecordBatch], segment_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, payload, digest, refers_to) as records; a file begins with its warcinfo."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    out, size, info = [], 0, name()
    out.append(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": info, "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
    begun = False
    for batch in batches:
        for page, url, payload, digest, refers in zip(*batch.columns, strict=True):
            page, url, payload, digest, refers = (x.as_py() for x in (page, url, payload, digest, refers))
            begun, own = True, name()
            fields = {
                "WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Warcinfo-ID": info,
                "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
                "WARC-Payload-Digest": f"sha256:{digest}", PAGE_FIELD: page, REFERS_FIELD: refers, "Content-Type": "application/http;msgtype=response",
            }
            if refers is not None:
                fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                out.append(_record(fields, _HTTP))
                size += len(out[-1])
            else:
                block = _HTTP + chunked(payload)
                last = max(0, len(block) - 1) // segment_bytes
                for k in range(last + 1):
                    more = {"WARC-Segment-Number": k + 1} if last else {}
                    if k:
                        more = {"WARC-Type": "continuation", "WARC-Record-ID": name(), "WARC-Date": date, "WARC-Segment-Origin-ID": own} | more
                    if k and k == last:
                        more["WARC-Segment-Total-Length"] = len(block)
                    out.append(_record(more if k else fields | more, block[k * segment_bytes : (k + 1) * segment_bytes]))
                    size += len(out[-1])
            if size >= BATCH_BYTES:
                yield pa.record_batch({"record": pa.array(out, pa.binary())})
                out, size = [], 0
    if begun and out:
        yield pa.record_batch({"record": pa.array(out, pa.binary())})


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES, least_revisit_bytes: int = LEAST_REVISIT_BYTES, date: str = "2020-01-01T00:00:00Z", archive_records: int = ARCHIVE_RECORDS,
) -> None:
    """Write one record per page, or several segments, to gzip archives in ``path``, at most ``archive_records`` each.

    Of pages with equal payloads of at least ``least_revisit_bytes``, that with the smallest id is a response
    and the others revisit it.  Null markup is an empty payload; a null id or url leaves out its field; pages
    with a null id, and all that share the smallest id, are responses; repeated rows are each written; an
    empty table leaves no archive.  Other columns are not read.

    Which digests repeat is a narrow table that is written first, so Spark knows its size: a small one is
    broadcast and pages are written where they are read; only beyond the threshold are pages shuffled by digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_revisit_bytes
    repeated = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = staged(repeated, "repeated-digests")
    rows = rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    records = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda own: _written(own, segment_bytes, date), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)


class _Stream:
    """A file's bytes, decompressed as they are asked for."""

    def __init__(self, content: memoryview) -> None:
        self.content, self.at, self.buffer = content, 0, bytearray()
        self.packed = bytes(content[:2]) == b"\x1f\x8b"
        self.unpacker = zlib.decompressobj(31)

    def fill(self, n: int) -> bool:
        """Whether the buffer now holds n bytes."""
        while len(self.buffer) < n and self.at < len(self.content):
            own = bytes(self.content[self.at : self.at + (256 << 10)])
            self.at += len(own)
            if not self.packed:
                self.buffer += own
            while self.packed and own:
                self.buffer += self.unpacker.decompress(own)
                own = self.unpacker.unused_data
                if self.unpacker.eof:
                    self.unpacker = zlib.decompressobj(31)
        return len(self.buffer) >= n

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (stop := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill(seen + 1):
                return None
        return self.take(stop + len(mark))

    def take(self, n: int) -> bytes | None:
        if not self.fill(n):
            return None
        own = bytes(self.buffer[:n])
        del self.buffer[:n]
        return own


def records_of(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields in lower case, block) of each record of an archive; block None where the file ends too early."""
    stream = _Stream(memoryview(content))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, stream.take(int(fields.get("content-length", 0)))


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _parsed(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for fields, block in records_of(memoryview(content.as_buffer())):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit", "continuation") or ("warc-segment-number" in fields) != segmented:
                    continue
                rows.append((
                    fields.get("warc-record-id"), kind, _number(fields.get(PAGE_FIELD.lower())), _number(fields.get(REFERS_FIELD.lower())),
                    fields.get("warc-payload-digest", "").rpartition(":")[2] or None, fields.get("warc-segment-origin-id"),
                    _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length")), block,
                ))
                size += len(block or b"") + 200
                if size >= BATCH_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def _decoded(parts: Column) -> Column:
    @F.pandas_udf("binary")
    def decode(blocks: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or any(x is None for x in b) else http_payload(b"".join(b)) for b in blocks], dtype=object)

    return decode(parts)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives in ``path``: ``(record, kind, page_id, refers_to, digest, whole, payload)``.

    Segments are grouped by the record where they begin and put in order of their number.  A record is
    ``whole`` if its numbers run from one without gap and its length is the stated total; otherwise, and where
    the transfer framing is broken, its payload is null.  A segment that occurs twice counts once.  Payloads
    of revisits are null: see :func:`resolved`.  One record's segments are the most that a task gathers, and
    only records in segments are shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    single = files.mapInArrow(lambda own: _parsed(own, False), _RECORDS).where("kind <> 'continuation'")
    part = F.struct("segment", "block")
    parts = files.mapInArrow(lambda own: _parsed(own, True), _RECORDS).withColumn("record", F.coalesce("origin", "record"))
    joined = parts.groupBy("record").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "refers_to", "digest")),
        F.max("total").alias("total"), F.array_sort(F.array_distinct(F.collect_list(part))).alias("parts"),
    )
    length = F.expr("aggregate(parts, 0L, (n, x) -> n + coalesce(octet_length(x.block), 0))")
    whole = (F.expr("parts[0].segment = 1") & (F.expr("parts[size(parts) - 1].segment") == F.size("parts")) & (length == F.col("total"))) & F.col("kind").isNotNull()
    names = ["record", "kind", "page_id", "refers_to", "digest"]
    rows = single.select(*names, F.col("block").isNotNull().alias("whole"), F.array("block").alias("blocks")).unionByName(
        joined.select(*names, F.coalesce(whole, F.lit(False)).alias("whole"), F.expr("transform(parts, x -> x.block)").alias("blocks"))
    )
    blocks = F.when(F.col("whole") & (F.col("kind") == "response"), F.col("blocks"))
    return rows.select(*names, "whole", _decoded(blocks).alias("payload"))


def resolved(records: DataFrame) -> DataFrame:
    """Give revisits the length and digest of the payload they refer to.

    ``records(page_id, kind, refers_to, digest, payload_bytes, payload_digest)`` are staged rows of
    :func:`read_warc`, the last two measured from the payload and null for revisits.  A revisit's digest
    field names its payload; without a response of that digest its length is null.
    """
    known = records.where("kind = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("known_bytes"))
    revisits = records.where("kind = 'revisit'").join(known, "digest", "left")
    names = ["page_id", "kind", "refers_to"]
    return records.where("kind = 'response'").select(*names, "payload_bytes", "payload_digest").unionByName(
        revisits.select(*names, F.col("known_bytes").alias("payload_bytes"), F.when(F.col("known_bytes").isNotNull(), F.col("digest")).alias("payload_digest"))
    )
