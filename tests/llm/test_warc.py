import hashlib

import pytest
from pyspark.sql import functions as F

from versetime.llm import warc
from versetime.llm.queries import archived_pages


def test_framing():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n", bytes(range(256)) * 200):
        assert warc.dechunked(warc.chunked(payload)) == payload
    assert warc.dechunked(b"3;a=b\r\nabc\r\n0\r\nT: x\r\n\r\n") == b"abc"
    assert warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.dechunked(b"") is None and warc.dechunked(b"zz\r\n") is None
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and warc.http_payload(b"no head") is None


def segment(number, block, origin="<a>", total=None, name="<b>"):
    fields = {"WARC-Type": "response" if number == 1 else "continuation", "WARC-Record-ID": origin if number == 1 else name, "WARC-Segment-Number": number}
    fields |= {"X-Page-ID": 5} if number == 1 else {"WARC-Segment-Origin-ID": origin}
    return warc._record(fields | ({"WARC-Segment-Total-Length": total} if total else {}), block)


@pytest.mark.parametrize(("order", "total", "whole"), [((3, 1, 2), 0, True), ((1, 2, 3, 2), 0, True), ((1, 3), 0, False), ((2, 3), 0, False), ((1, 2, 3), 1, False), ((1, 2), 0, False)])
def test_segments_over_several_files(spark, tmp_path, order, total, whole):
    block = warc._HTTP + warc.chunked(b"payload " * 40)
    parts = {1: block[:50], 2: block[50:90], 3: block[90:]}
    for k, n in enumerate(order):
        (tmp_path / f"{k}.warc").write_bytes(segment(n, parts[n], total=len(block) + total if n == 3 else None) + b"\r\n\r\n")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.whole, bytes(r.payload) if r.payload else None) for r in rows] == [(whole, b"payload " * 40 if whole else None)]


def test_a_file_cut_short(spark, tmp_path):
    own = warc._record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "X-Page-ID": 1}, warc._HTTP + warc.chunked(b"abc"))
    (tmp_path / "a.warc").write_bytes(own + b"\r\n\r\n" + own[:-9])
    assert sorted((r.whole, r.payload is not None) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [(False, False), (True, True)]


def test_pages_there_and_back(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 20_000
    data = [(4, "u v\nw", long), (9, None, long), (4, "u", long), (2, "a", None), (None, "n", long), (3, "b", ""), (8, "c", "short"), (7, "c", "short"), (6, "d", "y" * 100), (5, "d", "y" * 100), (10, "e", "z" * 99), (11, "e", "z" * 99)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "page_id long, url string, html string, digest string, payload int")
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived_pages(df).collect()), key=str)
    first = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        at = first.get(h)
        revisit = at is not None and i is not None and i > at
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", at if revisit else None))
    assert found == sorted(want, key=str)
    assert archived_pages(df.limit(0)).count() == 0


def test_segments_are_written(spark, tmp_path):
    df = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("q"), 1000).alias("html"))
    warc.write_warc(df, str(tmp_path / "w"), segment_bytes=64)
    row = warc.read_warc(spark, str(tmp_path / "w")).first()
    assert row.whole and bytes(row.payload) == b"q" * 1000


def test_archives_are_bounded(spark, tmp_path):
    df = spark.range(300, numPartitions=2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("q"), (F.col("id") % 50).cast("int") * 10).alias("html"))
    warc.write_warc(df, str(tmp_path / "w"), archive_records=20, segment_bytes=128)
    assert len(list((tmp_path / "w").glob("part-*"))) > 15
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in rows) == list(range(300)) and all(r.whole or r.kind == "revisit" for r in rows)
