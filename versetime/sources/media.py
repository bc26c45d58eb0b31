"""Media files and lyric texts as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetime.functions.text import display_name, is_blank, let, trimmed, utf16_length
from versetime.operators.lrc import LINES, lrc_lines
from versetime.sources import containers
from versetime.sources.ranges import Held, Opened, file_sha256

#: Files whose lyrics a task gives on at once.
SLICE = 64
_TIMED = pa.list_(pa.struct([("start_ms", pa.int64()), ("text", pa.string())]))
_CANDIDATES = pa.list_(pa.struct([("text", pa.string()), ("source", pa.string()), ("tag", pa.string()), ("timed", _TIMED)]))
_CANDIDATES_DDL = f"array<struct<text:string,source:string,tag:string,timed:{LINES}>>"
_SCAN = pa.struct([("container", pa.string()), ("candidates", _CANDIDATES), ("warnings", pa.list_(pa.string()))])
_BLOCK = pa.struct([("source", pa.string()), ("kind", pa.string()), ("tag", pa.string()), ("ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
_WALK = pa.struct([("container", pa.string()), ("warnings", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK))])
_WALK_DDL = "struct<container:string,warnings:array<string>,blocks:array<struct<source:string,kind:string,tag:string,ranges:array<struct<offset:long,length:long>>>>>"


def _opened(raw: bytes | str):
    """What a column holds, bytes or the path of a file, to be read by range."""
    return Opened(raw) if isinstance(raw, str) else nullcontext(Held(raw))


def walked(media: Column) -> Column:
    """``(container, warnings, blocks)`` of each file: where its tags are, by the heads of its structures alone.

    ``media`` is a file's bytes, or its path, of which only the heads are read.  Null gives null.
    """

    @F.arrow_udf(_WALK_DDL)
    def of(files: pa.Array) -> pa.Array:
        out = []
        for raw in files:
            if not raw.is_valid:
                out.append(None)
                continue
            with _opened(raw.as_py()) as file:
                container, blocks, warnings = containers.walk(file)
            rows = [b._asdict() | {"ranges": [{"offset": o, "length": n} for o, n in b.ranges]} for b in blocks]
            out.append({"container": container, "warnings": warnings, "blocks": rows})
        return pa.array(out, _WALK)

    return of(media)


def tag_candidates(media: Column, blocks: Column) -> Column:
    """Lyric candidates ``(text, source, tag, timed)`` of the tags ``blocks`` of each file; only those tags are read."""

    @F.arrow_udf(_CANDIDATES_DDL)
    def of(files: pa.Array, tags: pa.Array) -> pa.Array:
        out = []
        for raw, own in zip(files, tags, strict=True):
            if not raw.is_valid or not own.is_valid:
                out.append(None)
                continue
            found = []
            with _opened(raw.as_py()) as file:
                for b in own.as_py():
                    block = containers.Block(b["source"], b["kind"], b["tag"], [(r["offset"], r["length"]) for r in b["ranges"]])
                    found += _found(file, block)
            out.append(found)
        return pa.array(out, _CANDIDATES)

    return of(media, blocks)


def _found(file, block: containers.Block) -> list[dict]:
    """Candidates of a tag."""
    return [
        {"text": text, "source": block.source, "tag": name, "timed": None if timed is None else [{"start_ms": t, "text": x} for t, x in timed]}
        for name, text, timed in containers.lyrics(file, block)
    ]


def _scan(media: Column) -> Column:
    """:func:`walked` and :func:`tag_candidates` in one reading, given on by ``SLICE`` files, so that a task holds a batch and the texts of a slice."""

    @F.arrow_udf(f"struct<container:string,candidates:{_CANDIDATES_DDL},warnings:array<string>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            for first in range(0, len(files), SLICE):
                out = []
                for raw in files.slice(first, SLICE):
                    if not raw.is_valid:
                        out.append(None)
                        continue
                    with _opened(raw.as_py()) as file:
                        container, blocks, warnings = containers.walk(file)
                        out.append({"container": container, "candidates": [c for b in blocks for c in _found(file, b)], "warnings": warnings})
                yield pa.array(out, _SCAN)

    return of(media)


def scanned(rows: DataFrame, media: Column, name: str = "scan") -> DataFrame:
    """``rows`` with ``(container, candidates, warnings)`` of each file's bytes or path as a column."""
    return rows.withColumn(name, _scan(media))


def kept_candidates(candidates: Column) -> Column:
    """Candidates with text, trimmed and timed, and only the first of each source, tag and text."""
    ready = F.transform(
        candidates,
        lambda c: F.struct(
            trimmed(c["text"]).alias("text"), c["source"].alias("source"), c["tag"].alias("tag"), F.coalesce(c["timed"], lrc_lines(trimmed(c["text"]))).alias("timed")
        ),
    )
    key = lambda c: F.struct(c["source"], c["tag"], c["text"])
    first = lambda own: let(F.transform(own, key), lambda keys: F.filter(own, lambda c, i: F.array_position(keys, key(c)) == i + 1))
    return let(F.filter(ready, lambda c: c["text"] != ""), first)


def best_candidate(candidates: Column) -> Column:
    """The first of the candidates that are timed, if any is, and longest."""
    ranked = F.transform(candidates, lambda c, i: F.struct((F.size(c["timed"]) > 0).alias("timed"), utf16_length(c["text"]).alias("length"), (-i).alias("order"), c.alias("candidate")))
    return F.array_max(ranked)["candidate"]


def image_mime(content: Column) -> Column:
    """PNG or WebP by their first bytes, else JPEG."""
    part = lambda a, n: F.hex(F.substring(content, a, n))
    return F.when(part(1, 8) == "89504E470D0A1A0A", "image/png").when((part(1, 4) == "52494646") & (part(9, 4) == "57454250"), "image/webp").otherwise("image/jpeg")


def container_name(content: Column) -> Column:
    """The container by its first bytes, without a look at the rest."""
    first = lambda text, at=1: F.hex(F.substring(content, at, len(text))) == text.encode().hex().upper()
    return (
        F.when(first("ID3"), "MP3 / ID3").when(first("fLaC"), "FLAC").when(first("OggS"), "Ogg / Opus").when((F.octet_length(content) >= 12) & first("ftyp", 5), "MP4 / M4A")
        .when(first("RIFF") | first("RF64"), "WAV / RIFF").otherwise("Audio")
    )


def media_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(track_id, file_name, size_bytes)`` of the files in ``path``: Spark's listing, none of their bytes.

    Files without any bytes give no row, as Spark's scan passes over them.  Files are dealt over tasks by their sizes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.lit("audio"))
    return files.select(F.col("path").alias("track_id"), name.alias("file_name"), F.col("length").alias("size_bytes"))


def tag_rows(files: DataFrame) -> DataFrame:
    """``(track_id, container, tag_no, source, kind, tag, offset, length, n_ranges)`` of the tags in ``files(track_id)``, by path.

    A tag in several ranges, as over the pages of an Ogg stream, has the first's offset and the length of all.
    """
    rows = files.select("track_id", walked(F.col("track_id")).alias("w")).select("track_id", "w.container", F.posexplode("w.blocks").alias("tag_no", "b"))
    length = F.aggregate("b.ranges", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return rows.select("track_id", "container", "tag_no", "b.source", "b.kind", "b.tag", F.get("b.ranges", F.lit(0))["offset"].alias("offset"), length.alias("length"), F.size("b.ranges").alias("n_ranges"))


def read_tracks(spark: SparkSession, path: str, *, pattern: str = "*", digest: bool = True) -> DataFrame:
    """``(track_id, file_name, size_bytes, sha256, container, warnings, candidates, best)`` of the media files in ``path``.

    Files of any size are read by range: the heads of their structures, then the tags that can hold lyrics, of
    ``TAG_BYTES`` each at most.  Their digest reads them once more in chunks; without ``digest`` it is null.  Executors
    open the files themselves, so ``path`` is local, or in a store that pyarrow can open.
    """
    found = scanned(media_files(spark, path, pattern), F.col("track_id")).withColumn("sha256", file_sha256(F.col("track_id")) if digest else F.lit(None).cast("string"))
    kept = found.select("track_id", "file_name", "size_bytes", "sha256", "scan.container", "scan.warnings", kept_candidates(F.col("scan.candidates")).alias("candidates"))
    return kept.withColumn("best", best_candidate(F.col("candidates")))


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    """``(track_id, text)`` of the text files in ``path``; blank ones are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track_id"), F.col("value").alias("text"))
    return files.where(~is_blank(F.col("text")))


def assets(lyrics: DataFrame, artwork: DataFrame) -> DataFrame:
    """Tracks with their artwork ``(track_id, artwork, duration_ms, size_bytes)``; a negative or missing size is the lyrics'."""
    art = artwork.select("track_id", "artwork", "duration_ms", F.col("size_bytes").alias("art_size"))
    return lyrics.join(art, "track_id", "left").withColumn("size_bytes", F.when(F.col("art_size") >= 0, F.col("art_size")).otherwise(F.col("size_bytes"))).drop("art_size")


def candidate_names(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: display_name(c["source"], c["tag"], F.size(c["timed"]) > 0))


def best_rows(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the best row of a table ``(…, cand_no, text, timed)``: timed first, then longest, then first.

    A maximum that is combined before the shuffle, whatever a key's number of rows.
    """
    rank = F.struct((F.size("timed") > 0).alias("a"), utf16_length(F.col("text")).alias("b"), (-F.col("cand_no")).alias("c"))
    others = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("best")).select(*keys, "best.*")


def first_of_equal(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first row, by ``cand_no``, of those that agree in ``keys``."""
    others = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*others), "cand_no").alias("first")).select(*keys, "first.*")
