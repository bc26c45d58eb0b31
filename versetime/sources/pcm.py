"""Files of 16-bit samples, one a track: written by tasks and shown when all have ended, and read by range."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from versetime.sources.ranges import CHUNK, Opened


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: hidden files, their tracks' files, and samples."""

    files: list[tuple[str, str, int]]


class PcmWriter(DataSourceArrowWriter):
    """Writes rows ``(track_id, chunk_no, samples)`` that come track by track, in order.

    A task writes files under a name of its own in a hidden folder, so attempts that fail or run twice are never seen.  The
    driver gives them their names when all tasks have ended, or takes the folder away.
    """

    def __init__(self, path: str) -> None:
        self.path, self.hidden = path.rstrip("/"), f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _store(self.path)
        folder = f"{base}/{self.hidden}"
        system.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            for track, samples in zip(batch.column("track_id"), batch.column("samples"), strict=True):
                name = f"{quote(str(track.as_py()), safe='')}.pcm"
                if not files or files[-1][1] != name:
                    if out:
                        out.close()
                    files.append((f"{folder}/{uuid.uuid4().hex}", name, 0))
                    out = system.open_output_stream(files[-1][0])
                data = samples.values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i2") if samples.is_valid else np.zeros(0, "<i2")
                out.write(data.tobytes())
                files[-1] = (*files[-1][:2], files[-1][2] + len(data))
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _store(self.path)
        system.create_dir(base, recursive=True)
        for own, name, _ in (f for m in messages if m for f in m.files):
            system.move(own, f"{base}/{name}")
        self._tidied()
        with system.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(f[2] for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._tidied()

    def _tidied(self) -> None:
        system, base = _store(self.path)
        if system.get_file_info(f"{base}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.hidden}")


class PcmFiles(DataSource):
    """``pcm16``: a sink for chunks of 16-bit samples."""

    @classmethod
    def name(cls) -> str:
        return "pcm16"

    def schema(self) -> str:
        return "track_id string, chunk_no long, samples array<smallint>"

    def writer(self, schema: StructType, overwrite: bool) -> PcmWriter:
        return PcmWriter(self.options["path"])


def write_pcm16(chunks: DataFrame, path: str, key: str = "track_id") -> None:
    """Write ``(track_id, chunk_no, samples)`` as little-endian 16-bit files in ``path``, ``<track_id>.pcm`` each.

    A track is one task's, chunk after chunk, so only a batch is held.  ``_SUCCESS`` has the number of all samples and is
    there only once all files are.  Files of a failed job are never seen.  Null chunks are empty, null samples silence;
    a null track is the file ``None.pcm``; an empty table leaves ``_SUCCESS`` alone.
    """
    chunks.sparkSession.dataSource.register(PcmFiles)
    rows = chunks.select(F.col(key).cast("string").alias("track_id"), F.col("chunk_no").cast("long").alias("chunk_no"), F.col("samples").cast("array<smallint>").alias("samples"))
    rows.repartition("track_id").sortWithinPartitions("track_id", "chunk_no").write.format("pcm16").mode("append").save(path)


def read_pcm16_files(spark: SparkSession, path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """``(track_id, chunk_no, n_samples, samples)`` of the files in ``path``, read by range, ``chunk_bytes`` at once."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                track = unquote(name.rsplit("/", 1)[-1].removesuffix(".pcm"))
                with Opened(name) as file:
                    for k, offset in enumerate(range(0, file.size, chunk_bytes)):
                        own = np.frombuffer(file.peek(offset, chunk_bytes), "<i2")
                        yield pa.record_batch({"track_id": pa.array([track]), "chunk_no": pa.array([k], pa.int64()), "n_samples": pa.array([len(own)], pa.int64()), "samples": pa.array([own], pa.list_(pa.int16()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcm").load(path).select("path")
    return files.mapInArrow(chunks, "track_id string, chunk_no long, n_samples long, samples array<smallint>")
