"""Sampled audio in array columns: downmix, linear resampling, quantising, and the silence test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.functions.text import let

RATE = 16_000
#: Silence is judged by every so many samples: all below four times the threshold, their mean power below it.
STRIDE, PEAK_TIMES, SILENCE = 16, 4, 0.0035


def clipped(sample: Column) -> Column:
    return F.greatest(F.least(sample.cast("float"), F.lit(1.0).cast("float")), F.lit(-1.0).cast("float"))


def downmixed(samples: Column, channels: int) -> Column:
    """Mean of each frame's channels, clipped; what is left of a frame at the end is dropped."""
    zero = F.lit(0.0).cast("float")
    total = lambda own, f: F.aggregate(F.slice(own, f * channels + 1, channels), zero, lambda a, x: (a + x.cast("float")).cast("float"))

    def frames(own: Column) -> Column:
        count = F.floor(F.size(own) / channels).cast("int")
        mean = F.transform(F.sequence(F.lit(0), count - 1), lambda f: clipped(total(own, f) / channels))
        return F.when(count > 0, mean).otherwise(F.array().cast("array<float>"))

    return let(samples, frames)


def from_pcm16(samples: Column) -> Column:
    """Signed 16-bit samples as floats below one."""
    return F.transform(samples, lambda s: (s.cast("float") / F.lit(32768.0).cast("float")).cast("float"))


def to_pcm16(samples: Column) -> Column:
    """Clipped samples times 32767, rounded half up."""
    return F.transform(samples, lambda s: F.floor((clipped(s) * F.lit(32767.0).cast("float")).cast("float").cast("double") + 0.5).cast("smallint"))


def pcm16_bytes(samples: Column) -> Column:
    """Arrays of 16-bit samples as little-endian bytes; null arrays give null, null samples silence."""

    @F.arrow_udf("binary")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([s.values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i2").tobytes() if s.is_valid else None for s in rows], pa.binary())

    return of(samples.cast("array<smallint>"))


def read_pcm16(content: Column, start_sample: Column, n_samples: Column) -> Column:
    """Samples from ``start_sample`` on, as floats below one, of little-endian 16-bit bytes; only their bytes are decoded.

    What lies beyond the end is left out, as is half a sample at the end; null bytes give null.
    """

    @F.arrow_udf("array<float>")
    def of(rows: pa.Array) -> pa.Array:
        own = [None if not raw.is_valid else raw.as_buffer() for raw in rows]
        return pa.array([None if b is None else np.frombuffer(b, "<i2", len(b) // 2).astype(np.float32) / np.float32(32768) for b in own], pa.list_(pa.float32()))

    return of(F.substring(content, (start_sample * 2 + 1).cast("int"), (n_samples * 2).cast("int")))


def resample(samples: np.ndarray, rate: int, target: int = RATE, *, on_sample: bool = False) -> np.ndarray:
    """Linear interpolation in single precision.

    The first output is the first input.  The clock of the others is a running sum of the ratio, not its
    multiples, and an output at the last input's place still counts.  An output at an input's place goes through the
    same sum, whose rounding can miss that input by a bit; with ``on_sample`` it is the input itself.
    """
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    if len(samples) < 2:
        return samples[:1].astype(np.float32)
    ratio = rate / target
    clock = np.add.accumulate(np.full(int((len(samples) - 1) / ratio) + 2, ratio))
    clock = clock[clock <= len(samples) - 1]
    right = np.maximum(np.ceil(clock).astype(np.int64), 1)
    fraction = np.clip((clock - (right - 1)).astype(np.float32), np.float32(0), np.float32(1))
    left = samples[right - 1].astype(np.float32)
    between = left + (samples[right].astype(np.float32) - left) * fraction
    if on_sample:
        between = np.where(clock == right, samples[right].astype(np.float32), between)
    return np.concatenate([samples[:1].astype(np.float32), between.astype(np.float32)])


def resampled(samples: Column, rate: Column, *, on_sample: bool = False) -> Column:
    """Arrays of samples at ``RATE`` by :func:`resample`; null where samples or rate are null."""

    @F.arrow_udf("array<float>")
    def of(rows: pa.Array, rates: pa.Array) -> pa.Array:
        pairs = zip(rows, rates.to_pylist(), strict=True)
        return pa.array([None if r is None or not s.is_valid else resample(s.values.to_numpy(zero_copy_only=False), r, on_sample=on_sample) for s, r in pairs], pa.list_(pa.float32()))

    return of(samples, rate)


class Resampler:
    """:func:`resample` of samples that come in pieces: carries the last sample and the clock from piece to piece."""

    def __init__(self, rate: int, target: int = RATE) -> None:
        if rate <= 0 or target <= 0:
            raise ValueError("rates must be positive")
        self.ratio, self.seen, self.last = rate / target, 0, np.zeros(0, np.float32)
        self.clock = self.ratio

    def accept(self, samples: np.ndarray) -> np.ndarray:
        """The outputs that the samples so far determine and that were not given before."""
        if not len(samples):
            return np.zeros(0, np.float32)
        own = np.concatenate([self.last, samples.astype(np.float32)])
        begin, first = self.seen - len(self.last), samples[: self.seen == 0].astype(np.float32)
        self.seen, self.last = self.seen + len(samples), own[-1:]
        due = max(0, int((self.seen - 1 - self.clock) / self.ratio) + 2)
        clock = np.add.accumulate(np.concatenate([[self.clock], np.full(due, self.ratio)]))
        now = clock[clock <= self.seen - 1]
        self.clock = clock[len(now)]
        right = np.maximum(np.ceil(now).astype(np.int64), 1)
        fraction = np.clip((now - (right - 1)).astype(np.float32), np.float32(0), np.float32(1))
        left = own[right - 1 - begin]
        return np.concatenate([first, (left + (own[right - begin] - left) * fraction).astype(np.float32)])


def resampled_chunks(chunks: DataFrame, rate: int, *, key: str = "track_id", target: int = RATE) -> DataFrame:
    """``(track_id, chunk_no, first_sample, samples)`` at ``target`` of chunks ``(track_id, chunk_no, samples)`` of tracks.

    Chunks are dealt by track and sorted within their partition, which Spark spills, and stream by: a task holds a batch,
    the last sample and the clock (:class:`Resampler`), whatever the track's length.  Each chunk gives the outputs that it
    determines, none perhaps, and together they are those of the whole array, bit by bit.

    Null chunks are empty, null samples silence; a null track is a track; an empty table gives no rows.
    """
    kind = dict(chunks.dtypes)[key]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, given = None, None, 0
        for batch in batches:
            firsts, out = [], []
            for track, samples in zip(batch.column(0), batch.column(2), strict=True):
                if own is None or track.as_py() != now:
                    now, own, given = track.as_py(), Resampler(rate, target), 0
                piece = own.accept(samples.values.fill_null(0).to_numpy(zero_copy_only=False)) if samples.is_valid else np.zeros(0, np.float32)
                firsts.append(given)
                out.append(piece)
                given += len(piece)
            yield pa.record_batch({key: batch.column(0), "chunk_no": batch.column(1), "first_sample": pa.array(firsts, pa.int64()), "samples": pa.array(out, pa.list_(pa.float32()))})

    ordered = chunks.repartition(key).sortWithinPartitions(key, "chunk_no").select(key, F.col("chunk_no").cast("long"), F.col("samples").cast("array<float>"))
    return ordered.mapInArrow(along, f"`{key}` {kind}, chunk_no long, first_sample long, samples array<float>")


def near_silence(samples: Column, threshold: float = SILENCE) -> Column:
    """Whether the tested samples are quiet: an empty array is."""
    limit = F.lit(threshold).cast("float")
    every = lambda own: F.transform(F.sequence(F.lit(1), F.size(own), F.lit(STRIDE)), lambda i: F.abs(F.element_at(own, i).cast("float")))

    def judged(tested: Column) -> Column:
        power = F.aggregate(tested, F.lit(0.0), lambda a, x: a + (x * x).cast("float").cast("double"))
        rms = F.sqrt(power / F.size(tested)).cast("float")
        return (F.array_max(tested) < (limit * F.lit(PEAK_TIMES)).cast("float")) & (rms < limit)

    return let(samples, lambda own: F.when(F.size(own) > 0, let(every(own), judged)).otherwise(F.lit(True)))


def window_samples(samples: Column, start_sample: Column, n_samples: Column) -> Column:
    """The samples of one window."""
    return F.slice(samples, (start_sample + 1).cast("int"), n_samples)
