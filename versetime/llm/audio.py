"""Media columns: 8-bit audio in WAV form, and log-mel tensors with time spans computed from it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a WAV header, and the multiple that payloads are filled up to.
HEADER_BYTES, PAD_TO = 44, 64
#: Frames that are transformed at once.
FRAME_BLOCK = 4096


def _little_endian(n: Column, size: int) -> Column:
    big = F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))
    return F.concat(*(F.substring(big, size - i, 1) for i in range(size)))


def padded(content: Column) -> Column:
    """Content with zero bytes appended up to a positive multiple of ``PAD_TO``; null counts as empty."""
    own = F.coalesce(content, F.lit(b""))
    return F.rpad(own, F.greatest(F.lit(1), F.ceil(F.octet_length(own) / PAD_TO)).cast("int") * PAD_TO, F.lit(b"\0"))


def wav(payload: Column, rate: int) -> Column:
    """A WAV file of one channel whose unsigned 8-bit samples are the payload's bytes (an even number)."""
    n = F.octet_length(payload)
    fixed = lambda text: F.lit(text.encode())
    le = lambda value, size: _little_endian(value if isinstance(value, Column) else F.lit(value), size)
    return F.concat(
        fixed("RIFF"), le(n + HEADER_BYTES - 8, 4), fixed("WAVEfmt "), le(16, 4), le(1, 2), le(1, 2), le(rate, 4), le(rate, 4), le(1, 2), le(8, 2),
        fixed("data"), le(n, 4), payload,
    )


def wav_payload(media: Column) -> Column:
    """The samples of :func:`wav`, read back from the stored bytes."""
    return F.substring(media, HEADER_BYTES + 1, 2**31 - 1)


def read_wav(content: bytes | memoryview) -> tuple[int, np.ndarray]:
    """(rate, samples in -1 to 1) of an 8-bit or 16-bit WAV file; channels are averaged, other chunks skipped."""
    view = memoryview(content)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels, bits = 12, 0, 1, 8
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        own = view[at + 8 : at + 8 + size]
        if name == b"fmt ":
            channels, rate, bits = int.from_bytes(own[2:4], "little"), int.from_bytes(own[4:8], "little"), int.from_bytes(own[14:16], "little")
        elif name == b"data":
            if bits == 8:
                samples = (np.frombuffer(own, np.uint8).astype(np.float32) - 128) / 128
            else:
                samples = np.frombuffer(own[: len(own) // 2 * 2], "<i2").astype(np.float32) / 32768
            return rate, samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32)
        at += 8 + size + size % 2
    raise ValueError("no samples")


@dataclass(frozen=True)
class AudioFeatures:
    """Log-mel tensors of ``frames`` x ``mels`` values; parameters of the analysis."""

    rate: int = 8000
    frame: int = 256
    hop: int = 128
    mels: int = 32
    frames: int = 32
    half_taps: int = 8
    on_db: float = 6.0
    off_db: float = 3.0
    least_frames: int = 3

    def filter(self, up: int, down: int) -> np.ndarray:
        """Windowed-sinc low-pass filter at the lower of the two rates."""
        wide = max(up, down)
        n = np.arange(-self.half_taps * wide, self.half_taps * wide + 1)
        return (np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1] * up / wide).astype(np.float32)

    def resampled(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """Samples at ``self.rate`` by a polyphase filter: only the outputs that are kept are computed.

        Output q * up + r takes every up-th tap, from a phase that depends on r alone, against inputs that
        advance by ``down``; these are dealt into ``down`` streams, each convolved with its share of the taps.
        """
        up, down = self.rate // gcd(self.rate, rate), rate // gcd(self.rate, rate)
        if up == down or not len(samples):
            return samples
        taps, total = self.filter(up, down), -(-len(samples) * up // down)
        out = np.zeros(total, np.float32)
        reach = len(taps) // up + 1
        edge = reach + down
        own = np.concatenate([np.zeros(edge, np.float32), samples, np.zeros(edge + down, np.float32)])
        for r in range(min(up, total)):
            rows = len(range(r, total, up))
            middle = r * down + len(taps) // 2
            phase, first = middle % up, middle // up
            share, sums = taps[phase::up], np.zeros(rows, np.float32)
            for s in range(min(down, len(share))):
                part = share[s::down]
                begin = edge + first - s - down * (len(part) - 1)
                lead = max(0, -(begin // down))
                stream = own[begin + lead * down :: down]
                stream = np.concatenate([np.zeros(lead, np.float32), stream])[: rows + len(part) - 1]
                stream = np.pad(stream, (0, rows + len(part) - 1 - len(stream)))
                sums += np.convolve(stream, part, "valid")
            out[r::up] = sums
        return out

    @cached_property
    def bank(self) -> np.ndarray:
        """Triangular filters, evenly spaced on the mel scale, as spectrum bins x mels."""
        mel = np.linspace(0, 2595 * np.log10(1 + self.rate / 2 / 700), self.mels + 2)
        edge = 700 * (10 ** (mel / 2595) - 1)
        bins = np.arange(self.frame // 2 + 1)[:, None] * self.rate / self.frame
        rise = (bins - edge[:-2]) / (edge[1:-1] - edge[:-2])
        fall = (edge[2:] - bins) / (edge[2:] - edge[1:-1])
        return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    def log_mel(self, samples: np.ndarray) -> np.ndarray:
        """Overlapped frames in decibels; the last frame is filled up with silence."""
        count = 1 + max(0, -(-(len(samples) - self.frame) // self.hop))
        samples = np.pad(samples, (0, (count - 1) * self.hop + self.frame - len(samples)))
        frames = np.lib.stride_tricks.sliding_window_view(samples, self.frame)[:: self.hop]
        window = np.hanning(self.frame + 1)[:-1].astype(np.float32)
        out = np.empty((count, self.mels), np.float32)
        for at in range(0, count, FRAME_BLOCK):
            spectrum = np.fft.rfft(frames[at : at + FRAME_BLOCK] * window, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            out[at : at + FRAME_BLOCK] = 10 * np.log10(power.astype(np.float32) @ self.bank + np.float32(1e-6))
        return out

    def segments(self, log_mel: np.ndarray) -> np.ndarray:
        """(first, end) frames of activity: it begins ``on_db`` over the floor and lasts until ``off_db``."""
        energy = log_mel.mean(axis=1)
        floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
        on, off = energy >= floor + self.on_db, energy < floor + self.off_db
        last = np.maximum.accumulate(np.where(on | off, np.arange(len(energy)), -1))
        active = (last >= 0) & on[last]
        edge = np.flatnonzero(np.diff(active, prepend=False, append=False)).reshape(-1, 2)
        return edge[edge[:, 1] - edge[:, 0] >= self.least_frames]

    def tensors(self, log_mel: np.ndarray) -> np.ndarray:
        """The frames as tensors of one shape, the last filled up with the floor of the scale."""
        n = -(-len(log_mel) // self.frames)
        out = np.full((n * self.frames, self.mels), -60, np.float16)
        out[: len(log_mel)] = log_mel
        return out.reshape(n, self.frames, self.mels)

    def tensor_type(self) -> pa.DataType:
        return pa.fixed_shape_tensor(pa.float16(), (self.frames, self.mels), dim_names=("frame", "mel"))

    def stored(self, log_mel: np.ndarray) -> bytes:
        """An Arrow stream of the tensors, fixed in shape, with the time span of each."""
        tensors = self.tensors(log_mel)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), self.frames * self.mels)
        first = np.arange(0, len(log_mel), self.frames)
        ms = lambda frame: pa.array(frame * self.hop * 1000 // self.rate, pa.int64())
        batch = pa.record_batch({
            "tensor": pa.ExtensionArray.from_storage(self.tensor_type(), flat), "start_ms": ms(first), "end_ms": ms(np.minimum(first + self.frames, len(log_mel))),
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def stored_tensors(content: bytes | pa.Buffer) -> pa.Table:
    """``(tensor, start_ms, end_ms)`` of stored tensors; ``tensor`` is an Arrow array of fixed-shape tensors."""
    return pa.ipc.open_stream(content).read_all()


def tensor_digest(tensors: Column) -> Column:
    """Number of stored tensors, end of the last span and md5 of shape, values and spans, as they are read back."""

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            if not row.is_valid:
                out.append(None)
                continue
            own = stored_tensors(row.as_buffer()).combine_chunks()
            values = own.column("tensor").chunk(0).to_numpy_ndarray()
            spans = [own.column(c).to_numpy() for c in ("start_ms", "end_ms")]
            code = hashlib.md5(repr(values.shape).encode() + np.ascontiguousarray(values).tobytes() + spans[0].tobytes() + spans[1].tobytes())
            out.append(f"{len(values)}:{spans[1][-1]}:{code.hexdigest()}")
        return pa.array(out, pa.string())

    return of(tensors)


_SPAN = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])


def _spans(first: np.ndarray, end: np.ndarray, settings: AudioFeatures) -> list[dict]:
    ms = lambda frame: int(frame) * settings.hop * 1000 // settings.rate
    return [{"start_ms": ms(a), "end_ms": ms(b)} for a, b in zip(first, end, strict=True)]


def _analysed(batches: Iterator[pa.RecordBatch], settings: AudioFeatures) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, tensors, active = [], [], []
        for media in batch.column("media"):
            if not media.is_valid:
                for out in (counts, tensors, active):
                    out.append(None)
                continue
            rate, samples = read_wav(media.as_buffer())
            log_mel = settings.log_mel(settings.resampled(samples, rate))
            found = settings.segments(log_mel)
            counts.append(len(log_mel))
            tensors.append(settings.stored(log_mel))
            active.append(_spans(found[:, 0], found[:, 1], settings))
        kept = {c: batch.column(c) for c in batch.schema.names if c != "media"}
        yield pa.record_batch(kept | {
            "n_frames": pa.array(counts, pa.int64()), "tensors": pa.array(tensors, pa.binary()),
            "segments": pa.array(active, pa.list_(_SPAN)),
        })


def audio_features(audio: DataFrame, settings: AudioFeatures = AudioFeatures()) -> DataFrame:  # noqa: B008
    """Features of the WAV files in the column ``media``, which they replace; other columns stay.

    ``tensors`` are Arrow streams of log-mel tensors of one shape, with the time span of each (see
    :func:`stored_tensors`); ``segments`` are the spans of activity; ``n_frames`` counts frames.
    Null media give nulls; an empty table gives no rows; every row stands alone, so equal audio has equal
    features.  Columns named as an output are replaced.
    """
    outputs = "n_frames long, tensors binary, segments array<struct<start_ms:long,end_ms:long>>"
    rows = audio.drop("n_frames", "tensors", "segments")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "media")
    return rows.mapInArrow(lambda own: _analysed(own, settings), f"{kept}, {outputs}" if kept else outputs)
