import hashlib
import zlib

import numpy as np
import pytest

from versetime.llm.audio import AudioFeatures, read_wav, stored_tensors
from versetime.llm.queries import stored_audio


@pytest.mark.parametrize("rate", [8000, 16_000, 11_025, 6000, 44_100])
def test_polyphase_is_the_filter_of_the_upsampled_signal(rate):
    own, rng = AudioFeatures(), np.random.default_rng(1)
    up, down = 8000 // np.gcd(8000, rate), rate // np.gcd(8000, rate)
    for n in (1, 2, 50, 333):
        samples = rng.normal(size=n).astype(np.float32)
        got = own.resampled(samples, rate)
        if up == down:
            assert (got == samples).all()
            continue
        taps, wide = own.filter(up, down), np.zeros(n * up)
        wide[::up] = samples
        full = np.convolve(wide, taps)[len(taps) // 2 :]
        assert got == pytest.approx(full[np.arange(-(-n * up // down)) * down], abs=1e-4)


def test_tone_and_segments():
    own = AudioFeatures()
    t = np.arange(8000) / 8000
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mel = own.log_mel(tone)
    centre = own.bank.argmax(axis=0) * 8000 / 256
    assert abs(centre[mel[len(mel) * 45 // 100].argmax()] - 1000) < 120
    (first, end), *rest = own.segments(mel)
    assert not rest and abs(first * 128 / 8000 - 0.3) < 0.04 and abs(end * 128 / 8000 - 0.6) < 0.04
    table = stored_tensors(own.stored(mel)).combine_chunks()
    assert table.schema.field("tensor").type == own.tensor_type()
    read = table.column("tensor").chunk(0).to_numpy_ndarray()
    assert read.shape == (-(-len(mel) // 32), 32, 32) and (read == own.tensors(mel)).all()
    assert np.abs(read.reshape(-1, 32)[: len(mel)].astype(np.float32) - mel).max() < 0.04 and (read.reshape(-1, 32)[len(mel) :] == -60).all()
    assert table.column("start_ms").to_pylist() == [k * 32 * 16 for k in range(len(read))] and table.column("end_ms")[-1].as_py() == len(mel) * 16


def test_log_mel_and_segments_by_their_definitions():
    own, rng = AudioFeatures(), np.random.default_rng(4)
    samples = (rng.normal(size=5000) * np.repeat([0.001, 0.5, 0.001, 0.01, 0.7], 1000)).astype(np.float32)
    mel = own.log_mel(samples)
    assert len(mel) == 1 + -(-(5000 - 256) // 128)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edge = [hz(2595 * np.log10(1 + 4000 / 700) * k / 33) for k in range(34)]
    for t in (0, 17, len(mel) - 1):
        frame = np.zeros(256)
        part = samples[t * 128 : t * 128 + 256]
        frame[: len(part)] = part
        frame *= [0.5 - 0.5 * np.cos(2 * np.pi * k / 256) for k in range(256)]
        power = [abs(sum(frame * np.exp(-2j * np.pi * b * np.arange(256) / 256))) ** 2 for b in range(129)]
        for m in (0, 5, 31):
            low, mid, high = edge[m : m + 3]
            weight = [max(0, min((b * 8000 / 256 - low) / (mid - low), (high - b * 8000 / 256) / (high - mid))) for b in range(129)]
            assert mel[t, m] == pytest.approx(10 * np.log10(np.dot(weight, power) + 1e-6), abs=0.02)
    energy = mel.mean(axis=1)
    floor, runs, begin, active = np.sort(energy)[len(energy) // 10], [], 0, False
    for t, e in enumerate(energy):
        if not active and e >= floor + 6:
            active, begin = True, t
        elif active and e < floor + 3:
            active = False
            runs.append((begin, t))
    runs += [(begin, len(energy))] if active else []
    assert own.segments(mel).tolist() == [list(r) for r in runs if r[1] - r[0] >= 3] and len(runs) >= 2


def test_stored_bytes(spark):
    data = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "long " * 50_000), (6, "x" * 65), (None, "y"), (6, "x" * 65)]
    df = spark.createDataFrame([(*r, 3) for r in data], "doc_id long, text string, media int")
    rows = stored_audio(df).collect()
    for doc, text in data:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        own = [r for r in rows if r.doc_id == doc]
        assert own and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44) for r in own)
    assert len(rows) == 8 and len({(r.feature, r.media_sha256) for r in rows if r.doc_id in (4, 6)}) == 1
    assert stored_audio(df.limit(0)).count() == 0


def test_wav_of_sixteen_bits():
    head = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\1\0\2\0" + (8000).to_bytes(4, "little") + bytes(6) + b"\x10\0"
    rate, samples = read_wav(head + b"LIST\1\0\0\0a\0data\x08\0\0\0" + np.array([16384, 0, -32768, -32768], "<i2").tobytes())
    assert rate == 8000 and samples.tolist() == [0.25, -1.0]
    with pytest.raises(ValueError):
        read_wav(b"no")
