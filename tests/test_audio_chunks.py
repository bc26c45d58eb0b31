import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from versetime.operators.audio import RATE, Resampler, resample, resampled_chunks
from versetime.sources.pcm import read_pcm16_files, write_pcm16


@pytest.mark.parametrize("rate", [44_100, 22_050, 11_025, 48_000, 8_000, 16_000, 15_999])
def test_pieces_give_the_bits_of_the_whole(rate):
    rng = np.random.default_rng(rate)
    samples = rng.uniform(-1, 1, 30_000).astype(np.float32)
    for cuts in (np.sort(rng.integers(0, 30_000, 40)), np.arange(1, 60), np.array([0, 0, 29_999])):
        own = Resampler(rate)
        got = np.concatenate([own.accept(p) for p in np.split(samples, cuts)])
        assert got.tobytes() == resample(samples, rate).tobytes()
    assert not len(Resampler(rate).accept(samples[:0]))
    assert Resampler(rate).accept(samples[:1]).tolist() == samples[:1].tolist()


def test_chunks_of_tracks(spark):
    rng = np.random.default_rng(2)
    tracks = {k: rng.uniform(-1, 1, n).astype(np.float32) for k, n in (("a", 5000), ("b", 1), ("c", 777), (None, 90))}
    rows = [(k, i, p.tolist()) for k, v in tracks.items() for i, p in enumerate(np.array_split(v, 7))] + [("d", 0, None), ("d", 1, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "track_id string, chunk_no int, samples array<float>, first_sample int").repartition(4)
    got = {}
    for r in sorted(resampled_chunks(df, 44_100).collect(), key=lambda r: r.chunk_no):
        assert r.first_sample == len(got.setdefault(r.track_id, []))
        got[r.track_id] += r.samples
    assert got.pop("d") == [] and {k: resample(v, 44_100).tolist() for k, v in tracks.items()} == got
    assert resampled_chunks(df.limit(0), RATE).count() == 0


def test_files_are_seen_when_all_are_written_and_never_by_half(spark, tmp_path):
    rows = [("a/b", 1, [3, None]), ("a/b", 0, [1, 2]), ("c", 0, None), (None, 5, [-7] * 1000)]
    df = spark.createDataFrame(rows, "track_id string, chunk_no int, samples array<int>").repartition(3)
    write_pcm16(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["None.pcm", "_SUCCESS", "a%2Fb.pcm", "c.pcm"]
    assert (tmp_path / "out" / "_SUCCESS").read_text() == "1004"
    assert np.frombuffer((tmp_path / "out" / "a%2Fb.pcm").read_bytes(), "<i2").tolist() == [1, 2, 3, 0]
    back = {(r.track_id, r.chunk_no): r.samples for r in read_pcm16_files(spark, f"file://{tmp_path}/out", 1500).collect()}
    assert back == {("a/b", 0): [1, 2, 3, 0], ("None", 0): [-7] * 750, ("None", 1): [-7] * 250}

    def failing(batches):
        for batch in batches:
            yield batch
            if pa.compute.any(pa.compute.equal(batch.column(0), "t7")).as_py():
                raise ValueError("no room")

    many = spark.range(40).selectExpr("concat('t', id) as track_id", "0 as chunk_no", "array(1, 2, 3) as samples").repartition("track_id")
    with pytest.raises(PySparkException):
        write_pcm16(many.mapInArrow(failing, many.schema), str(tmp_path / "broken"))
    assert [p.name for p in (tmp_path / "broken").iterdir()] == [] if (tmp_path / "broken").exists() else True
    write_pcm16(df.limit(0), str(tmp_path / "empty"))
    assert [p.name for p in (tmp_path / "empty").iterdir()] == ["_SUCCESS"]
