"""Outputs of the resampler that fall on a sample."""

import numpy as np

from versetime import queries as Q
from versetime.operators.audio import resample


def test_an_output_on_a_sample_is_that_sample():
    x = np.random.default_rng(4).uniform(-1, 1, 3001).astype(np.float32)
    assert (resample(x, 48_000, on_sample=True) == x[::3]).all() and not (resample(x, 48_000) == x[::3]).all()
    assert (resample(x, 24_000, on_sample=True)[::2] == x[::3]).all()
    assert (resample(x, 44_100, on_sample=True) == resample(x, 44_100)).all()


def test_query_on_a_vector_whose_interpolation_rounds(spark, tmp_path):
    x = np.float32(-0.06951025128364563), np.float32(0.061479534953832626)
    assert x[0] + (x[1] - x[0]) * np.float32(1) != x[1]
    rows = spark.createDataFrame([(1, [0.5, 0.0, float(x[0]), float(x[1])]), (2, []), (3, [0.25])], "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.vec_id: r.pcm for r in Q.resample_quantize(spark, str(tmp_path)).collect()}
    want = int(np.floor(np.float64(x[1] * np.float32(32767)) + 0.5))
    assert found == {1: f"16384,{want}", 2: "", 3: "8192"}
