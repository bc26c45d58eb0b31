"""What a task holds of large tables."""

from pyspark.sql import functions as F

from tests import fixtures as X
from versetime.operators import asof
from versetime.sources import media


def test_a_scan_gives_on_slices_of_a_batch(spark, monkeypatch):
    """One Python step reads the files, in slices however large the batch."""
    monkeypatch.setattr(media, "SLICE", 3)
    files = [None if i % 5 == 4 else X.flac(X.vorbis(("LYRICS", f"line {i}"))) for i in range(20)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, f binary").coalesce(1)
    found = media.scanned(df, F.col("f"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r.i: r.scan for r in found.collect()}
    assert all((got[i] is None) == (f is None) for i, f in enumerate(files))
    assert all(s.container == "FLAC" and [c.text for c in s.candidates] == [f"line {i}"] and s.warnings == [] for i, s in got.items() if s)


def test_clock_is_swept_without_texts(spark, monkeypatch):
    """Rows of the clock carry a line's number through the sweep; texts join at its end, lines of one number as before."""
    lines = spark.createDataFrame([("a", 1, "x", 0, 9), ("a", 1, "y", 500, 9), ("a", 2, "z", 800, 9), (None, 1, "n", 300, 9)], "track_id string, line_no int, text string, start_ms long, end_ms long")
    clock = spark.createDataFrame([(k, t) for k in ("a", None, "none") for t in (0, 500, 900)], "track_id string, time_ms long")
    swept, inner = [], asof.running
    monkeypatch.setattr(asof, "running", lambda rows, *own: swept.append(rows.schema.simpleString()) or inner(rows, *own))
    found = asof.active_lines(clock, lines)
    got = {(r.track_id, r.time_ms): (r.text, r.previous_text, r.next_text) for r in found.collect()}
    assert [got["a", t][0] for t in (0, 500, 900)] == ["x", "y", "z"] and [got[None, t][0] for t in (0, 500, 900)] == ["n"] * 3
    assert all(got["none", t] == (None, None, None) for t in (0, 500, 900))
    assert len(swept) == 2 and "_clock" in swept[1] and "text" not in swept[1]
