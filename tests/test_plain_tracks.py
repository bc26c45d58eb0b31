"""Which words reach the alignment of plain texts."""

from versetime.plans import alignment


def test_only_words_of_plain_tracks_are_counted(spark, monkeypatch):
    tracks = spark.createDataFrame([("p", "one two", 900, None), ("b", " ", 900, None), ("t", "[00:01]hi", 900, None)], "track_id string, text string, audio_ms long, transcript_ms long")
    words = spark.createDataFrame([(k, i, w, i * 100, i * 100 + 90) for k in "pbt" for i, w in enumerate(["one", "two"])], "track_id string, ord long, text string, start_ms long, end_ms long")
    segments = spark.createDataFrame([], "track_id string, ord long, text string, start_ms long, end_ms long")
    given, inner = [], alignment.plain_words
    monkeypatch.setattr(alignment, "plain_words", lambda own, spoken: given.append(spoken) or inner(own, spoken))
    found, _ = alignment.align(tracks, words, segments)
    assert {r.track_id for r in given[0].collect()} == {"p"}
    assert sorted((r.track_id, r.text) for r in found.collect()) == [("b", "one"), ("b", "two"), ("p", "one"), ("p", "two"), ("t", "hi")]
