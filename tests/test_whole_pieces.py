"""Tracks with long stretches that no anchor cuts."""

import random

import duckdb
import pytest

from versetime import queries as Q
from versetime.operators import align
from versetime.operators.anchors import long_matches


@pytest.mark.parametrize("cells", [1, 50, 2000])
def test_a_table_made_twice_gives_the_matches_of_one_held(cells):
    rng = random.Random(cells)
    words = ["la", "lala", "stone", "stones", "store", "", "thee", "word", "sword"]
    for _ in range(150):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(60))] for _ in range(2))
        assert align.align_words(a, b, cells) == align.align_words(a, b)


def test_pieces_without_anchors_are_aligned_whole(spark):
    tracks = {"same": (["la"] * 900, ["la"] * 900), "one side": (["la"] * 90, ["so"] * 900), "wrong": (["la", "so"] * 500, (["la", "so"] * 30 + ["x"]) * 16)}
    schema = "track_id string, pos long, norm string"
    left, right = (spark.createDataFrame([(k, i, w) for k, own in tracks.items() for i, w in enumerate(own[side])], schema) for side in (0, 1))
    sizes = spark.createDataFrame([(k, len(a), len(b)) for k, (a, b) in tracks.items()], "track_id string, r long, t long")
    matches, status = long_matches(left, right, sizes, most_reference=400, most_transcript=400, whole=True)
    assert {r.status for r in status.collect()} == {"ok"}
    got = {(m.track_id, m.pos, m.hit) for m in matches.collect()}
    assert got == {(k, i, j) for k, (a, b) in tracks.items() for i, j in enumerate(align.align_words(a, b)) if j >= 0}


def test_a_document_of_repeated_verses(spark, tmp_path):
    verse = [f"word{i % 83}" for i in range(250)]
    text = "\n".join(" ".join(verse[i : i + 10]) for _ in range(11) for i in range(0, 250, 10))
    spark.createDataFrame([(1, text), (2, "a few words"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "data"))
    next((tmp_path / "data").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(Q.oracle_sql()["document_align"]).fetchall()
    found = Q.document_align(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want)) and len(want) == 2754
