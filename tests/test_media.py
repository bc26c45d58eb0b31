import hashlib
import struct
import tracemalloc

from pyspark.sql import functions as F

from tests import fixtures as X
from versetime.sources import containers, media
from versetime.sources.ranges import Opened, chunk_digests
from versetime.streaming.repeats import without_repeats_stream


def test_tracks_of_a_folder(spark, tmp_path):
    both = X.id3(X.frame(b"USLT", X.uslt("plain but long text")) + X.frame(b"SYLT", X.sylt([("b", 9), ("a", 3)])) + X.frame(b"USLT", X.uslt("plain but long text")))
    files = {"a.mp3": both, "b.flac": X.flac(X.vorbis(("LYRICS", "x"), ("LYRICS", " "))), "c.bin": b"nothing", "d.mp3": both[:20], "e.mp3": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.file_name: r for r in media.read_tracks(spark, str(tmp_path)).collect()}
    assert {k: (r.container, r.size_bytes, r.sha256) for k, r in rows.items()} == {
        k: (c, len(files[k]), hashlib.sha256(files[k]).hexdigest()) for k, c in {"a.mp3": "MP3 / ID3", "b.flac": "FLAC", "c.bin": "Audio", "d.mp3": "MP3 / ID3"}.items()
    }
    assert [(c.tag, c.text) for c in rows["a.mp3"].candidates] == [("USLT", "plain but long text"), ("SYLT", "b\na")]
    assert rows["a.mp3"].best.tag == "SYLT" and [(t.start_ms, t.text) for t in rows["a.mp3"].best.timed] == [(3, "a"), (9, "b")]
    assert len(rows["b.flac"].candidates) == 1 and rows["d.mp3"].warnings and rows["c.bin"].best is None
    tags = sorted((r.track_id[-6:], r.tag_no, r.source, r.kind, r.offset, r.length, r.n_ranges) for r in media.tag_rows(media.media_files(spark, str(tmp_path))).collect())
    assert tags == [("/a.mp3", 0, "ID3", "id3", 0, len(both), 1), ("b.flac", 0, "FLAC Vorbis comments", "comments", 8, len(files["b.flac"]) - 8, 1)]
    assert media.read_tracks(spark, str(tmp_path), digest=False, pattern="b*").first().sha256 is None
    plan = media.media_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def sparse(path, size, parts):
    """A file with bytes at some offsets and holes elsewhere."""
    with open(path, "wb") as f:
        f.truncate(size)
        for offset, data in parts:
            f.seek(offset)
            f.write(data)


def test_files_of_three_gigabytes_are_read_by_range(spark, tmp_path):
    size = 3 << 30
    moov = X.mp4(X.lyr("late lyrics"))
    moov = moov[moov.index(b"moov") - 4 :]
    sparse(tmp_path / "video one.m4a", size + len(moov), [(0, X.box(b"ftyp", b"M4A \0\0\0\0")), (16, struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", size - 16)), (size, moov)])
    tag = X.ape(("Lyrics", "[00:01]ape text"))
    sparse(tmp_path / "b.mp3", size, [(0, b"\xff\xfb"), (size - len(tag), tag)])
    rows = {r.file_name: r for r in media.read_tracks(spark, str(tmp_path), digest=False).collect()}
    assert [(rows[n].container, rows[n].size_bytes, rows[n].best.text, rows[n].warnings) for n in ("video one.m4a", "b.mp3")] == [
        ("MP4 / M4A", size + len(moov), "late lyrics", []), ("Audio", size, "[00:01]ape text", [])
    ]
    tracemalloc.start()
    for name in rows:
        with Opened(str(tmp_path / name)) as file:
            _, blocks, _ = containers.walk(file)
            assert sum(len(list(containers.lyrics(file, b))) for b in blocks) == 1
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_digest_of_a_large_file_and_of_chunks(spark, tmp_path):
    size = (1 << 31) + 12_345  # beyond what one array of bytes can hold
    sparse(tmp_path / "a.bin", size, [(5, b"x"), (size - 3, b"end")])
    want = hashlib.sha256()
    with open(tmp_path / "a.bin", "rb") as f:
        while part := f.read(1 << 22):
            want.update(part)
    row = media.read_tracks(spark, str(tmp_path)).first()
    assert (row.size_bytes, row.sha256) == (size, want.hexdigest())


def test_chunks_fold_in_order(spark):
    chunks = [("a", 2, b"c"), ("a", 0, b"a"), ("a", 1, None), ("b", 0, b""), (None, 1, b"y"), (None, 0, b"x"), ("c", 0, b"2"), ("c", 0, b"1")]
    df = spark.createDataFrame([(k, i, None if d is None else bytearray(d), "z") for k, i, d in chunks], "track_id string, chunk_no int, data binary, sha256 string").repartition(3)
    got = {r.track_id: (r.n_chunks, r.n_bytes, r.sha256) for r in chunk_digests(df).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {"a": (3, 2, sha(b"ac")), "b": (1, 0, sha(b"")), None: (2, 2, sha(b"xy")), "c": (2, 2, sha(b"12"))}
    assert chunk_digests(df.limit(0)).count() == 0


def test_lyric_files(spark, tmp_path):
    (tmp_path / "a.lrc").write_text("[00:01]x\ny")
    (tmp_path / "b.txt").write_text(" \n")
    assert [r.text for r in media.read_lyrics(spark, str(tmp_path)).collect()] == ["[00:01]x\ny"]


def test_mime_names_and_assets(spark):
    data = [(bytearray(b"\x89PNG\r\n\x1a\nxx"),), (bytearray(b"RIFFxxxxWEBP"),), (bytearray(b"\xff\xd8"),)]
    df = spark.createDataFrame(data, "content binary")
    assert [r[0] for r in df.select(media.image_mime(F.col("content"))).collect()] == ["image/png", "image/webp", "image/jpeg"]
    lyrics = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "track_id string, size_bytes long")
    art = spark.createDataFrame([("a", "x", 9, -1), ("b", "y", 8, 60)], "track_id string, artwork string, duration_ms long, size_bytes long")
    assert sorted((r.track_id, r.size_bytes, r.duration_ms) for r in media.assets(lyrics, art).collect()) == [("a", 5, 9), ("b", 60, 8), ("c", 7, None)]


def test_best_and_first_rows(spark):
    df = spark.createDataFrame([("t", 0, "aaaa", 0), ("t", 1, "bb", 1), ("t", 2, "cc", 1), ("t", 3, "bb", 1)], "track_id string, cand_no long, text string, n int")
    timed = df.withColumn("timed", F.when(F.col("n") > 0, F.array(F.struct(F.lit(1).alias("start_ms"), F.lit("x").alias("text")))).otherwise(F.array()))
    assert media.best_rows(timed, ["track_id"]).first().cand_no == 1
    assert sorted(r.cand_no for r in media.first_of_equal(df, ["track_id", "text"]).collect()) == [0, 1, 2]


def test_repeats_in_a_stream(spark, tmp_path):
    schema = "track_id string, text string, start_ms long, end_ms long"
    batches = [[("t", "la la", 0), ("t", "b", 1000), ("u", "x", 0)], [("t", "La, la!", 2900), ("t", "c", 3000), ("u", "y", 10)], [("t", "la la", 3100), ("u", "...", 20)]]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame([(t, x, s, s + 100) for t, x, s in rows], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = without_repeats_stream(stream, idle_ms=None).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = sorted((r.track_id, r.start_ms) for r in spark.table("kept").collect())
    assert got == [("t", 0), ("t", 1000), ("t", 3000), ("t", 3100), ("u", 0), ("u", 10)]
