from typing import NamedTuple

import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from versetime.functions.text import LYRIC_KEYS, is_lyric_key, is_lyric_name
from versetime.sources import containers as C
from versetime.sources.ranges import Held

TEXT = "[00:01.00]First line\n[00:02.50]Second line"


class Candidate(NamedTuple):
    text: str
    source: str
    tag: str
    timed: list | None = None


class Scan(NamedTuple):
    container: str
    candidates: list
    warnings: list


def scan(data):
    """All three steps in one process; texts are trimmed as Spark does after them."""
    container, blocks, warnings = C.walk(Held(data))
    found = [Candidate(C.trim(text), b.source, name, timed) for b in blocks for name, text, timed in C.lyrics(Held(data), b)]
    return Scan(container, found, warnings)


def only(data):
    found = scan(data)
    assert not found.warnings
    assert len(found.candidates) == 1
    return found.container, found.candidates[0]


@pytest.mark.parametrize(("version", "name"), [(2, b"ULT"), (3, b"USLT"), (4, b"USLT")])
@pytest.mark.parametrize("encoding", [0, 1, 2, 3])
def test_unsynchronised_lyrics(version, name, encoding):
    data = X.id3(X.frame(name, X.uslt(TEXT, encoding), version), version)
    assert only(data) == ("MP3 / ID3", Candidate(TEXT, "ID3", name.decode()))


def test_utf16_without_mark_is_big_endian():
    body = b"\x01eng\0\0" + "abc".encode("utf-16-be")
    assert only(X.id3(X.frame(b"USLT", body)))[1].text == "abc"


def test_synchronised_lyrics_in_milliseconds_and_frames():
    lines = [("b", 2500), ("a", 1000)]
    assert only(X.id3(X.frame(b"SYLT", X.sylt(lines))))[1] == Candidate("b\na", "ID3", "SYLT", [(1000, "a"), (2500, "b")])
    assert only(X.id3(X.frame(b"SYLT", X.sylt(lines, 1))))[1] == Candidate("b\na", "ID3", "SYLT", [])


def test_user_text_needs_lyric_in_its_name():
    ours, other = (X.frame(b"TXXX", b"\x03" + d + b"\0text") for d in (b"My LYRICS", b"mood"))
    assert only(X.id3(ours + other))[1] == Candidate("text", "ID3", "TXXX:My LYRICS")


def test_extended_header_and_unsynchronisation():
    body = X.frame(b"USLT", X.uslt("abc"))
    assert only(X.id3(body, flags=0x40, before=(6).to_bytes(4, "big") + bytes(6)))[1].text == "abc"
    four = X.frame(b"USLT", X.uslt("abc"), 4)
    assert only(X.id3(four, 4, flags=0x40, before=X.synchsafe(6) + bytes(2)))[1].text == "abc"
    stuffed = X.frame(b"USLT", b"\x00eng\x00a\xffb").replace(b"\xff", b"\xff\x00")
    assert only(X.id3(stuffed, flags=0x80))[1].text == "a\xffb"


def test_flac_alone_and_after_id3():
    flac = X.flac(X.vorbis(("TITLE", "x"), ("LYRICS", "Hello from FLAC")))
    assert only(flac) == ("FLAC", Candidate("Hello from FLAC", "FLAC Vorbis comments", "LYRICS"))
    both = scan(X.id3(X.frame(b"USLT", X.uslt("abc"))) + flac)
    assert (both.container, [c.text for c in both.candidates]) == ("FLAC with ID3", ["abc", "Hello from FLAC"])


def test_ogg_packets_over_pages():
    long = "la " * 900
    opus = X.ogg([b"OpusHead", b"OpusTags" + X.vorbis(("unsynced_lyrics", long))])
    assert only(opus) == ("Ogg / Opus", Candidate(long.strip(), "OpusTags", "unsynced_lyrics"))
    assert only(X.ogg([b"\x01vorbis", b"\x03vorbis" + X.vorbis(("LYRIC", "x"))]))[1].source == "Ogg Vorbis comments"


def test_mp4_boxes():
    assert only(X.mp4(X.lyr("hello"))) == ("MP4 / M4A", Candidate("hello", "MP4 metadata", "©lyr"))
    assert only(X.mp4(X.lyr("hello"), wide=True))[1].text == "hello"
    assert only(X.mp4(X.freeform("Synced-Lyrics", "free"), X.freeform("MOOD", "no")))[1] == Candidate("free", "MP4 freeform", "Synced-Lyrics")


def test_riff_chunks():
    tag = X.id3(X.frame(b"USLT", X.uslt("in wav")))
    found = scan(X.riff((b"fmt ", bytes(3)), (b"id3 ", tag), (b"LIST", b"INFO" + b"ILYR\x04\0\0\0info")))
    assert found.container == "WAV / RIFF"
    assert [(c.source, c.tag, c.text) for c in found.candidates] == [("WAV ID3 chunk", "USLT", "in wav"), ("RIFF INFO", "ILYR", "info")]


@pytest.mark.parametrize("header", [False, True])
def test_ape_footer(header):
    data = b"\xff\xfb" + bytes(50) + X.ape(("Title", "x"), ("Lyrics", "ape text"), header=header)
    assert only(data) == ("Audio", Candidate("ape text", "APEv2", "Lyrics"))
    assert not scan(data + bytes(128)).candidates  # what follows the footer hides it


@pytest.mark.parametrize(
    "data",
    [
        X.id3(X.frame(b"USLT", X.uslt(TEXT))), X.id3(X.frame(b"SYLT", X.sylt([("a", 1), ("b", 2)]))), X.flac(X.vorbis(("LYRICS", "abc"))), X.mp4(X.lyr("hello"), X.freeform("lyrics", "x"), wide=True),
        X.ogg([b"OpusTags" + X.vorbis(("LYRICS", "abc" * 300))]), X.riff((b"LIST", b"INFO" + b"ILYR\x04\0\0\0info")), b"x" * 40 + X.ape(("Lyrics", "ape text")),
    ],
)
def test_truncated_files_never_fail(data):
    for n in range(len(data)):
        found = scan(data[:n])
        assert all(w.startswith(("Primary", "APEv2")) for w in found.warnings)


def test_text_terminators():
    assert C.terminator(b"ab\0c", 0, 0) == 2
    assert C.terminator(b"\x01\0\0\x02\0\0", 0, 1) == 4
    assert C.terminator(b"\0\x01\x02", 0, 2) == -1


def test_key_tests_for_columns_and_readers_agree(spark):
    keys = [*LYRIC_KEYS, "Lyrics", "UNSYNCED_LYRICS", "synced-lyrics", "lyricist", "", "__", "ly ric", "title", "\x00lyrics \u2003", "LYRICS=x"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", is_lyric_key(F.col("k")).alias("x")).collect()
    assert all(is_lyric_name(C.trim(r.k)) == r.x for r in rows) and sum(r.x for r in rows) == len(LYRIC_KEYS) + 4
