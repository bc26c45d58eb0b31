"""Where media files hold lyrics, in three steps: walks over a file's structures that read heads only and tell where the
tags are, generators that split a tag into its entries, and decoders of one entry.  Only tags are read, and only entries
that can be lyrics are decoded.  :mod:`versetime.sources.media` has the steps as columns and rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from versetime.functions.text import is_lyric_name
from versetime.sources.ranges import Ranges

# Limits of the formats.
TAG_BYTES, COMMENTS, PACKETS, BOX_DEPTH = 16 << 20, 100_000, 8, 10
# Names of frames of plain lyrics, of timed ones and of named texts.
PLAIN_FRAMES, TIMED_FRAMES, TEXT_FRAMES = ("USLT", "ULT"), ("SYLT", "SLT"), ("TXXX", "TXX")
# What a broken structure is called.
_CUT_OFF, _PRIMARY, _TAIL = "EOFException", "Primary metadata parser", "APEv2 parser"
# What counts as white space, and NUL.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x00\xa0                　"


class Block(NamedTuple):
    """A tag in a file: its ``kind`` says how it is split, ``ranges`` where its bytes are."""

    source: str
    kind: str
    tag: str
    ranges: list[tuple[int, int]]


class Entry(NamedTuple):
    """A named piece of a tag; its ``kind`` says how it is decoded."""

    kind: str
    name: str
    data: bytes


@dataclass(frozen=True)
class Span:
    """A window of a file."""

    file: Ranges
    begin: int
    end: int

    def take(self, at: int, n: int) -> bytes:
        """n bytes; past the end of the file this is an error, as a read would be."""
        if at + n > self.file.size:
            raise EOFError(_CUT_OFF)
        return self.file.peek(at, n)

    def number(self, at: int, n: int, order: str = "big") -> int:
        return int.from_bytes(self.file.peek(at, n), order)


def trim(text: str) -> str:
    return text.strip(_SPACE)


def ascii_text(raw: bytes) -> str:
    return raw.decode("ascii", "replace")


def synchsafe(raw: bytes) -> int:
    """Four groups of seven bits."""
    value = 0
    for b in raw[:4]:
        value = value << 7 | b & 0x7F
    return value


# Walks: where the tags are.


def id3_blocks(file: Span, at: int, source: str) -> Iterator[Block]:
    """The ID3v2 tag at a place, of version 2 to 4."""
    if file.file.peek(at, 3) == b"ID3":
        head = file.take(at, 10)
        size = synchsafe(head[6:])
        if 2 <= head[3] <= 4 and 0 < size <= TAG_BYTES:
            file.take(at + 10 + size, 0)
            yield Block(source, "id3", "ID3", [(at, 10 + size)])


def flac_blocks(file: Span, at: int) -> Iterator[Block]:
    last, at = file.file.peek(at, 4) != b"fLaC", at + 4
    while not last and at + 4 <= file.file.size:
        kind, size = file.number(at, 1), file.number(at + 1, 3)
        if size > TAG_BYTES or at + 4 + size > file.file.size:
            return
        if kind & 0x7F == 4:
            yield Block("FLAC Vorbis comments", "comments", "", [(at + 4, size)])
        last, at = bool(kind & 0x80), at + 4 + size


def ogg_packets(file: Span) -> list[list[tuple[int, int]]]:
    """Ranges of the packets of an Ogg stream, over its pages; a lace below 255 ends one."""
    packets, parts, at = [], [], 0
    while at + 27 <= file.file.size and len(packets) < PACKETS and file.file.peek(at, 4) == b"OggS":
        laces = file.take(at + 27, file.number(at + 26, 1))
        at += 27 + len(laces)
        begin = at
        for lace in laces:
            if at + lace > file.file.size:
                return packets
            at += lace
            if lace < 255:
                packets.append([*parts, (begin, at - begin)])
                parts, begin = [], at
        if at > begin:
            parts.append((begin, at - begin))
    return packets


def ogg_blocks(file: Span) -> Iterator[Block]:
    """The first packet of Opus comments, or else of Vorbis comments."""
    packets = ogg_packets(file)
    for magic, source in ((b"OpusTags", "OpusTags"), (b"\x03vorbis", "Ogg Vorbis comments")):
        for ranges in packets:
            head = b"".join(file.file.peek(o, min(n, 8)) for o, n in ranges[:8])
            if head.startswith(magic):
                yield Block(source, "packet", magic.decode("latin-1"), ranges)
                return


def _boxes(file: Span, wide: bool) -> Iterator[tuple[str, int, int, int]]:
    """(type, begin, payload, end) of the boxes of a span; ``wide`` also takes 64-bit sizes and open ends."""
    at, end = file.begin, min(file.end, file.file.size)
    while at + 8 <= end:
        size, head = file.number(at, 4), 8
        if wide and size == 1:
            if at + 16 > file.end:
                return
            size, head = struct.unpack(">q", file.take(at + 8, 8))[0], 16
        elif wide and size == 0:
            size = file.end - at
        if size < head or at + size > end:
            return
        yield file.file.peek(at + 4, 4).decode("latin-1"), at, at + head, at + size
        at += size


def mp4_blocks(file: Span, depth: int = 0) -> Iterator[Block]:
    """Lyrics among the metadata boxes, which nest ``BOX_DEPTH`` deep at most."""
    for kind, _, begin, end in _boxes(file, True) if depth <= BOX_DEPTH else ():
        own = Span(file.file, begin, end)
        if kind in ("©lyr", "lyrc"):
            first = next(((b, e) for k, b, _, e in _boxes(own, False) if k == "data" and e - b > 16), None)
            if first:
                yield Block("MP4 metadata", "text", kind, [_payload(first[0] + 16, first[1])])
        elif kind == "----":
            parts = {k: _payload(b + skip, e) for k, b, _, e in _boxes(own, False) if (skip := {"name": 12, "data": 16}.get(k)) and e - b >= skip}
            if len(parts) == 2:
                yield Block("MP4 freeform", "named", "----", [parts["name"], parts["data"]])
        elif kind in ("moov", "udta", "ilst", "meta"):
            yield from mp4_blocks(Span(file.file, min(begin + 4 * (kind == "meta"), end), end), depth + 1)


def _payload(begin: int, end: int) -> tuple[int, int]:
    return begin, min(end - begin, TAG_BYTES)


def _chunks(file: Span) -> Iterator[tuple[str, int, int]]:
    """(id, payload, end) of RIFF chunks, which begin at even places."""
    at = file.begin
    while at + 8 <= file.end:
        size = file.number(at + 4, 4, "little")
        if at + 8 + size > file.end:
            return
        yield ascii_text(file.file.peek(at, 4)), at + 8, at + 8 + size
        at += 8 + size + size % 2


def riff_blocks(file: Span) -> Iterator[Block]:
    """ID3 chunks, and all INFO chunks by their ids."""
    for name, begin, end in _chunks(Span(file.file, 12, file.file.size)):
        if name.lower() == "id3 ":
            yield from id3_blocks(file, begin, "WAV ID3 chunk")
        elif name.lower() == "list" and begin + 4 <= end and file.file.peek(begin, 4) == b"INFO":
            for key, b, e in _chunks(Span(file.file, begin + 4, end)):
                yield Block("RIFF INFO", "info", key, [_payload(b, e)])


def ape_blocks(file: Span) -> Iterator[Block]:
    """The APEv2 tag whose footer is the file's last 32 bytes."""
    size = file.file.size
    footer = file.file.peek(size - 32, 32) if size >= 32 else b""
    if footer.startswith(b"APETAGEX"):
        length, count = struct.unpack("<ii", footer[12:20])
        if 32 <= length <= min(TAG_BYTES, size) and 0 <= count <= COMMENTS:
            yield Block("APEv2", "ape", "APETAGEX", [(size - length, length)])


def _primary(file: Span, container: list[str]) -> Iterator[Block]:
    head = file.file.peek(0, 16)
    if head.startswith(b"ID3"):
        container[0] = "MP3 / ID3"
        yield from id3_blocks(file, 0, "ID3")
        after = 10 + synchsafe(head[6:10]) if file.file.size >= 10 else -1
        if after >= 0 and file.file.peek(after, 4) == b"fLaC":
            container[0] = "FLAC with ID3"
            yield from flac_blocks(file, after)
    elif head.startswith(b"fLaC"):
        container[0] = "FLAC"
        yield from flac_blocks(file, 0)
    elif head.startswith(b"OggS"):
        container[0] = "Ogg / Opus"
        yield from ogg_blocks(file)
    elif len(head) >= 12 and head[4:8] == b"ftyp":
        container[0] = "MP4 / M4A"
        yield from mp4_blocks(file)
    elif head.startswith((b"RIFF", b"RF64")):
        container[0] = "WAV / RIFF"
        yield from riff_blocks(file)
    else:
        container[0] = "Audio"


def walk(file: Ranges) -> tuple[str, list[Block], list[str]]:
    """(container, tags, warnings) of a file; where a structure is broken the tags before it count."""
    container, blocks, warnings, whole = ["Unknown"], [], [], Span(file, 0, file.size)
    for name, own in ((_PRIMARY, _primary(whole, container)), (_TAIL, ape_blocks(whole))):
        try:
            for block in own:
                blocks.append(block)
        except (EOFError, ValueError, struct.error, IndexError) as broken:
            warnings.append(f"{name}: {broken or type(broken).__name__}")
    return container[0], blocks, warnings


# Splits: the entries of a tag.


def _frames(tag: bytes) -> Iterator[Entry]:
    """Frames of an ID3v2 tag, its head included."""
    version, flags, tag = tag[3], tag[5], tag[10:]
    if flags & 0x80:
        tag = tag.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3 and len(tag) >= 4:
        extended = synchsafe(tag) if version == 4 else int.from_bytes(tag[:4], "big", signed=True) + 4
        at = min(max(extended, 0), len(tag))
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(tag):
        raw = tag[at : at + name]
        size = synchsafe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + name : at + 2 * name], "big", signed=version == 3)
        if not raw.isalnum() or size <= 0 or at + head + size > len(tag):
            return
        yield Entry("frame", ascii_text(raw), tag[at + head : at + head + size])
        at += head + size


def _comments(raw: bytes, at: int) -> Iterator[Entry]:
    """``KEY=value`` comments, which a vendor's name precedes."""
    signed = lambda where: int.from_bytes(raw[where : where + 4], "little", signed=True)
    if at + 4 > len(raw) or (vendor := signed(at)) < 0 or at + 8 + vendor > len(raw):
        return
    at += 4 + vendor
    count, at = signed(at), at + 4
    for _ in range(count if 0 <= count <= COMMENTS else 0):
        if at + 4 > len(raw):
            return
        size, at = signed(at), at + 4
        if size < 0 or at + size > len(raw):
            continue
        key, equals, value = raw[at : at + size].partition(b"=")
        at += size
        if key and equals:
            yield Entry("utf8", key.decode("utf-8", "replace"), value)


def _ape_items(tag: bytes) -> Iterator[Entry]:
    at = 32 * tag.startswith(b"APETAGEX")
    for _ in range(int.from_bytes(tag[-16:-12], "little")):
        if at + 8 > len(tag) - 32:
            return
        length, at = int.from_bytes(tag[at : at + 4], "little", signed=True), at + 8
        end = tag.find(0, at)
        if end < 0 or length < 0 or end + 1 + length > len(tag):
            continue
        yield Entry("text", ascii_text(tag[at:end]), tag[end + 1 : end + 1 + length])
        at = end + 1 + length


def entries(kind: str, tag: str, parts: list[bytes]) -> Iterator[Entry]:
    """The entries of a tag whose ranges have these bytes."""
    if kind == "id3":
        yield from _frames(b"".join(parts))
    elif kind in ("comments", "packet"):
        yield from _comments(b"".join(parts), len(tag))
    elif kind == "ape":
        yield from _ape_items(b"".join(parts))
    elif kind == "named":
        yield Entry("text", trim(sniffed_text(parts[0])), parts[1])
    else:
        yield Entry("text", tag, b"".join(parts))


def can_be_lyrics(entry: Entry) -> bool:
    return entry.name in (*PLAIN_FRAMES, *TIMED_FRAMES, *TEXT_FRAMES) if entry.kind == "frame" else is_lyric_name(trim(entry.name))


# Decoders: the text of an entry.


def terminator(raw: bytes, start: int, encoding: int) -> int:
    """Where a text ends: a zero byte, or an aligned pair of them in 16-bit encodings; -1 if nowhere."""
    if encoding not in (1, 2):
        return raw.find(0, start)
    return next((i for i in range(start, len(raw) - 1, 2) if not raw[i] and not raw[i + 1]), -1)


def sniffed_text(raw: bytes) -> str:
    """UTF-16 by its byte order mark, which stays, or UTF-8."""
    if raw[:2] == b"\xff\xfe":
        return raw.decode("utf-16-le", "replace")
    return raw.decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "utf-8", "replace")


def id3_text(raw: bytes, encoding: int) -> str:
    if encoding == 1:  # the mark is taken off; without one the order is big-endian
        little, marked = raw[:2] == b"\xff\xfe", raw[:2] in (b"\xff\xfe", b"\xfe\xff")
        return raw[2 * marked :].decode("utf-16-le" if little else "utf-16-be", "replace")
    names = {0: "latin-1", 2: "utf-16-be", 3: "utf-8"}
    return raw.decode(names[encoding], "replace") if encoding in names else sniffed_text(raw)


def _width(frame: bytes) -> int:
    return 2 if frame[0] in (1, 2) else 1


def _after_description(frame: bytes, at: int) -> tuple[str, str] | None:
    """(description, text) of a frame whose description begins at a place."""
    end = terminator(frame, at, frame[0]) if len(frame) >= at else -1
    return None if end < 0 else (trim(id3_text(frame[at:end], frame[0])), id3_text(frame[end + _width(frame) :], frame[0]))


def timed_lines(frame: bytes) -> list[tuple[int | None, str]]:
    """(time, text) of the lines of a timed frame; times count only in milliseconds (format 2)."""
    if len(frame) < 7 or (end := terminator(frame, 6, frame[0])) < 0:
        return []
    at, lines, width = end + _width(frame), [], _width(frame)
    while at < len(frame):
        end = terminator(frame, at, frame[0])
        if end < 0 or end + width + 4 > len(frame):
            break
        text = trim(id3_text(frame[at:end], frame[0]))
        if text:
            lines.append((int.from_bytes(frame[end + width : end + width + 4], "big") if frame[4] == 2 else None, text))
        at = end + width + 4
    return lines


def lyrics(file: Ranges, block: Block) -> Iterator[tuple[str, str, list[tuple[int, str]] | None]]:
    """:func:`decoded` of the entries of a tag that are lyrics; blank texts only where a description names them."""
    if block.kind == "info" and not is_lyric_name(trim(block.tag)):
        return
    parts = [file.peek(offset, length) for offset, length in block.ranges]
    for entry in filter(can_be_lyrics, entries(block.kind, block.tag, parts)) if block.kind != "text" else entries(block.kind, block.tag, parts):
        found = decoded(entry)
        if found and (trim(found[1]) or entry.name in TEXT_FRAMES) and (entry.name not in TEXT_FRAMES or "lyric" in found[0].lower()):
            yield found


def decoded(entry: Entry) -> tuple[str, str, list[tuple[int, str]] | None] | None:
    """(name, text, timed lines) of an entry, untrimmed; the lines are None where times are to be read from the text."""
    kind, name, data = entry
    if kind == "utf8":
        return name, data.decode("utf-8", "replace"), None
    if kind == "text":
        return name, sniffed_text(data), None
    if name in TIMED_FRAMES:
        lines = timed_lines(data)
        timed = sorted(((t, x) for t, x in lines if t is not None), key=lambda line: line[0])
        return (name, "\n".join(x for _, x in lines), timed) if lines else None
    named = name in TEXT_FRAMES
    both = _after_description(data, 1 if named else 4)
    return None if both is None else (f"{name}:{both[0]}" if named else name, both[1], None)
