"""Media files built in code."""

import struct


def synchsafe(n):
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def frame(name, body, version=3):
    size = {2: len(body).to_bytes(3, "big"), 3: struct.pack(">i", len(body)), 4: synchsafe(len(body))}[version]
    return name + size + (b"" if version == 2 else b"\0\0") + body


def id3(frames, version=3, flags=0, before=b""):
    body = before + frames
    return b"ID3" + bytes([version, 0, flags]) + synchsafe(len(body)) + body


def uslt(text, encoding=3):
    raw = {0: text.encode("latin-1"), 1: text.encode("utf-16"), 2: text.encode("utf-16-be"), 3: text.encode()}[encoding]
    return bytes([encoding]) + b"eng" + (b"\0\0" if encoding in (1, 2) else b"\0") + raw


def sylt(lines, time_format=2):
    return bytes([3]) + b"eng" + bytes([time_format, 1]) + b"\0" + b"".join(t.encode() + b"\0" + struct.pack(">I", ms) for t, ms in lines)


def vorbis(*pairs):
    entries = [f"{k}={v}".encode() for k, v in pairs]
    return struct.pack("<I", 4) + b"test" + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)


def flac(comments):
    return b"fLaC" + bytes([0x84]) + len(comments).to_bytes(3, "big") + comments


def ogg(packets, page=255 * 200):
    """One page for each packet; a packet above 255 x 255 bytes is not needed here."""
    out = b""
    for packet in packets:
        laces = [255] * (len(packet) // 255) + [len(packet) % 255]
        for at in range(0, len(laces), 3):  # three laces a page, so that packets go over pages
            own = laces[at : at + 3]
            body = packet[at * 255 : at * 255 + sum(own)]
            out += b"OggS" + bytes(22) + bytes([len(own)]) + bytes(own) + body
    return out


def box(kind, body, wide=False):
    if wide:
        return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(*items, wide=False):
    ilst = box(b"ilst", b"".join(items))
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"udta", box(b"meta", bytes(4) + ilst)), wide)


def lyr(text):
    return box(b"\xa9lyr", box(b"data", bytes(8) + text.encode()))


def freeform(name, text):
    return box(b"----", box(b"mean", bytes(4) + b"com") + box(b"name", bytes(4) + name.encode()) + box(b"data", bytes(8) + text.encode()))


def riff(*chunks):
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def ape(*pairs, header=False):
    items = b"".join(struct.pack("<ii", len(v.encode()), 0) + k.encode() + b"\0" + v.encode() for k, v in pairs)
    size = len(items) + 32 + 32 * header
    mark = b"APETAGEX" + struct.pack("<iiii", 2000, size, len(pairs), 0) + bytes(8)
    return (mark if header else b"") + items + mark
