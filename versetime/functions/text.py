"""Scalar functions of time-coded text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which tags hold lyrics.
LYRIC_KEYS = ("lyrics", "lyric", "unsyncedlyrics", "unsynchronizedlyrics", "syncedlyrics", "synchronizedlyrics", "lyrc", "ilyr", "uslt", "sylt")
#: White space and NUL at either end, by the definition of the JVM.
_EDGES = r"^[\s\x00\x1c-\x1f\p{Z}]+|[\s\x00\x1c-\x1f\p{Z}]+$"
LINE_BREAK = r"\r\n|\n|\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and deep in functions of arrays it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    """Without NUL and Unicode white space at either end."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def visible_tokens(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def normalized(text: Column, kept: str = "") -> Column:
    """Lower case; letters, digits and apostrophes of the basic plane only, and what separates words, if ``kept``."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{Nd}}'{kept}]|[\x{{10000}}-\x{{10FFFF}}]", "")


def clean_spacing(text: Column) -> Column:
    """No white space before a closing mark, none at the ends."""
    return trimmed(F.regexp_replace(text, r"\s+([,.!?;:])", "$1"))


def single_spaced(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_lyric_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(key), "[_-]", "")).isin(*LYRIC_KEYS)


def is_lyric_name(key: str) -> bool:
    """:func:`is_lyric_key` of one trimmed key, for readers that choose what they decode."""
    return key.replace("_", "").replace("-", "").lower() in LYRIC_KEYS


def is_section_heading(line: Column) -> Column:
    """A line that is wholly in square brackets."""
    return line.rlike(r"^\s*\[[^\]]+\]\s*$")


def near_match(a: Column, b: Column) -> Column:
    """Whether two normalised words nearly agree.

    If one begins with the other, the shorter must have four letters, which decides it.  Otherwise both have
    4 to 12 letters and differ by one edit.  Empty words never do.
    """
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), F.lit(False))
        .when(a.startswith(b) | b.startswith(a), short >= 4)
        .when((long > 12) | (short < 4), F.lit(False))
        .otherwise(F.levenshtein(a, b, 1) >= 0)
    )


def clock_ms(clock: Column) -> Column:
    """Milliseconds of ``hh:mm:ss.mmm``; seconds are a double, and what is left of a millisecond is cut off."""
    part = lambda i: F.split_part(clock, F.lit(":"), F.lit(i))
    whole = (part(1).cast("long") * 3600 + part(2).cast("long") * 60) * 1000
    return (whole + part(3).cast("double") * 1000.0).cast("long")


def spread(tokens: Column, start: Column, end: Column, least_ms: int) -> Column:
    """Array of ``(text, start_ms, end_ms)``: the tokens share the time evenly, ``least_ms`` each at least."""
    def shared(own: Column) -> Column:
        count = F.greatest(F.size(own), F.lit(1)).cast("long")
        span = F.greatest(end - start, F.size(own).cast("long") * least_ms)
        at = lambda i: start + _div(span * i, count)
        return F.transform(own, lambda t, i: F.struct(t.alias("text"), at(i.cast("long")).alias("start_ms"), at(i.cast("long") + 1).alias("end_ms")))

    return let(tokens, shared)


def _div(a: Column, b: Column) -> Column:
    """Whole-number division that cuts off towards zero."""
    return F.call_function("div", a, b)


def word_range(line: Column, token: Column) -> Column:
    """``(first, end)`` of the first occurrence of a token in a line, letter case aside; null if there is none."""
    clean = trimmed(token)
    at = F.position(F.lower(clean), F.lower(line))
    return F.when((clean != "") & (at > 0), F.struct((at - 1).alias("first"), F.least(at - 1 + F.length(clean), F.length(line)).alias("end")))


def format_duration(ms: Column) -> Column:
    seconds = _div(ms.cast("long"), F.lit(1000).cast("long"))
    hours, minutes, rest = _div(seconds, F.lit(3600).cast("long")), _div(seconds % 3600, F.lit(60).cast("long")), seconds % 60
    return F.when(ms.isNull(), None).when(ms < 0, "Unknown").when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def format_bytes(size: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size.isNull(), None).when(size < 0, "Unknown size").when(size < kb, F.format_string("%d B", size.cast("long")))
        .when(size < mb, F.format_string("%.1f KB", size / kb)).when(size < gb, F.format_string("%.1f MB", size / mb)).otherwise(F.format_string("%.1f GB", size / gb))
    )


def encoder_dimensions(width: Column, height: Column, longest: int = 1920) -> Column:
    """``(width, height)`` scaled down to ``longest``, rounded half up, even, 2 at least."""
    scale = F.least(F.lit(1.0).cast("float"), (F.lit(float(longest)).cast("float") / F.greatest(width, height).cast("float")).cast("float"))

    def side(n: Column) -> Column:
        rounded = F.greatest(F.floor((n.cast("float") * scale).cast("double") + 0.5).cast("int"), F.lit(2))
        return F.greatest(rounded - rounded % 2, F.lit(2))

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def language_of_model(file_name: Column) -> Column:
    """``en`` for a model file whose name says so, else null."""
    return F.when(F.contains(F.lower(file_name), F.lit(".en-")), "en")


def display_name(source: Column, tag: Column, timed: Column) -> Column:
    return F.concat_ws(" • ", source, tag, F.when(timed, "timed"))
