"""LRC texts: lines with timestamps, as arrays computed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.functions.text import LINE_BREAK, let, spread, trimmed, visible_tokens

LINES = "array<struct<start_ms:bigint,text:string>>"
# The syntax of LRC.
STAMP = r"\[(\d{1,3}):(\d{2})(?:[.:](\d{1,3}))?\]"
OFFSET = r"(?i)\[offset:([+-]?\d+)\]"
#: A line lasts so long at least, and the last so long after its start.
LEAST_LINE_MS, LAST_LINE_MS, LEAST_WORD_MS = 300, 2000, 80


def offset_ms(text: Column) -> Column:
    """The first offset that the text names; zero if it names none that is a number."""
    return F.coalesce(F.nullif(F.regexp_extract(text, OFFSET, 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("long"))


def lrc_lines(text: Column) -> Column:
    """Array of ``(start_ms, text)`` in order of time, one for each timestamp of a line with text.

    The offset is added to all lines; times are zero at least.  Of equal times the one further up comes first,
    and of equal lines only one stays.  Nothing is shuffled: a text's lines are sorted where it is.
    """
    number = lambda stamp, group: F.regexp_extract(stamp, STAMP, group)

    def time(stamp: Column, offset: Column) -> Column:
        fraction = F.rpad(number(stamp, 3), 3, "0").cast("long")
        return F.greatest(number(stamp, 1).cast("long") * 60_000 + number(stamp, 2).cast("long") * 1000 + fraction + offset, F.lit(0).cast("long"))

    def of_line(line: Column, i: Column, offset: Column) -> Column:
        stamps = F.regexp_extract_all(line, F.lit(STAMP), F.lit(0))
        rows = lambda lyric: F.transform(stamps, lambda s, j: F.struct(time(s, offset).alias("start_ms"), i.alias("i"), j.alias("j"), lyric.alias("text")))
        return F.filter(let(trimmed(F.regexp_replace(line, STAMP, "")), rows), lambda x: x["text"] != "")

    timed = F.filter(F.split(text, LINE_BREAK, -1), lambda line: line.rlike(STAMP))
    found = let(offset_ms(text), lambda offset: F.array_sort(F.flatten(F.transform(timed, lambda line, i: of_line(line, i, offset)))))
    return F.array_distinct(F.transform(found, lambda x: F.struct(x["start_ms"].alias("start_ms"), x["text"].alias("text"))))


def timed_alignment(lines: Column, audio_ms: Column) -> Column:
    """Lines with ends and evenly spread words: a line lasts until the next, the last until the audio ends.

    Array of ``(text, start_ms, end_ms, words)``; all words count as matched.
    """
    def timed(own: Column) -> Column:
        end_of_all = F.greatest(audio_ms, F.coalesce(F.get(own, F.size(own) - 1)["start_ms"], F.lit(0)) + LAST_LINE_MS)

        def line(x: Column, i: Column) -> Column:
            end = F.greatest(x["start_ms"] + LEAST_LINE_MS, F.coalesce(F.get(own, i + 1)["start_ms"], end_of_all))
            return F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), end.alias("end_ms"))

        return F.transform(own, line)

    def words(x: Column) -> Column:
        spoken = spread(visible_tokens(x["text"]), x["start_ms"], x["end_ms"], LEAST_WORD_MS)
        matched = F.transform(spoken, lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), F.lit(True).alias("matched")))
        return F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), matched.alias("words"))

    return F.transform(let(lines, timed), words)


def line_rows(tracks: DataFrame, lines: str = "lines") -> DataFrame:
    """A row for each element of the array column ``lines``, numbered from zero in ``line_no``."""
    others = [c for c in tracks.columns if c != lines]
    return tracks.select(*others, F.posexplode(lines).alias("line_no", "line")).select(*others, "line_no", "line.*")


def word_rows(lines: DataFrame) -> DataFrame:
    """A row for each word of :func:`line_rows` of an alignment."""
    others = [c for c in lines.columns if c not in ("words", "text", "start_ms", "end_ms")]
    return lines.select(*others, F.posexplode("words").alias("word_no", "word")).select(*others, "word_no", "word.*")
