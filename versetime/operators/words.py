"""Tokens with interpolated times, and words grouped into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.functions.text import LINE_BREAK, clean_spacing, is_section_heading, normalized, single_spaced, spread, trimmed, visible_tokens
from versetime.operators.scan import Running, running

#: Words of a line, and the pause that ends one.
LINE_WORDS, PAUSE_MS, LEAST_LINE_MS = 8, 850, 200
#: Least time of a word of a recognised segment, and of one elsewhere.
SEGMENT_WORD_MS, WORD_MS = 70, 80


def reference_lines(text: Column) -> Column:
    """Lines with words that aren't section headings, trimmed."""
    lines = F.transform(F.split(text, LINE_BREAK, -1), trimmed)
    return F.filter(lines, lambda x: (x != "") & ~is_section_heading(x) & x.rlike(r"\S"))


def token_rows(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(…, line_no, word_no, token, norm)`` of every line of a text; other columns stay.

    A generator in a generator: nothing is shuffled, and ``line_no, word_no`` order a text's tokens.
    """
    others = [c for c in texts.columns if c != text_col]
    lines = texts.select(*others, F.posexplode(reference_lines(F.col(text_col))).alias("line_no", "_line"))
    words = lines.select(*others, "line_no", F.posexplode(visible_tokens(F.col("_line"))).alias("word_no", "token"))
    return words.withColumn("norm", normalized(F.col("token")))


def segment_words(segments: DataFrame, least_ms: int = SEGMENT_WORD_MS) -> DataFrame:
    """Words of segments ``(…, text, start_ms, end_ms)`` that share each segment's time evenly."""
    others = [c for c in segments.columns if c not in ("text", "start_ms", "end_ms")]
    words = spread(visible_tokens(F.col("text")), F.col("start_ms"), F.col("end_ms"), least_ms)
    return segments.select(*others, F.posexplode(words).alias("word_no", "word")).select(*others, "word_no", "word.*")


def transcripts(segments: DataFrame, key: str = "track_id", order: str = "ord") -> DataFrame:
    """``(track_id, text, end_ms)``: the segments' texts in order, single-spaced, and the last end."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return segments.groupBy(key).agg(single_spaced(text).alias("text"), F.max("end_ms").alias("end_ms"))


def line_numbers(words: DataFrame, key: str = "track_id", order: str = "ord", *, line_words: int = LINE_WORDS, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Words ``(track_id, ord, text, start_ms, end_ms)`` with the ``line_no`` they fall in.

    A line ends after a word with a closing mark, before a pause of more than ``pause_ms``, and when it has
    ``line_words`` words.  Breaks by marks and pauses cut a track into stretches; the words of a stretch are
    counted off.  The three running values are in two phases, so a track of any length is spread over tasks.
    """
    closes = F.substring("text", -1, 1).isin(".", "!", "?", ";", ":")
    numbered = running(words, key, [order], {"_last": Running("last", F.struct(closes.alias("closes"), "end_ms")), "_n": Running("sum", F.lit(1), own=True)})
    breaks = F.coalesce(F.col("_last.closes") | (F.col("start_ms") - F.col("_last.end_ms") > pause_ms), F.lit(False))
    rows = numbered.withColumn("_break", breaks)
    rows = running(rows, key, [order], {"_stretch": Running("max", F.when(F.col("_break"), F.col("_n")), own=True)})
    place = F.col("_n") - F.coalesce("_stretch", F.lit(1))
    begins = F.when(F.col("_n") == 1, 0).when(F.col("_break") | (place % line_words == 0), 1).otherwise(0)
    return running(rows, key, [order], {"line_no": Running("sum", begins, own=True)}).drop("_last", "_break", "_n", "_stretch")


def transcript_lines(words: DataFrame, key: str = "track_id", order: str = "ord", *, line_words: int = LINE_WORDS, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Lines ``(track_id, line_no, text, start_ms, end_ms, n_words)`` of words, see :func:`line_numbers`."""
    numbered = line_numbers(words, key, order, line_words=line_words, pause_ms=pause_ms)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    first, last = F.min_by("start_ms", order), F.max_by("end_ms", order)
    return numbered.groupBy(key, "line_no").agg(
        clean_spacing(F.array_join(ordered, " ")).alias("text"), first.alias("start_ms"), F.greatest(last, first + LEAST_LINE_MS).alias("end_ms"), F.count("*").alias("n_words")
    )
