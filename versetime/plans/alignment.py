"""Alignment of tracks: timed texts, transcripts alone, and plain texts against transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetime.functions.text import is_blank, normalized, visible_tokens
from versetime.operators.align import REFERENCE_WORDS, TRANSCRIPT_WORDS, align_words, aligned_lines, alignment_status, alignment_summary, filled_gaps, gap_times, matched_positions
from versetime.operators.anchors import long_matches
from versetime.operators.lrc import line_rows, lrc_lines, timed_alignment, word_rows
from versetime.operators.scan import Running, running
from versetime.operators.words import WORD_MS, line_numbers, reference_lines, segment_words
from versetime.staging import staged

WORD_COLUMNS = ["track_id", "line_no", "word_no", "text", "start_ms", "end_ms", "matched"]


def timed_words(tracks: DataFrame) -> DataFrame:
    """Aligned words of tracks ``(track_id, text, audio_ms)`` whose text is LRC; no shuffle."""
    lines = tracks.select("track_id", timed_alignment(lrc_lines(F.col("text")), F.col("audio_ms")).alias("lines"))
    return word_rows(line_rows(lines)).select(*WORD_COLUMNS)


def transcript_words(words: DataFrame) -> DataFrame:
    """Aligned words of transcripts ``(track_id, ord, text, start_ms, end_ms)`` by themselves, in lines."""
    numbered = line_numbers(words)
    rows = numbered.withColumn("word_no", F.row_number().over(Window.partitionBy("track_id", "line_no").orderBy("ord")) - 1)
    return rows.withColumn("matched", F.lit(True)).select(*WORD_COLUMNS)


def text_words(text: Column) -> Column:
    """Words ``(line_no, word_no, text)`` of the lines of a text."""
    return F.flatten(F.transform(reference_lines(text), lambda line, i: F.transform(visible_tokens(line), lambda w, j: F.struct(i.alias("line_no"), j.alias("word_no"), w.alias("text")))))


_SPOKEN = "array<struct<ord:bigint,text:string,start_ms:bigint,end_ms:bigint>>"


def _hits(rows: DataFrame) -> DataFrame:
    """Words of texts ``(…, tokens, spoken)`` that fit one table each, with the times of their matches."""
    norm = lambda c: F.transform(c, lambda w: normalized(w["text"]))
    rows = rows.withColumn("mapping", matched_positions(norm("tokens"), norm("spoken")))
    hit = lambda i: F.when(F.get("mapping", i) >= 0, F.get("spoken", F.get("mapping", i)))
    found = F.transform("tokens", lambda w, i: F.struct(w["line_no"].alias("line_no"), w["word_no"].alias("word_no"), w["text"].alias("text"), hit(i).alias("hit")))
    words = rows.select("track_id", "n_words", "duration_ms", F.posexplode(found).alias("pos", "w"))
    return words.select("track_id", "n_words", "duration_ms", "pos", "w.line_no", "w.word_no", "w.text", F.col("w.hit.start_ms").alias("match_start"), F.col("w.hit.end_ms").alias("match_end"))


def plain_words(tracks: DataFrame, words: DataFrame, *, most_reference: int = REFERENCE_WORDS, most_transcript: int = TRANSCRIPT_WORDS) -> DataFrame:
    """``(…words of the text…, status)`` of tracks ``(track_id, text, audio_ms, transcript_ms)`` against their transcript.

    Words are counted first.  Only where both sides are within the limits is a transcript gathered, one array a track, and
    aligned in one table.  Longer tracks stay rows: they are cut into pieces of that size at anchors
    (:func:`~versetime.operators.anchors.long_matches`).  A track that cannot be aligned gives one row with its status and
    no word: without words on a side, or with more than the limit between two anchors.  :func:`whole_words` has no limits.
    """
    tokens = text_words(F.col("text"))
    counted = words.groupBy("track_id").agg(F.count("*").alias("t"), F.max_by("end_ms", "ord").alias("last_ms"))
    sizes = tracks.select("track_id", "audio_ms", "transcript_ms", F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("r")).join(counted, "track_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    end = F.greatest(F.col("audio_ms"), F.coalesce("transcript_ms", F.lit(0)), F.col("last_ms"))
    judged = staged(sizes.select("track_id", "r", "t", F.col("r").alias("n_words"), end.alias("duration_ms"), alignment_status("r", "t", most_reference, most_transcript).alias("status")), "track-sizes")
    ok, longer = F.col("status") == "ok", (F.col("r") > 0) & (F.col("t") > 0) & (F.col("status") != "ok")
    texts = tracks.select("track_id", tokens.alias("tokens")).join(judged, "track_id")
    # A few bytes are much work here: tracks are dealt over all tasks, not over as few as their size asks for.
    dealt = lambda df: df.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id")
    spoken = dealt(words.join(judged.where(ok), "track_id", "left_semi")).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "start_ms", "end_ms"))).cast(_SPOKEN).alias("spoken"))
    good = _hits(dealt(texts.where(ok)).join(spoken, "track_id"))
    failed = judged.where("r = 0 or t = 0").select("track_id", "status")
    if not judged.where(longer).isEmpty():
        found, status = _long_hits(texts.where(longer), words, judged.where(longer), most_reference, most_transcript)
        good, failed = good.unionByName(found), failed.unionByName(status.where("status <> 'ok'"))
    out = filled_gaps(staged(good, "matched-words")).select(*WORD_COLUMNS, F.lit("ok").alias("status"))
    return out.unionByName(failed, allowMissingColumns=True)


def _long_hits(texts: DataFrame, words: DataFrame, sizes: DataFrame, most_reference: int, most_transcript: int) -> tuple[DataFrame, DataFrame]:
    """:func:`_hits` of tracks that are too long for one table, and the status of each."""
    rows = texts.select("track_id", "n_words", "duration_ms", F.posexplode("tokens").alias("pos", "w"))
    reference = staged(rows.select("track_id", "n_words", "duration_ms", F.col("pos").cast("long").alias("pos"), "w.line_no", "w.word_no", "w.text", normalized(F.col("w.text")).alias("norm")), "long-texts")
    own = staged(words.join(sizes, "track_id", "left_semi").select("track_id", "ord", "start_ms", "end_ms", normalized(F.col("text")).alias("norm")), "long-words")
    numbered = running(own, "track_id", ["ord"], {"pos": Running("sum", F.lit(1))})
    transcript = staged(numbered.withColumn("pos", F.coalesce("pos", F.lit(0)).cast("long")), "long-transcripts")
    matches, status = long_matches(reference, transcript, sizes.select("track_id", "r", "t"), most_reference=most_reference, most_transcript=most_transcript)
    times = matches.join(transcript.select("track_id", F.col("pos").alias("hit"), F.col("start_ms").alias("match_start"), F.col("end_ms").alias("match_end")), ["track_id", "hit"])
    cut = reference.join(status.where("status = 'ok'"), "track_id", "left_semi").join(times.drop("hit"), ["track_id", "pos"], "left")
    return cut.select("track_id", "n_words", "duration_ms", F.col("pos").cast("int").alias("pos"), "line_no", "word_no", "text", "match_start", "match_end"), status


_STATUS = pa.array(["ok", "no words in the text", "no words in the transcript"])
#: A text's words, and the words that are given on at once, if the track's end comes soon.
_TOKEN, _SLICE = re.compile(r"[^ \t\n\x0b\x0c\r]+"), 20_000


def _rows(tracks: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    """Rows of the tracks ``(row, n words or 1, status, words, line numbers, word numbers, *times)`` of a batch."""
    at, n, status, words, *numbers = zip(*found, strict=True)
    line_no, word_no, start, end, matched, untimed = (np.concatenate(c) for c in numbers)
    status = np.repeat(status, n)
    failed, ids = status > 0, tracks.column("track_id").take(pa.array(np.repeat(at, n)))
    columns = [
        ids, pa.array(line_no, pa.int32(), mask=failed), pa.array(word_no, pa.int32(), mask=failed), pa.array(list(chain.from_iterable(words)), pa.string()),
        *(pa.array(c, pa.int64(), mask=untimed) for c in (start, end)), pa.array(matched, pa.bool_(), mask=failed), _STATUS.take(pa.array(status)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["track_id", *WORD_COLUMNS[1:], "status"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with times, or a status, of tracks ``(track_id, audio_ms, transcript_ms, lines, norm, heard, starts, ends)``."""
    nothing = [np.array([0]), np.array([0]), np.array([0]), np.array([0]), np.array([False]), np.array([True])]
    for tracks in batches:
        given = [tracks.column(c) for c in ("starts", "ends")]
        offsets = given[0].offsets.to_numpy()
        (begin, begun), (end, ended) = ((c.values.fill_null(0).to_numpy(), c.values.is_valid().to_numpy(zero_copy_only=False)) for c in given)
        found, held = [], 0
        for at in range(tracks.num_rows):
            audio, transcript, lines, norm, heard = (tracks.column(c)[at].as_py() for c in ("audio_ms", "transcript_ms", "lines", "norm", "heard"))
            if not lines or heard is None:
                found.append((at, 1, 2 if lines else 1, [None], *nothing))
                held += 1
            else:
                tokens = [_TOKEN.findall(line) for line in lines.split("\n")]
                sizes = np.array([len(own) for own in tokens])
                n, own = int(sizes.sum()), slice(offsets[at], offsets[at + 1])
                last = int(end[own][-1]) if ended[own][-1] else None
                duration = max(x for x in (audio, transcript or 0, last) if x is not None)
                times = gap_times(align_words(norm.split(" "), heard.split("\n")), begin[own], end[own], begun[own], ended[own], duration)
                word_no = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found.append((at, n, 0, chain.from_iterable(tokens), np.repeat(np.arange(len(sizes)), sizes), word_no, *times))
                held += n
            if held >= _SLICE:
                yield _rows(tracks, found)
                found, held = [], 0
        if found:
            yield _rows(tracks, found)


def whole_words(tracks: DataFrame, words: DataFrame) -> DataFrame:
    """:func:`plain_words` without limits: every track is aligned whole, however long, in one pass.

    Both sides are shuffled by track unless they already are, and a track's words come together once, in one task.  They
    go through one Python step, as a text of each side whose words are told apart by what a normalised word never holds.
    """
    said = F.translate(F.coalesce("text", F.lit("")), "\n", " ")
    spoken = F.array_sort(F.collect_list(F.struct("ord", said.alias("text"), "start_ms", "end_ms"))).cast(_SPOKEN)
    heard = words.groupBy("track_id").agg(spoken.alias("spoken")).select(
        "track_id", normalized(F.array_join("spoken.text", "\n"), r"\n").alias("heard"), F.col("spoken.start_ms").alias("starts"), F.col("spoken.end_ms").alias("ends")
    )
    lines = tracks.select("track_id", "audio_ms", "transcript_ms", F.array_join(reference_lines(F.col("text")), "\n").alias("lines"))
    norm = normalized(F.regexp_replace("lines", r"\s+", " "), " ")
    rows = lines.join(heard, "track_id", "left").select("track_id", "audio_ms", "transcript_ms", "lines", norm.alias("norm"), "heard", "starts", "ends")
    return rows.mapInArrow(_aligned, f"track_id {dict(tracks.dtypes)['track_id']}, line_no int, word_no int, text string, start_ms long, end_ms long, matched boolean, status string")


def track_kind(text: Column) -> Column:
    """``timed`` for a text with timestamps, ``blank`` for one without any character, else ``plain``."""
    return F.when(F.size(lrc_lines(text)) > 0, "timed").when(is_blank(F.coalesce(text, F.lit(""))), "blank").otherwise("plain")


def align(tracks: DataFrame, words: DataFrame, segments: DataFrame, *, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Aligned words and lines of tracks ``(track_id, text, audio_ms, transcript_ms)``; with ``whole``, plain texts by :func:`whole_words`.

    A text with timestamps gives its own times; a blank one its transcript's; any other is aligned with the
    transcript, or, where there are no words, with those of the segments ``(track_id, ord, text, start_ms,
    end_ms)``.  The tracks are told apart first, so only plain texts reach the fuzzy join.  Words have a
    ``status``, ``ok`` or the reason why a track has none.
    """
    kinds = staged(tracks.withColumn("kind", track_kind(F.col("text"))), "track-kinds")
    heard = words.select("track_id").distinct()
    by_segment = segment_words(segments.join(heard, "track_id", "left_anti").withColumnRenamed("ord", "seg"), WORD_MS)
    spread = by_segment.withColumn("ord", F.col("seg").cast("long") * 1_000_000 + F.col("word_no")).select("track_id", "ord", "text", "start_ms", "end_ms")
    plain = kinds.where("kind = 'plain'")
    spoken = words.select("track_id", F.col("ord").cast("long").alias("ord"), "text", "start_ms", "end_ms").unionByName(spread)
    # The words of other tracks go before they are counted, gathered or written.
    spoken = staged(spoken.join(plain.select("track_id"), "track_id", "left_semi"), "plain-words")
    blank = kinds.where("kind = 'blank'").select("track_id")
    alone = transcript_words(words.join(blank, "track_id", "left_semi"))
    lines_of = by_segment.join(blank, "track_id", "left_semi").withColumn("line_no", F.col("seg")).withColumn("matched", F.lit(True)).select(*WORD_COLUMNS)
    # A few bytes are much work here: tracks are dealt over all tasks, not over as few as their size asks for.
    dealt = lambda df: df.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id")
    aligned = whole_words(dealt(plain), dealt(spoken)) if whole else plain_words(plain, spoken)
    ok = lambda df: df.withColumn("status", F.lit("ok"))
    found = ok(timed_words(kinds.where("kind = 'timed'"))).unionByName(ok(alone)).unionByName(ok(lines_of)).unionByName(aligned)
    return found, aligned_lines(found.where("status = 'ok'"))


def results(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """The summary of each aligned track of ``tracks(track_id, text, source)``, with where its text comes from.

    ``source`` is the track's own, or ``Transcription`` where its text is blank.
    """
    label = F.when(track_kind(F.col("text")) == "blank", F.lit("Transcription")).otherwise(F.col("source"))
    return alignment_summary(lines).join(tracks.select("track_id", label.alias("source")), "track_id")
