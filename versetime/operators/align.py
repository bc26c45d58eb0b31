"""Alignment of a trusted text with a noisy transcript: ordered fuzzy join and gap filling."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.functions.text import near_match
from versetime.operators.scan import Running, running

#: Words of a text and of a transcript that are aligned at most.
REFERENCE_WORDS, TRANSCRIPT_WORDS = 2500, 3500
#: Numbers of an alignment's table that are held at once; of a larger one some rows are, and it is made twice.
TABLE_CELLS = 10_000_000
#: Least time of a matched word and of one after the last match, and of a line.
WORD_MS, TRAILING_WORD_MS, LINE_MS = 60, 80, 200


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word}


def _one_edit(a: str, b: str) -> bool:
    """Whether two different words are at most one insertion, deletion or substitution apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near_words(reference: list[str], transcript: list[str]) -> dict[str, list[str]]:
    """For each distinct word of the text, those of the transcript that nearly match it (and are not equal).

    Words that begin with each other meet in a table of prefixes, words one edit apart in a table of the
    words with a letter taken out, so no two vocabularies are compared word by word.
    """
    starts, cuts = defaultdict(set), defaultdict(set)
    for word in set(transcript):
        for i in range(4, len(word) + 1):
            starts[word[:i]].add(word)
        if 4 <= len(word) <= 12:
            for cut in _deletions(word):
                cuts[cut].add(word)
    found = {}
    vocabulary = set(transcript)
    for word in set(reference):
        near = set(starts.get(word, ())) | {word[:i] for i in range(4, len(word)) if word[:i] in vocabulary}
        if 4 <= len(word) <= 12:
            for cut in _deletions(word):
                near |= {other for other in cuts.get(cut, ()) if not other.startswith(word) and not word.startswith(other) and _one_edit(word, other)}
        near.discard(word)
        found[word] = sorted(near)
    return found


@lru_cache(maxsize=1 << 16)
def near_word(a: str, b: str) -> bool:
    """Whether two different words nearly match, see :func:`versetime.functions.text.near_match`."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return len(short) >= 4 and (long.startswith(short) or (len(long) <= 12 and _one_edit(a, b)))


def _may_match(own: set[str], others: set[str]) -> set[str]:
    """The words with an equal or, as it may be, a near one on the other side.

    Of two near words one begins with the other, or both have 12 letters at most and begin or end with the same two.
    """
    alone = {word for word in own - others if len(word) >= 4}
    heads, firsts, tails = ({word[:2] for word in others}, {word[:4] for word in others}, {word[-2:] for word in others}) if alone else ((), (), ())
    return (own & others) | {word for word in alone if (word[:4] in firsts if len(word) > 12 else word[:2] in heads or word[-2:] in tails)}


def _reached(a: list[str], b: list[str], most: int) -> list[tuple[int, array]] | None:
    """By cost, and by the words that the transcript is ahead, how many words of the text are reached at most; null beyond ``most`` such states.

    ``(first, rows)`` of each cost up to the cheapest script's.  A state from which the end costs more than a limit is left
    out, and the limit grows until the end is reached; so each state that a cheapest script goes through is there.  It
    begins with the cost if all words that could be equal were, and the others of the shorter side near.
    """
    n, m = len(a), len(b)
    ahead, extra = m - n, min(n, m) - (Counter(a) & Counter(b)).total()
    while True:
        limit = abs(ahead) + extra
        if (limit + 1) * (extra + 1) > most:
            return None
        levels: list[tuple[int, array]] = []
        for cost in range(limit + 1):
            low, high = max(-cost, ahead - limit + cost, -n), min(cost, ahead + limit - cost, m)
            row = array("i", [-1]) * max(high - low + 1, 0)
            first, before = levels[-1] if levels else (0, array("i"))
            for k in range(low, high + 1):
                at = k - first
                i = -1 if cost else 0
                if 0 <= at < len(before) and before[at] >= 0:
                    i = before[at]
                    if i < n and i + k < m and near_word(a[i], b[i + k]):
                        i += 1
                if 0 < at <= len(before) and before[at - 1] > i:
                    i = before[at - 1]
                if -1 <= at < len(before) - 1 and before[at + 1] >= i and before[at + 1] >= 0:
                    i = before[at + 1] + 1
                if i < 0:
                    continue
                i = min(i, n, m - k)
                while i < n and i + k < m and a[i] == b[i + k]:
                    i += 1
                row[k - low] = i
            levels.append((low, row))
            if low <= ahead <= high and row[ahead - low] == n:
                return levels
        extra = 2 * extra + 4


def _sparse_words(reference: list[str], transcript: list[str]) -> list[int] | None:
    """:func:`align_words` in time that grows with the length times what the sides differ by; null where a table is less work.

    Words without a match on the other side cost the same in every script, so only the others are compared; the way back
    goes through all words, so it chooses between equal scripts as the table does.
    """
    texts, heards = set(reference), set(transcript)
    mine, theirs = _may_match(texts, heards), _may_match(heards, texts)
    a, b = [w for w in reference if w in mine], [w for w in transcript if w in theirs]
    levels = _reached(a, b, 64 + len(a) * (20 + len(b) // 100))
    if levels is None:
        return None

    def reaches(cost: int, k: int, rows: int) -> bool:
        if cost < 0:
            return False
        first, row = levels[cost]
        return 0 <= k - first < len(row) and row[k - first] >= rows

    i, j, x, y, cost = len(reference), len(transcript), len(a), len(b), len(levels) - 1
    mapping = [-1] * i
    while i and j:
        word, other = reference[i - 1], transcript[j - 1]
        if word == other:
            i, j, x, y = i - 1, j - 1, x - 1, y - 1
            mapping[i] = j
        elif (text := word in mine) & (heard := other in theirs):
            price = 1 if near_word(word, other) else 2
            if reaches(cost - price, y - x, x - 1):
                i, j, x, y, cost = i - 1, j - 1, x - 1, y - 1, cost - price
                if price == 1:
                    mapping[i] = j
            elif reaches(cost - 1, y - x + 1, x - 1):
                i, x, cost = i - 1, x - 1, cost - 1
            else:
                j, y, cost = j - 1, y - 1, cost - 1
        elif text:
            if reaches(cost - 1, y - x + 1, x - 1):
                i, x, cost = i - 1, x - 1, cost - 1
            j -= 1
        elif heard:
            if reaches(cost - 1, y - x - 1, x):
                j, y, cost = j - 1, y - 1, cost - 1
            i -= 1
        else:
            i, j = i - 1, j - 1
    return mapping


def align_words(reference: list[str], transcript: list[str], cells: int = TABLE_CELLS) -> list[int]:
    """For each word of the text the position of its match in the transcript, or -1.

    The cheapest edit script (equal 0, near 1, other 2, a gap 1), read back from the end: a diagonal step
    first, then a word of the text alone, then one of the transcript.  Diagonals that cost 2 match nothing.

    Where the sides agree in most words, only states near the cheapest script are made, else a table of all.
    """
    sparse = _sparse_words(reference, transcript)
    return table_words(reference, transcript, cells) if sparse is None else sparse


def table_words(reference: list[str], transcript: list[str], cells: int = TABLE_CELLS) -> list[int]:
    """:func:`align_words` by a table of all pairs of positions.

    A table of more than ``cells`` is made twice: first one row in so many is kept, about the root of their number, then,
    from the end, the rows between two of them.  The script is the same, at twice the time.
    """
    places = defaultdict(list)
    for j, word in enumerate(transcript):
        places[word].append(j)
    at = {word: np.array(own, np.int64) for word, own in places.items()}
    near_of = {word: frozenset(others) for word, others in near_words(reference, transcript).items()}
    close = {word: np.concatenate([at[o] for o in others]) for word, others in near_of.items() if others}
    n, m = len(reference), len(transcript)
    steps = np.arange(m + 1, dtype=np.int32)
    cost = np.full(m, 2, np.int32)

    def advance(before: np.ndarray, i: int, row: np.ndarray) -> None:
        word = reference[i - 1]
        same, near = at.get(word), close.get(word)
        if near is not None:
            cost[near] = 1
        if same is not None:
            cost[same] = 0
        np.add(before[:-1], cost, out=row[1:])
        for own in (near, same):
            if own is not None:
                cost[own] = 2
        np.minimum(row[1:], before[1:] + 1, out=row[1:])
        row[0] = i
        row -= steps
        np.minimum.accumulate(row, out=row)  # gaps in the text run on from the left
        row += steps

    def price(i: int, j: int) -> int:
        a, b = reference[i], transcript[j]
        return 0 if a == b else 1 if b in near_of[a] else 2

    block = n if (n + 1) * (m + 1) <= cells else int(n**0.5) + 1
    kept, row = [steps], steps
    for i in range(1, n + 1 if block < n else 1):
        row, before = np.empty(m + 1, np.int32), row
        advance(before, i, row)
        if i % block == 0:
            kept.append(row)
    mapping, i, j = [-1] * n, n, m
    for first in range((max(n - 1, 0) // max(block, 1)) * block, -1, -max(block, 1)):
        table = np.empty((i - first + 1, m + 1), np.int32)
        table[0] = kept[first // max(block, 1)]
        for k in range(first + 1, i + 1):
            advance(table[k - first - 1], k, table[k - first])
        while i > first or (j and not first):
            here, above = table[i - first], table[i - first - 1] if i > first else None
            cost_of = price(i - 1, j - 1) if above is not None and j else 0
            if above is not None and j and here[j] == above[j - 1] + cost_of:
                i, j = i - 1, j - 1
                if cost_of <= 1:
                    mapping[i] = j
            elif above is not None and here[j] == above[j] + 1:
                i -= 1
            else:
                j -= 1
    return mapping


def matched_positions(reference: Column, transcript: Column) -> Column:
    """Per row, :func:`align_words` of two arrays of normalised words; null where either is null."""

    @F.arrow_udf("array<int>")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else align_words(a, b) for a, b in rows], pa.list_(pa.int32()))

    return of(reference, transcript)


def alignment_status(reference_words: str, transcript_words: str, most_reference: int = REFERENCE_WORDS, most_transcript: int = TRANSCRIPT_WORDS) -> Column:
    """Why a text cannot be aligned, or ``ok``; by the sizes of both sides."""
    r, t = F.col(reference_words), F.col(transcript_words)
    return (
        F.when(r == 0, "no words in the text").when(r > most_reference, "text too long").when(t == 0, "no words in the transcript")
        .when(t > most_transcript, "transcript too long").otherwise("ok")
    )


def filled_gaps(words: DataFrame, key: str = "track_id", order: str = "pos") -> DataFrame:
    """Times for words of a text ``(track_id, pos, n_words, duration_ms, match_start, match_end, …)``, null where unmatched.

    A matched word keeps its time.  Others share the time between the matches around them, before the first,
    after the last (``TRAILING_WORD_MS`` each at least) or, without any match, the whole.  Positions count
    from zero.  Every word lasts ``WORD_MS``.  Each direction is a running value in two phases (:func:`running`), so a
    track of any length is spread over tasks.
    """
    hit = F.when(F.col("match_start").isNotNull(), F.struct(F.col(order).cast("long").alias("at"), "match_start", "match_end"))
    rows = running(words, key, [order], {"_p": Running("last", hit), "_n": Running("last", hit, back=True)})
    i = f"cast({order} as bigint)"
    rows = rows.withColumns({
        "_low": F.expr("case when _p is not null then _p.match_end else 0L end"),
        "_high": F.expr(
            f"case when _p is not null and _n is not null then greatest(_n.match_start, _p.match_end) when _n is not null then _n.match_start "
            f"when _p is not null then greatest(duration_ms, _p.match_end + {TRAILING_WORD_MS} * greatest(n_words - _p.at - 1, 1)) else duration_ms end"
        ),
        "_slots": F.expr("greatest(case when _p is not null and _n is not null then _n.at - _p.at when _n is not null then _n.at when _p is not null then n_words - _p.at - 1 else n_words end, 1)"),
        "_slot": F.expr(f"case when _p is not null then {i} - _p.at - 1 else {i} end"),
    })
    start = "coalesce(match_start, _low + (_high - _low) * _slot div _slots)"
    end = "case when match_start is not null then match_end else _low + (_high - _low) * (_slot + 1) div _slots end"
    timed = rows.withColumn("start_ms", F.expr(start)).withColumn("end_ms", F.expr(end))
    out = timed.withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + WORD_MS)).withColumn("matched", F.col("match_start").isNotNull())
    return out.drop("_p", "_n", "_low", "_high", "_slots", "_slot")


def gap_times(hits: list[int], begin: np.ndarray, end: np.ndarray, begun: np.ndarray, ended: np.ndarray, duration_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`filled_gaps` of one text in memory: ``(start_ms, end_ms, matched, without a time)`` of its words.

    ``hits`` are the positions of its matches, or -1, among words that ``begin`` and ``end`` at these times; ``begun`` and
    ``ended`` tell which of the times are not null.
    """
    hit = np.array(hits, np.int64)
    matched = (hit >= 0) & begun[hit]
    at, n, i = np.flatnonzero(matched), len(hit), np.arange(len(hit))
    # One more match stands for none, before the first word and after the last.
    place, own = np.append(at, -1), np.append(hit[at], -1)
    p, q = np.searchsorted(at, i) - 1, np.searchsorted(at, i, "right")
    before, after = p >= 0, q < len(at)
    over, known = np.where(before, end[own[p]], 0), ~before | ended[own[p]]
    trailing = np.where(before, np.maximum(duration_ms, over + TRAILING_WORD_MS * np.maximum(n - place[p] - 1, 1)), duration_ms)
    high = np.where(after, np.where(before, np.maximum(begin[own[q]], over), begin[own[q]]), trailing)
    slots = np.maximum(np.where(after, place[q] - np.where(before, place[p], 0), n - np.where(before, place[p], -1) - 1), 1)
    slot = i - np.where(before, place[p], -1) - 1

    def shared(k: np.ndarray) -> np.ndarray:
        whole, rest = np.divmod((high - over) * k, slots)
        return over + whole + ((whole < 0) & (rest > 0))  # cut off towards zero

    start, stop = shared(slot), shared(slot + 1)
    start[at], stop[at] = begin[hit[at]], np.where(ended[hit[at]], end[hit[at]], begin[hit[at]])
    return start, np.maximum(stop, start + WORD_MS), matched, ~matched & ~known


def aligned_lines(words: DataFrame, key: str = "track_id") -> DataFrame:
    """Lines ``(track_id, line_no, start_ms, end_ms, n_words, n_matched)`` of timed words."""
    start = F.min("start_ms")
    return words.groupBy(key, "line_no").agg(
        start.alias("start_ms"), F.greatest(F.max("end_ms"), start + LINE_MS).alias("end_ms"), F.count("*").alias("n_words"), F.count_if("matched").alias("n_matched")
    )


def alignment_summary(lines: DataFrame, key: str = "track_id") -> DataFrame:
    """``(track_id, n_lines, n_words, n_matched, confidence, duration_ms)`` of aligned lines."""
    share = (F.sum("n_matched") / F.sum("n_words")).cast("float")
    return lines.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"), F.sum("n_matched").alias("n_matched"),
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).cast("float").alias("confidence"), F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration_ms"),
    )


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the distinct words ``left(a)`` and ``right(b)`` that nearly match or are equal.

    Both sides are keyed by what a match implies: a common word after one letter is taken out, or one word as
    a beginning of the other.  The equi-join on keys is verified by the predicate; no word meets all others.
    """
    cut = lambda w: F.when(F.length(w).between(4, 12), F.concat(F.array(F.concat(F.lit("-"), w)), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("-"), F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))).otherwise(F.array().cast("array<string>"))
    whole = lambda w: F.when(F.length(w) >= 4, F.array(F.concat(F.lit("+"), w))).otherwise(F.array().cast("array<string>"))
    starts = lambda w: F.when(F.length(w) >= 4, F.transform(F.sequence(F.lit(4), F.length(w)), lambda i: F.concat(F.lit("+"), F.substring(w, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))

    def keyed(words: DataFrame, name: str, keys) -> DataFrame:
        return words.select(name, F.explode(F.array_distinct(keys)).alias("key"))

    a, b = F.col("a"), F.col("b")
    left, right = left.select("a").distinct(), right.select("b").distinct()
    one = keyed(left, "a", F.concat(cut(a), starts(a))).join(keyed(right, "b", F.concat(cut(b), whole(b))), "key")
    other = keyed(left, "a", whole(a)).join(keyed(right, "b", starts(b)), "key")
    return one.select("a", "b").unionByName(other.select("a", "b")).where(near_match(a, b)).distinct()
