"""Alignment of tracks too long for one table: cut at anchors, runs of words that both sides have just once, into pieces."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versetime.operators.align import REFERENCE_WORDS, TRANSCRIPT_WORDS, matched_positions
from versetime.operators.scan import RANGE, Running, running
from versetime.staging import staged

#: Words of an anchor, and words that a piece has at least on both sides.
RUN, PIECE = 4, 400


def _runs(words: DataFrame, run: int, name: str) -> DataFrame:
    """``(track_id, run, name)``: runs of ``run`` words without an empty one that a track has once, and where they begin.

    Words are dealt by ranges of positions; those at the start of a range also go to the range before, so a run that
    crosses the border is whole there.
    """
    at = F.floor(F.col("pos") / RANGE)
    early = (F.col("pos") % RANGE < run - 1) & (F.col("pos") >= RANGE)
    dealt = words.select("track_id", "pos", "norm", F.explode(F.when(early, F.array(at, at - 1)).otherwise(F.array(at))).alias("at"))
    along = Window.partitionBy("track_id", "at").orderBy("pos")
    whole = F.array(*(F.lead("norm", i).over(along) for i in range(run)))
    runs = dealt.withColumn("run", whole).where((F.floor(F.col("pos") / RANGE) == F.col("at")) & F.forall("run", lambda w: F.coalesce(w != "", F.lit(False))))
    once = runs.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min("pos").alias(name)).where("n = 1")
    return once.select("track_id", "run", name)


def chained(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Positions of a longest run of anchors, in order of ``r``, whose ``t`` grows too."""
    tails, at, before = [], [], np.full(len(t), -1, np.int64)
    for i, x in enumerate(t.tolist()):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


def cuts(r: np.ndarray, t: np.ndarray, least: int = PIECE) -> list[tuple[int, int]]:
    """Starts of pieces: anchors of the chain that leave ``least`` words or more to the piece before, on both sides."""
    order = np.argsort(r, kind="stable")
    r, t = r[order], t[order]
    out = [(0, 0)]
    for i in chained(r, t).tolist():
        if r[i] - out[-1][0] >= least and t[i] - out[-1][1] >= least:
            out.append((int(r[i]), int(t[i])))
    return out


def pieces(reference: DataFrame, transcript: DataFrame, sizes: DataFrame, *, run: int = RUN, least: int = PIECE) -> DataFrame:
    """``(track_id, piece, r0, r1, t0, t1)`` of tracks ``reference(track_id, pos, norm)`` and ``transcript``, likewise.

    ``sizes(track_id, r, t)`` are the words of both sides; positions count from zero.  A piece begins with an anchor on
    both sides, the first with the tracks.  What a task holds of a track is its anchors, 16 bytes each.
    """

    def cut(table: pa.Table) -> pa.Table:
        starts = cuts(*(table.column(c).to_numpy().astype(np.int64) for c in ("r", "t")), least)
        return pa.table({"track_id": pa.array([table.column("track_id")[0].as_py()] * len(starts), table.schema.field("track_id").type), "piece": pa.array(range(len(starts)), pa.int64()), "r0": [s[0] for s in starts], "t0": [s[1] for s in starts]})

    met = staged(_runs(reference, run, "r").join(_runs(transcript, run, "t"), ["track_id", "run"]).select("track_id", "r", "t"), "anchors")
    kind = dict(reference.dtypes)["track_id"]
    found = met.groupBy("track_id").applyInArrow(cut, f"track_id {kind}, piece long, r0 long, t0 long")
    alone = sizes.join(met.select("track_id").distinct(), "track_id", "left_anti").select("track_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("r0"), F.lit(0).cast("long").alias("t0"))
    track = Window.partitionBy("track_id").orderBy("piece")
    ends = found.unionByName(alone).join(sizes, "track_id")
    return ends.select("track_id", "piece", "r0", F.coalesce(F.lead("r0").over(track), "r").alias("r1"), "t0", F.coalesce(F.lead("t0").over(track), "t").alias("t1"))


def _in_pieces(words: DataFrame, starts: DataFrame, start: str, kept: list[str]) -> DataFrame:
    """Words by ``(track_id, piece)``, each piece one array in order of position."""
    marks = starts.select("track_id", F.col(start).alias("pos"), F.lit(0).alias("kind"), F.struct("piece", F.col(start).alias("from")).alias("mark"))
    rows = words.select("track_id", "pos", F.lit(1).alias("kind"), *kept).unionByName(marks, allowMissingColumns=True)
    placed = running(rows, "track_id", ["pos", "kind"], {"within": Running("last", F.col("mark"), own=True)}).where("kind = 1 and within is not null")
    gathered = F.array_sort(F.collect_list(F.struct("pos", *kept)))
    return placed.groupBy("track_id", F.col("within.piece").alias("piece")).agg(gathered.alias("words"))


def long_matches(
    reference: DataFrame, transcript: DataFrame, sizes: DataFrame, *, most_reference: int = REFERENCE_WORDS, most_transcript: int = TRANSCRIPT_WORDS,
    run: int = RUN, least: int = PIECE, whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Matches ``(track_id, pos, hit)`` of long tracks, positions on both sides, and ``(track_id, status)`` of all.

    Each piece is aligned on its own, so a task holds one piece of each side and their table, whatever the track's length.
    Where the cheapest alignment goes through the anchors, as it does where a run that both sides have once isn't met by
    chance, the matches are those of the whole table.  A track with a piece of more than ``most_reference`` or
    ``most_transcript`` words, for want of an anchor within, has a status instead, and no matches.  With ``whole`` such a
    piece is aligned too, in a table of which some rows are held: time grows with the product of its sides, memory with
    its transcript and the root of its text.

    ``sizes(track_id, r, t)`` names the tracks, with the words of both sides, one at least.
    """
    own = staged(pieces(reference, transcript, sizes, run=run, least=least), "pieces")
    judged = own.groupBy("track_id").agg(F.max(F.col("r1") - F.col("r0")).alias("r"), F.max(F.col("t1") - F.col("t0")).alias("t"))
    longest = F.when(F.col("r") > most_reference, "text too long").when(F.col("t") > most_transcript, "transcript too long").otherwise("ok")
    status = judged.select("track_id", (F.lit("ok") if whole else longest).alias("status"))
    good = own.join(status.where("status = 'ok'"), "track_id", "left_semi")
    left = _in_pieces(reference, good, "r0", ["norm"]).withColumnRenamed("words", "own")
    right = _in_pieces(transcript, good, "t0", ["norm"]).withColumnRenamed("words", "heard")
    norms = lambda c: F.transform(c, lambda w: w["norm"])
    both = left.join(right, ["track_id", "piece"]).repartition(int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id", "piece")
    both = both.withColumn("mapping", matched_positions(norms("own"), norms("heard")))
    hit = lambda i: F.when(F.get("mapping", i) >= 0, F.get("heard", F.get("mapping", i))["pos"])
    found = both.select("track_id", F.explode(F.transform("own", lambda w, i: F.struct(w["pos"].alias("pos"), hit(i).alias("hit")))).alias("m"))
    return staged(found.select("track_id", "m.pos", "m.hit").where("hit is not null"), "long-matches"), status
