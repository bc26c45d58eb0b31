"""Running values over tracks of any length, in two phases: within ranges of a track, then over the ranges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a range, and milliseconds of one where rows are in order of time.
RANGE, RANGE_MS = 8192, 600_000


class Running(NamedTuple):
    """A value over the rows of a track before each row: the ``last`` that is not null, the ``max``, ``min`` or ``sum``.

    ``own`` takes the row itself in, ``back`` goes from the end of the track, and ``whole`` is over all its rows.
    """

    kind: str
    value: Column
    own: bool = False
    back: bool = False
    whole: bool = False


def _over(kind: str, value: Column, window: Window) -> Column:
    return {"last": lambda v: F.last(v, ignorenulls=True), "max": F.max, "min": F.min, "sum": F.sum}[kind](value).over(window)


def _both(kind: str, before: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, before)
    if kind == "sum":
        return F.when(before.isNull() | here.isNull(), F.coalesce(before, here)).otherwise(before + here)
    ordered = F.when(here.isNull() | ((before < here) if kind == "min" else (before > here)), before).otherwise(here)
    return F.coalesce(F.when(before.isNull(), here).otherwise(ordered), before)


def running(rows: DataFrame, key: str, order: list[str], wanted: dict[str, Running], width: int = RANGE) -> DataFrame:
    """``rows`` with the ``wanted`` running values over each ``key`` in order of ``order``, whose first column is a number.

    A track is cut into ranges of ``width`` of that number.  Rows are shuffled by track and range, so that a track
    however long is spread over all tasks, and get their values within the range; each range gives one row of totals,
    combined before its shuffle; a running value over these few rows is what came before a range, and joins back on the
    same partitioning.  Rows with equal numbers share a range.

    Null keys are one track; null numbers come first; values are null where there is nothing before.
    """
    number = F.floor(F.col(order[0]).cast("double") / width) if dict(rows.dtypes)[order[0]] in ("double", "float") else F.expr(f"`{order[0]}` - pmod(`{order[0]}`, {width})")
    # A struct is never null, so ranges of a null key, and of null numbers, join like any other.
    ranged = rows.withColumn("_range", F.struct(F.col(key).alias("key"), number.cast("long").alias("at")))
    names = [f"_value{i}" for i in range(len(wanted))]
    ranged = ranged.withColumns({n: w.value for n, w in zip(names, wanted.values(), strict=True)})
    place = F.struct(*order)
    totals = {}
    for name, w in zip(names, wanted.values(), strict=True):
        value = F.col(name)
        if w.kind == "last":
            pick = F.min_by if w.back else F.max_by
            totals[name] = pick(F.when(value.isNotNull(), value), F.when(value.isNotNull(), place))
        else:
            totals[name] = {"max": F.max, "min": F.min, "sum": F.sum}[w.kind](value)
    found = ranged.groupBy("_range").agg(*(t.alias(n) for n, t in totals.items()))
    ranges, apart = Window.partitionBy("_range.key"), []
    for name, w in zip(names, wanted.values(), strict=True):
        if w.whole:
            window = ranges
        else:
            window = ranges.orderBy(F.desc("_range.at") if w.back else F.asc("_range.at")).rowsBetween(Window.unboundedPreceding, -1)
        apart.append(_over(w.kind, F.col(name), window).alias(f"{name}_before"))
    before = found.select("_range", *apart)
    joined = ranged.join(before, "_range", "left")
    within, out = Window.partitionBy("_range"), {}
    for name, (alias, w) in zip(names, wanted.items(), strict=True):
        if w.whole:
            out[alias] = F.col(f"{name}_before")
            continue
        directed = within.orderBy(*(F.desc(c) if w.back else F.asc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0 if w.own else -1)
        out[alias] = _both(w.kind, F.col(f"{name}_before"), _over(w.kind, F.col(name), directed))
    return joined.withColumns(out).drop("_range", *names, *(f"{n}_before" for n in names))
