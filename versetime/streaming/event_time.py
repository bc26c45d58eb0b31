"""Operators of a stream that go by the time of an event, not by when it came in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from versetime.functions.text import normalized
from versetime.operators.asof import line_changes
from versetime.operators.windows import REPEAT_MS, accepted_segments
from versetime.staging import staged

#: The setting and the store that keeps these operators' state, on disk and in the stream's checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_NO_TIME = -(1 << 62)
#: Groups of tracks that share a state, and rows of a value in it.
GROUPS, SLICE = 256, 10_000


def _whole_row(df: DataFrame) -> Column:
    """A row as text, which a state of one shape can hold whatever its columns; :func:`_rows_again` is its inverse."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), _JSON)


def _rows_again(df: DataFrame, like: DataFrame, text: str) -> DataFrame:
    return df.select(F.from_json(text, like.schema, _JSON).alias("_own")).select("_own.*")


def _named(key: str) -> Column:
    """A track as text that is never null: rows of several tracks share a group of the state."""
    return F.to_json(F.struct(F.col(f"`{key}`").alias("key")), _JSON)


def _group(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(_named(key)), F.lit(groups)).alias("_group")


def _packed(rows: pa.Table) -> list[bytes]:
    """Rows as values for a state, which then costs bytes to read and write and not a step a row."""
    packed = []
    for own in rows.combine_chunks().to_batches(SLICE):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(own)
        packed.append(sink.getvalue().to_pybytes())
    return packed


def _unpacked(values: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([b for v in values for b in pa.ipc.open_stream(bytes(v))], schema)


_HELD = pa.schema([("name", pa.large_string()), ("at", pa.int64()), ("norm", pa.large_string()), ("row", pa.large_string())])
_CHANGES = pa.schema([("name", pa.large_string()), ("from_ms", pa.int64())])
_KEPT = pa.schema([("name", pa.large_string()), ("at", pa.int64()), ("norm", pa.large_string())])


def _in_order(rows: pa.Table, order: Sequence[str]) -> pa.Table:
    """Held rows by track and time; of equal times the columns ``order`` of the rows decide, nulls first."""
    rows = rows.take(pc.sort_indices(rows, [("name", "ascending"), ("at", "ascending")]))
    names, ats = rows["name"].to_pylist(), rows["at"].to_pylist()
    equal = [i for i in range(1, len(ats)) if ats[i] == ats[i - 1] and names[i] == names[i - 1]]
    if not (order and equal):
        return rows
    alike = sorted({*equal, *(i - 1 for i in equal)})
    ties = {i: [(v is not None, v) for v in map(json.loads(row).get, order)] for i, row in zip(alike, rows["row"].take(alike).to_pylist(), strict=True)}
    place = list(range(len(ats)))
    for _, own in groupby(alike, lambda i: (names[i], ats[i])):
        own = list(own)
        place[own[0] : own[-1] + 1] = sorted(own, key=ties.__getitem__)
    return rows.take(place)


def _repeats(order: Sequence[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Holds the segments of a group of tracks until the watermark has passed them, then judges each track's in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, kept = state.get if state.exists else ([], [])
        rows = [_unpacked(held, _HELD)]
        for own in batches if not state.hasTimedOut else ():
            timed = own["at"] != _NO_TIME
            rows.append(pa.Table.from_pandas(own.loc[timed, _HELD.names], _HELD, preserve_index=False))
            said = own[~timed & (own["norm"].fillna("") != "")]
            if len(said):
                yield pd.DataFrame({"row": said["row"]})
        passed, rows = state.getCurrentWatermarkMs(), pa.concat_tables(rows)
        gone = pc.less_equal(rows["at"], passed)
        later, ready = rows.filter(pc.invert(gone)), _in_order(rows.filter(gone), order)
        last: dict[str, list[tuple[int, str]]] = {}
        for own in _unpacked(kept, _KEPT).to_pylist():
            last.setdefault(own["name"], []).append((own["at"], own["norm"]))
        keep: list[bool] = []
        for name, own in groupby(zip(*(ready[c].to_pylist() for c in ("name", "at", "norm")), strict=True), itemgetter(0)):
            keep += accepted_segments(((at, norm) for _, at, norm in own), last.setdefault(name, []))
        near = [(name, at, norm) for name, own in last.items() for at, norm in own if at + REPEAT_MS > passed]
        if later.num_rows or near:
            state.update((_packed(later), _packed(pa.table([list(c) for c in zip(*near, strict=True)] or [[], [], []], schema=_KEPT))))
            # The time of the first that is held, or when nothing kept can be repeated.
            state.setTimeoutTimestamp(pc.min(later["at"]).as_py() if later.num_rows else max(at for _, at, _ in near) + REPEAT_MS)
        elif state.exists:
            state.remove()
        if any(keep):
            yield pd.DataFrame({"row": ready["row"].filter(pa.array(keep)).to_pylist()})

    return step


def without_repeats_by_time(segments: DataFrame, at: str = "at", delay: str = "10 seconds", key: str = "track_id", order: Sequence[str] = (), groups: int = GROUPS) -> DataFrame:
    """Segments ``(track_id, …, text, at)`` of a stream without repeats, in the order of their times ``at``.

    The rows are those of :func:`versetime.operators.windows.without_repeats` for ``start_ms`` that differ as ``at`` does,
    in whatever order and batches they come: a segment is held until the watermark, ``delay`` behind the latest time seen,
    has passed it, and is then compared with the last kept of its track.  What comes behind the watermark is late, and
    dropped by Spark.  Of equal times ``order`` decides.  What is held is bounded by ``delay``; timeouts release it
    and later forget what no segment can repeat any more, so tracks that have ended leave no state.  The last ``delay`` of
    a stream comes out when later times, of any track, move the watermark on.

    Tracks are dealt into ``groups`` by a hash; a group shares its state and its timeout, so a batch costs a call for a
    group, not for each track.  A stream goes on from its checkpoint with the number of groups that it began with.  A track's
    state is in one task, as each kept segment changes what the next is compared with.  Null tracks are one track; segments without a time come out at once, unless their text has no letter or digit; others of that kind never do.
    Columns beside these are carried along, whatever their types.  The query must run with ``STORE``.
    """
    spoken = F.expr(f"cast(ceil(unix_micros(`{at}`) / 1000D) as bigint)")
    rows = segments.withWatermark(at, delay).select(
        _group(key, groups), F.col(at).alias("_time"), _named(key).alias("name"), F.coalesce(spoken, F.lit(_NO_TIME)).alias("at"),
        normalized(F.col("text")).alias("norm"), _whole_row(segments).alias("row"),
    )
    state = "held array<binary>, kept array<binary>"
    found = rows.groupBy("_group").applyInPandasWithState(_repeats(order), "row string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return _rows_again(found, segments, "row")


class _ActiveLine(StatefulProcessor):
    """The times at which the tracks of a group change their line."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.changes = handle.getListState("changes", "rows binary")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        own = initialState.set_axis(["group", "name", "from_ms"], axis=1)
        for value in _packed(pa.Table.from_pandas(own[_CHANGES.names], _CHANGES, preserve_index=False)):
            self.changes.appendValue((value,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = _unpacked((value for (value,) in self.changes.get()), _CHANGES).to_pandas().sort_values("from_ms", ignore_index=True)
        codes, names = pd.factorize(known["name"])
        starts, names = known["from_ms"].to_numpy(np.int64), pd.Index(names)
        right = pd.DataFrame({"code": codes.astype(np.int64), "from_ms": starts, "place": np.arange(len(known))})
        for own in rows:
            own = own.set_axis(["group", "name", "at", "row"], axis=1)
            left = pd.DataFrame({"code": names.get_indexer(own["name"]).astype(np.int64), "at": own["at"].to_numpy(np.int64), "own": np.arange(len(own))}).sort_values("at")
            found = pd.merge_asof(left, right, left_on="at", right_on="from_ms", by="code")
            shown, at = found["place"].notna().to_numpy(), np.full(len(own), _NO_TIME)
            at[found["own"].to_numpy()[shown]] = starts[found["place"].to_numpy()[shown].astype(np.int64)]
            yield pd.DataFrame({"row": own["row"].to_numpy(), "_name": own["name"].to_numpy(), "_from": at})

    def close(self) -> None:
        pass


def active_lines_stream(clock: DataFrame, lines: DataFrame, key: str = "track_id", *, first_line: bool = True, groups: int = GROUPS) -> DataFrame:
    """The rows of :func:`versetime.operators.asof.active_lines` for a ``clock`` that streams in and ``lines`` that don't.

    The changes of line (:func:`versetime.operators.asof.line_changes`) are written to the shared folder here.  The first
    batch puts their times into the state, where rows of the clock are looked up; what the line says joins by track and
    time of change afterwards, so no text goes through the state.  Neither order nor batches change the rows.

    Tracks are dealt into ``groups`` by a hash, and a group shares its state; a stream goes on from its checkpoint with the
    number of groups and the ``lines`` that it began with.  A row whose ``time_ms`` is null, and one of a track without
    lines, has null lines.  Tracks whose clock has stopped keep their changes.  The query must run with ``STORE``.
    """
    changes = staged(line_changes(lines, key, first_line=first_line), "changes")
    shown = changes.drop(key, "from_ms", "until_ms")
    since = F.coalesce("from_ms", F.lit(_NO_TIME + 1))
    initial = changes.select(_group(key, groups), _named(key).alias("_name"), since.alias("_from"))
    rows = clock.select(_group(key, groups), _named(key).alias("_name"), F.coalesce(F.col("time_ms").cast("long"), F.lit(_NO_TIME)).alias("_at"), _whole_row(clock).alias("_row"))
    found = rows.groupBy("_group").transformWithStateInPandas(_ActiveLine(), "row string, _name string, _from long", "append", "None", initialState=initial.groupBy("_group"))
    said = changes.select(_named(key).alias("_name"), since.alias("_from"), F.struct(*shown.columns).alias("_line"))
    own = found.join(said, ["_name", "_from"], "left").select(F.from_json("row", clock.schema, _JSON).alias("_own"), "_line")
    return own.select(f"_own.{key}", *(f"_own.`{c}`" for c in clock.columns if c != key), "_line.*")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, timeout_s: int = 3600) -> DataFrame:
    """Run ``stream`` over all that its source has now, append its rows to files at ``path``, and return what is there.

    Called again with the same folders it goes on where it stopped, after a failure too: the checkpoint has state and
    offsets, and the files' own log counts each batch once.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} seconds")
    return spark.read.schema(stream.schema).parquet(path)
