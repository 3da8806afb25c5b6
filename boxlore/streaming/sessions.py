"""Marker sessions over a stream of rows, with keyed state and timers.

A session summary is made of sums, a minimum and the fields of its marker row, so partial
summaries add up.  Each batch is first folded per receiver and time slice into the pieces
between markers: a receiver that sends a third of all rows spreads over its slices, and a
task holds a slice's flags, not its texts.  The pieces of a receiver, in order, then meet
its open session in the state store.  A marker ends the open session; so does a timer, once
the watermark has passed the session's last row by the timeout.  Sessions are written when
they end.  Late rows count for the session that is open when they arrive.

The state is kept by groups of receivers, and the receivers of a group are folded together: a
call of the state store costs far more than a session.  Only groups with rows in the batch,
and those where a timer runs out, touch state; they read and write all their receivers.  Where
a batch holds few of very many receivers, one state per receiver touches less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from boxlore.functions import fixed_values as fixed
from boxlore.functions.message_fields import display_drop, field_columns
from boxlore.operators.sessions import alert_tests, is_other_event
from boxlore.plans.ordered import SLICE_SECONDS, time_slice
from boxlore.sources.tables import GROUPS, receiver_group

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = [*fixed.SESSION_ALERTS, *[name for name, _, _ in fixed.SESSION_DROP_BUCKETS], "n_other_events"]
TEXTS = ["svc_name", "video_resolution"]
#: rows without a stamp come last
LAST_SLICE = 1 << 62
_SUMMARY = ", ".join(["first_us long", "last_us long", *[f"{c} string" for c in TEXTS], *[f"{c} long" for c in SUMS]])
#: pieces in order of slice and place; place 0 comes before the slice's first marker
PIECE = f"rxid string, slice long, place long, {_SUMMARY}"
SESSION = f"rxid string, session_no long, ended string, {_SUMMARY}"
SESSION_NAMES = [field.split()[0] for field in SESSION.split(", ")]
#: the newest session of each receiver of a group
OPEN = f"rxid string, session_no long, is_open boolean, {_SUMMARY}"
#: the pieces that a slice has of a group of receivers, in one value
PACKED = "receivers int, pieces binary"
#: groups of receivers, each with a state of its own; as many as at the first start of a stream
STATE_GROUPS = 256
#: in arrays, no stamp is later than every first one and earlier than every last one
NO_STAMP = {"first_us": (1 << 63) - 1, "last_us": -(1 << 63)}
Arrays = dict[str, np.ndarray]


def flagged(rows: DataFrame, slice_seconds: int) -> DataFrame:
    """What a piece needs of each row: its time, whether it is a marker, and what it counts for."""
    text = F.trim(F.coalesce("data", F.lit("")))
    marker = F.lower(text).contains(fixed.SESSION_MARKER)
    body, opened = ~F.col("is_marker"), F.col("is_marker")
    tests = {**alert_tests(F.col("text"), F.col("drop")), "n_other_events": is_other_event(F.col("text"))}
    fields = field_columns(F.col("text"))
    return rows.withColumns({"text": text, "is_marker": marker}).withColumn("drop", display_drop(F.col("text"))).select(
        "rxid", "id", F.coalesce(time_slice(F.col("timestamp"), slice_seconds), F.lit(LAST_SLICE)).alias("slice"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "is_marker",
        *[F.when(opened, fields[c]).alias(c) for c in TEXTS], *[(body & test).cast("long").alias(c) for c, test in tests.items()])


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def _arrays(table: pa.Table) -> Arrays:
    return {c: (table[c].fill_null(NO_STAMP[c]) if c in NO_STAMP else table[c]).to_numpy() for c in table.column_names}


def _batch(arrays: Arrays, fields: str) -> pa.RecordBatch:
    schema = _schema(fields)
    missing = {c: arrays[c] == none for c, none in NO_STAMP.items()}
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type, missing.get(f.name)) for f in schema], schema=schema)


def _frame(arrays: Arrays, fields: str) -> pd.DataFrame:
    stamps = {c: pd.arrays.IntegerArray(arrays[c], arrays[c] == none) for c, none in NO_STAMP.items()}
    return pd.DataFrame({c: stamps.get(c, arrays[c]) for c in _schema(fields).names})


def _unpacked(values: list[bytes], fields: str) -> Arrays:
    schema = _schema(fields)
    return _arrays(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(value), schema) for value in values], schema))


def _taken(arrays: Arrays, rows: np.ndarray) -> Arrays:
    return {c: values[rows] for c, values in arrays.items()}


def _joined(parts: list[Arrays], names: Iterable[str]) -> Arrays:
    return {c: np.concatenate([part[c] for part in parts]) for c in names}


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Is the key another than that of the row before?"""
    return np.append(True, np.any([key[1:] != key[:-1] for key in keys], axis=0))[: len(keys[0])]


def _summed(arrays: Arrays, starts: np.ndarray) -> Arrays:
    """A summary of the rows from each start to the next; the marker, which alone has texts, is the first of them."""
    return {
        "first_us": np.minimum.reduceat(arrays["first_us"], starts), "last_us": np.maximum.reduceat(arrays["last_us"], starts),
        **{c: arrays[c][starts] for c in TEXTS}, **{c: np.add.reduceat(arrays[c], starts) for c in SUMS}}


def _pieces(rows: pa.Table, *further: str) -> Arrays:
    """The pieces of a slice, in order of receivers; rows without a receiver are in none."""
    rows = rows.filter(rows["rxid"].is_valid())
    order = pc.sort_indices(
        pa.table({"rxid": rows["rxid"].combine_chunks().dictionary_encode().indices, "us": rows["us"], "id": rows["id"]}),
        [(c, "ascending") for c in ("rxid", "us", "id")], null_placement="at_end")
    rows = rows.take(order)
    us = rows["us"].cast(pa.int64())
    arrays = _arrays(rows.drop_columns(["us", "id"]).append_column("first_us", us).append_column("last_us", us))
    receivers, markers = _changes(arrays["rxid"]), arrays["is_marker"].astype("int64")
    starts = np.flatnonzero(receivers | arrays["is_marker"])
    seen = np.cumsum(markers)
    place = seen - (seen - markers)[receivers][np.cumsum(receivers) - 1]
    return {c: arrays[c][starts] for c in ("rxid", "slice", *further)} | {"place": place[starts]} | _summed(arrays, starts)


def pieces_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a slice, of all its receivers at once."""
    return _frame(_pieces(pa.Table.from_pandas(rows, preserve_index=False)), PIECE)


def packed_pieces(rows: pa.Table) -> pa.Table:
    """The pieces of a slice, packed for each group of receivers that has a state."""
    pieces = _pieces(rows, "receivers")
    pieces = _taken(pieces, np.argsort(pieces["receivers"], kind="stable"))
    batch, starts = _batch(pieces, PIECE), np.flatnonzero(_changes(pieces["receivers"]))
    values = [batch.slice(at, end - at).serialize().to_pybytes() for at, end in zip(starts, [*starts[1:], batch.num_rows])]
    return pa.table({"receivers": pa.array(pieces["receivers"][starts], pa.int32()), "pieces": pa.array(values, pa.binary())})


def folded(held: Arrays, pieces: Arrays) -> tuple[Arrays, Arrays]:
    """The newest sessions of a group after these pieces, and the sessions that markers ended.

    The rules are those of ``OpenSessions``, for all receivers at once.  A receiver is held once."""
    names = _schema(_SUMMARY).names
    code, rxid = pd.factorize(np.concatenate([held["rxid"], pieces["rxid"]]))
    known, code = np.split(code, [len(held["rxid"])])  # those held are 0, 1, 2, ...
    order = np.lexsort((pieces["place"], pieces["slice"], code))
    pieces, code = _taken(pieces, order), code[order]
    newest, closed, met = np.zeros(len(rxid), "int64"), np.zeros(len(rxid), bool), np.zeros(len(rxid), bool)
    newest[known], closed[known], met[code] = held["session_no"], ~held["is_open"], True
    receivers = _changes(code)
    starts = (pieces["place"] > 0) | (receivers & closed[code])  # a marker, or the first row after a timeout
    seen = np.cumsum(starts)
    pieces["session_no"] = newest[code] + seen - (seen - starts)[receivers][np.cumsum(receivers) - 1]
    going_on = held["is_open"] & met[known]
    rows = _joined([_taken(held, going_on), pieces], ["session_no", *names])
    code = np.concatenate([known[going_on], code])
    order = np.lexsort((rows["session_no"], code))  # what was held of a session stays before its pieces
    rows, code = _taken(rows, order), code[order]
    starts = np.flatnonzero(_changes(code, rows["session_no"]))
    sessions = {"rxid": rxid[code[starts]], "session_no": rows["session_no"][starts]} | _summed(rows, starts)
    last = np.append(_changes(code[starts])[1:], True)
    now = _taken(sessions, last) | {"is_open": np.ones(last.sum(), bool)}
    return _joined([_taken(held, ~met[known]), now], _schema(OPEN).names), _taken(sessions, ~last)


def _text(value):
    return None if value is None or value is pd.NA or value != value else value


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


class OpenSessions(StatefulProcessor):
    """One open summary per receiver: (session_no, is_open, first_us, last_us, texts, sums)."""

    def __init__(self, timeout_seconds: int | None):
        self.timeout = timeout_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", f"session_no long, is_open boolean, {_SUMMARY}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # a few rows per slice, not the rows of the log; plain values, as a frame per receiver costs more than its work
        pieces = sorted((dict(zip(frame.columns, row)) for frame in rows for row in frame.itertuples(index=False, name=None)),
                        key=lambda piece: (piece["slice"], piece["place"]))
        number, is_open, *summary = self.state.get() or (0, None, *self._empty())
        ended, timer = [], self._timer(summary[1]) if is_open else None
        for piece in pieces:
            if piece["place"] > 0 or is_open is False:  # a marker, or the first row after a timeout
                if is_open:
                    ended.append((key[0], number, "marker", *summary))
                number, summary = number + 1, self._empty()
            is_open, summary = True, self._added(summary, piece)
        self.state.update((number, is_open, *summary))
        self._move_timer(timer, self._timer(summary[1]))
        if ended:
            yield self._rows(ended)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, is_open, *summary = self.state.get()
        self.state.update((number, False, *summary))
        if is_open:
            yield self._rows([(key[0], number, "timeout", *summary)])

    def close(self) -> None:
        pass

    def _timer(self, last_us: int | None) -> int | None:
        """When the session runs out, in milliseconds."""
        return None if self.timeout is None or last_us is None else -(-(last_us + self.timeout * 1_000_000) // 1000)

    def _move_timer(self, before: int | None, now: int | None) -> None:
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            if now is not None:
                self.handle.registerTimer(now)

    @staticmethod
    def _empty() -> list:
        return [None, None, *[None] * len(TEXTS), *[0] * len(SUMS)]

    @staticmethod
    def _added(summary: list, piece: dict) -> list:
        first, last = (None if pd.isna(piece[c]) else int(piece[c]) for c in ("first_us", "last_us"))
        texts = [_most(a, _text(piece[c])) for a, c in zip(summary[2:], TEXTS)]
        sums = [a + int(piece[c]) for a, c in zip(summary[2 + len(TEXTS) :], SUMS)]
        return [_least(summary[0], first), _most(summary[1], last), *texts, *sums]

    @staticmethod
    def _rows(ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(ended, columns=SESSION_NAMES, dtype=object)  # Spark casts to the types of SESSION


class OpenSessionsOfGroup(OpenSessions):
    """The newest session of each receiver of a group, in one value; one timer, for the first of them that runs out."""

    def __init__(self, timeout_seconds: int | None, groups: int):
        super().__init__(timeout_seconds)
        self.groups = groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "groups int, packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        now, ended = folded(held, _unpacked([value for frame in rows for value in frame["pieces"]], PIECE))
        self._keep(now)
        self._move_timer(self._first_timer(held), self._first_timer(now))
        if len(ended["rxid"]):
            yield self._of_group(ended, "marker")

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        last = timerValues.getCurrentWatermarkInMs() * 1000 - self.timeout * 1_000_000
        due = held["is_open"] & (held["last_us"] != NO_STAMP["last_us"]) & (held["last_us"] <= last)
        now = held | {"is_open": held["is_open"] & ~due}
        self._keep(now)
        self._move_timer(None, self._first_timer(now))  # the one that ran out goes by itself
        if due.any():
            yield self._of_group(_taken(held, due), "timeout")

    def _held(self) -> Arrays:
        groups, packed = self.state.get() or (self.groups, None)
        if groups != self.groups:  # its receivers are in other groups now
            raise ValueError(f"the stream was started with {groups} groups of receivers, not {self.groups}")
        return _unpacked([] if packed is None else [bytes(packed)], OPEN)

    def _keep(self, now: Arrays) -> None:
        self.state.update((self.groups, _batch(now, OPEN).serialize().to_pybytes()))

    def _first_timer(self, held: Arrays) -> int | None:
        stamps = held["last_us"][held["is_open"] & (held["last_us"] != NO_STAMP["last_us"])]
        return self._timer(int(stamps.min()) if len(stamps) else None)

    @staticmethod
    def _of_group(sessions: Arrays, ended: str) -> pd.DataFrame:
        return _frame(sessions | {"ended": np.full(len(sessions["rxid"]), ended, object)}, SESSION)


def ended_sessions(rows: DataFrame, timeout_seconds: int | None = None, lateness: str = "0 seconds",
                   slice_seconds: int = SLICE_SECONDS, groups: int = GROUPS, state_groups: int | None = STATE_GROUPS) -> DataFrame:
    """Sessions of a stream (rxid, id, timestamp, data) as they end, by a marker or a timeout.

    A slice of time and a group of receivers are folded together.  ``state_groups`` of receivers have a state each
    and are folded together, None gives each receiver its own; it stays as at the first start of a stream."""
    timed = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    flags, folding = flagged(timed, slice_seconds), ["slice", receiver_group(F.col("rxid"), groups)]
    mode = "EventTime" if timeout_seconds is not None else "None"
    if state_groups is None:
        pieces = flags.groupBy(*folding).applyInPandas(pieces_of, PIECE).groupBy("rxid")
        found = pieces.transformWithStateInPandas(OpenSessions(timeout_seconds), SESSION, "Append", mode)
    else:
        flags = flags.withColumn("receivers", receiver_group(F.col("rxid"), state_groups))
        pieces = flags.groupBy(*folding).applyInArrow(packed_pieces, PACKED).groupBy("receivers")
        found = pieces.transformWithStateInPandas(OpenSessionsOfGroup(timeout_seconds, state_groups), SESSION, "Append", mode)
    return found.select(
        "rxid", "session_no", "ended", F.timestamp_micros("first_us").alias("change_content_timestamp"),
        F.timestamp_micros("last_us").alias("last_timestamp"), *TEXTS, *SUMS)


def start_sessions(rows: DataFrame, output: str, checkpoint: str, timeout_seconds: int | None = None,
                   interval: str | None = None, partitions: int | None = None, **folding: int | None) -> StreamingQuery:
    """Write ended sessions to ``output``, each once; the open ones are in the checkpoint's state.

    ``partitions`` of the state are opened, and written to the checkpoint, in every batch whatever it
    holds, and stay as many as at the first start: two for each core unless given."""
    spark = rows.sparkSession
    settings = {PROVIDER: ROCKS_DB, "spark.sql.shuffle.partitions": str(partitions or 2 * spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)  # a query keeps the settings it is started with
    try:
        writer = ended_sessions(rows, timeout_seconds, **folding).writeStream.outputMode("append").format("parquet")
        writer = writer.option("path", output).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
