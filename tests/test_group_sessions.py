"""Streamed sessions whose state is kept by groups of receivers, and the batches they are fed."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlore.catalog import stream_queries
from boxlore.streaming import sessions

ROW = "rxid string, id long, slice long, us long, is_marker boolean, svc_name string, video_resolution string, " + ", ".join(f"{c} long" for c in sessions.SUMS)
ROW_SCHEMA = sessions._schema(ROW).append(pa.field("receivers", pa.int32()))


class Held:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Timers(list):
    registerTimer, deleteTimer = list.append, list.remove


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _ready(processor):
    processor.state, processor.handle = Held(), Timers()
    return processor


def _values(frames):
    return [tuple(None if pd.isna(x) else x for x in row) for frame in frames for row in frame.astype(object).itertuples(index=False)]


def _expired(processor, key, watermark):
    out = []
    for timer in [t for t in processor.handle if t <= watermark]:
        out += _values(processor.handleExpiredTimer((key,), Now(watermark), None))
        processor.handle.remove(timer)
    return out


def _row(rng, batch):
    us, marker = rng.randrange(batch * 4_000_000, (batch + 2) * 4_000_000), rng.random() < 0.25
    us = None if rng.random() < 0.1 else us
    return {
        "rxid": rng.choice("abcdefgh"), "id": rng.randrange(1000), "slice": sessions.LAST_SLICE if us is None else us // 2_000_000, "us": us,
        "is_marker": marker, "svc_name": f"s{rng.randrange(9)}" if marker and rng.random() < 0.7 else None, "video_resolution": None,
        **dict.fromkeys(sessions.SUMS, 0), "BlackScreen": 0 if marker else rng.randrange(3), "receivers": 5}


@pytest.mark.parametrize("seed", range(12))
def test_a_group_ends_the_sessions_its_receivers_would(seed):
    """Late rows, rows without a stamp, several markers in a batch, receivers that send nothing, sessions that run out."""
    rng = random.Random(seed)
    timeout = None if seed % 3 == 0 else 3
    single, group, n = {}, _ready(sessions.OpenSessionsOfGroup(timeout, 7)), 0
    for batch in range(5):
        rows = pd.DataFrame([_row(rng, batch) for _ in range(rng.randint(1, 60))]).drop_duplicates(["rxid", "us", "id"])
        slices = [own for _, own in rows.groupby("slice")]
        rng.shuffle(slices)
        want = []
        for rxid, own in pd.concat([sessions.pieces_of(x) for x in slices]).groupby("rxid"):
            one = single.setdefault(rxid, _ready(sessions.OpenSessions(timeout)) if rxid not in single else None)
            want += _values(one.handleInputRows((rxid,), iter([own]), None))
        packed = [sessions.packed_pieces(pa.Table.from_pandas(x, ROW_SCHEMA, preserve_index=False)).to_pandas() for x in slices]
        got = _values(group.handleInputRows((5,), iter(packed), None))
        watermark = (batch + 1) * 6000
        want += [row for rxid, one in single.items() for row in _expired(one, rxid, watermark)]
        got += _expired(group, 5, watermark)
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(group.handle) <= (timeout is not None)
        n += len(got)
    held = group._held()
    newest = {rxid: (no, is_open) for rxid, no, is_open in zip(held["rxid"], held["session_no"], held["is_open"])}
    assert n and newest == {rxid: one.state.value[:2] for rxid, one in single.items()}


def test_a_slice_without_receivers_has_no_pieces():
    row = {"rxid": None, "id": 1, "slice": 1, "us": 1, "is_marker": True, **dict.fromkeys(sessions.SUMS, 0), "receivers": 5}
    assert sessions.packed_pieces(pa.Table.from_pylist([row], ROW_SCHEMA)).num_rows == 0


def test_another_number_of_groups_is_refused():
    group = _ready(sessions.OpenSessionsOfGroup(None, 7))
    group._keep(group._held())
    group.groups = 8
    with pytest.raises(ValueError, match="started with 7 groups"):
        group._held()


def test_streamed_sessions_keep_few_states(spark, tmp_path):
    """One state for a group of receivers: 600 receivers had 600; the sessions are those of a state per receiver."""
    text = F.when(F.col("id") % 3 == 0, "CHANGE_CONTENT svc_name = A").otherwise("BlackScreen seen")
    rows = spark.range(6000).select(
        F.concat(F.lit("r"), (F.col("id") * 7 % 600).cast("string")).alias("rxid"), "id",
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("timestamp"), text.alias("data"))
    for part in range(2):
        rows.where(F.col("id") % 5 % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found, states = [], []
    for n, how in enumerate(({}, {"state_groups": None})):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = sessions.start_sessions(
            stream, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"), partitions=2, slice_seconds=86400, groups=2, **how)
        query.awaitTermination(240)
        assert query.exception() is None
        found.append(sorted(map(str, spark.read.parquet(str(tmp_path / f"out{n}")).collect())))
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert found[0] == found[1] and found[0]
    assert states[0] <= sessions.STATE_GROUPS < 600 <= states[1]


def test_a_batch_of_several_files_is_one_batch(spark, tmp_path, monkeypatch):
    """Files of bounded size, as many in each batch; also where the rows of a batch fill fewer."""
    monkeypatch.setattr(stream_queries, "_FILE_ROWS", 3)
    days = [0, 0, 0, 0, 0, 0, 0, 0, 13, 13, 13, 25]  # batches 0, 2 and 4; row 7 arrives a batch late
    rows = [(n, day, n) for n, day in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, day long, user_id long").select(
        "event_id", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400).cast("timestamp_ntz").alias("ts"), "user_id",
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream, folder = stream_queries._in_batches(spark, str(tmp_path))
    got = {}
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
        lambda batch, number: got.setdefault(number, sorted(r["u"] for r in batch.select("u").collect()))).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert [got.get(n, []) for n in range(5)] == [[0, 1, 2, 3, 4, 5, 6], [7], [8, 9, 10], [], [11]]
