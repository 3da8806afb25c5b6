"""Files on disk: reading, imports, the jobs end to end, and the streaming forms."""

import datetime as dt
import gzip
import re

import pytest
from pyspark.sql import functions as F

from boxlore import jobs
from boxlore.catalog.views import log_columns
from boxlore.operators import classify, sessions
from boxlore.sources import files, jdbc, registry, tables
from boxlore.streaming import counts as count_stream
from boxlore.streaming import ingest as ingest_stream
from boxlore.streaming import sessions as session_stream


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in" / "R0000000001"
    root.mkdir(parents=True)
    (root / "nal_1.log").write_bytes(b"2025-01-15 05:11:30 one\r\n2025-01-15 05:11:31 two\n2025-01-15 05:11:32 three")
    (root / "nal_2.log").write_bytes(b"2025-01-15 05:11:30 one\r\n2025-01-15 05:11:31 two\n2025-01-15 05:11:32 three")
    (root / "empty.log").write_bytes(b"")
    (root / ".hidden.log").write_bytes(b"2025-01-15 05:11:30 hidden")
    (root / "bad.log").write_bytes(b"2025-01-15 05:11:30 ab\xff\xfecd\n")
    with gzip.open(root / "zip.log.gz", "wb") as f:
        f.write(b"2025-01-16 05:11:30 zipped\n2025-01-16 05:11:31 DUMPING FILE x\n")
    (root / "k_trap.log").write_bytes(
        b"---- TIME Received ----\n----------------- 02/29/2020 23:59:58 ---------------\n"
        b"----- Software: A-B -- Model: M 1 --------\nbody\n")
    (root / "var.log").write_bytes(b"2023-11-02 07:05:09.041  212 9 I VAR - tuner.3: lock count: 12\n")
    other = tmp_path / "in" / "none"
    other.mkdir()
    (other / "x.log").write_bytes(b"2025-01-15 05:11:30 no receiver\n")
    return str(tmp_path / "in")


def test_read_files(spark, folder):
    got = {r["file_name"]: r["content"] for r in files.read_files(spark, folder).collect()}
    assert set(got) == {"nal_1.log", "nal_2.log", "bad.log", "zip.log.gz", "k_trap.log", "var.log", "x.log"}
    assert got["bad.log"].endswith("abcd\n") and "zipped" in got["zip.log.gz"]
    assert files.read_files(spark, folder, "nal").count() == 2
    lines = files.lines_of_files(files.read_files(spark, folder, "nal_1")).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"][-5:]) for r in lines] == [(0, "0 one"), (1, "1 two"), (2, "three")]


def test_same_content_is_read_once(spark, folder):
    found = files.read_files(spark, folder, "nal")
    assert [r["file_name"] for r in registry.new_files(found, None).collect()] == ["nal_1.log"]
    known = found.select("file_hash").distinct()
    assert registry.new_files(found, known).count() == 0


def _lines(spark, path, split=None):
    """Numbered lines and the file table, read in blocks of ``split`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or "128m")
    try:
        lines = files.cut_lines(files.raw_lines(spark, path))
        placed = files.placed_blocks(files.summed_blocks(lines))
        numbered = files.numbered_lines(lines, placed).orderBy("path", "line_no").collect()
        return numbered, {r["file_name"]: r for r in files.files_of(placed).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_and_hashes_of_any_split(spark, tmp_path):
    (tmp_path / "big").mkdir()
    text = "".join(f"2025-01-15 05:11:{i % 60:02d} line {i}" + "\n\r\v\x1e\u2028\x85"[i % 6] for i in range(20_000)) + "end"
    (tmp_path / "big" / "a.log").write_bytes(text.encode())
    (tmp_path / "big" / "windows.log").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "big" / "other.log").write_bytes(text.replace("line 7\r", "line 8\r").encode())
    swapped = text.splitlines()
    swapped[5], swapped[6] = swapped[6], swapped[5]
    (tmp_path / "big" / "swapped.log").write_bytes("\n".join(swapped).encode())
    with gzip.open(tmp_path / "big" / "zip.log.gz", "wb") as f:
        f.write(text.encode())
    seen = []
    for split in ("65536", "200000", None):
        numbered, found = _lines(spark, str(tmp_path / "big"), split)
        got = [r for r in numbered if r["file_name"] == "a.log"]
        assert [r["line"] for r in got] == text.splitlines() and [r["line_no"] for r in got] == list(range(20_001))
        seen.append(len({r["_segment"] for r in got}))
        hashes = {name: r["file_hash"] for name, r in found.items()}
        assert hashes["a.log"] == hashes["windows.log"] == hashes["zip.log.gz"]
        assert len(set(hashes.values())) == 3 and found["a.log"]["first_line"].endswith("line 0")
        seen.append(hashes)
    assert seen[0] > 5 and seen[4] == 1 and seen[1] == seen[3] == seen[5]


def test_rolling_hash_against_plain_sums(spark):
    from boxlore.functions import rolling_hash

    places = [0, 1, 255, 256, 70_000, (1 << 33) + 5]
    df = spark.createDataFrame([(p,) for p in places], "n bigint")
    for k, (base, prime) in enumerate(zip(rolling_hash.BASES, rolling_hash.MODULI)):
        got = df.select("n", rolling_hash.power(F.col("n"), k).alias("a"), rolling_hash.power(F.col("n"), k, True).alias("b")).collect()
        assert all(r["a"] == pow(base, r["n"], prime) and r["a"] * r["b"] % prime == 1 for r in got)


def test_ingest_twice_stores_once(spark, folder, tmp_path):
    root = str(tmp_path / "store")
    for _ in range(2):
        jobs.ingest(spark, folder, root, 2025)
    logs = tables.read_logs(spark, f"{root}/logs")
    got = logs.collect()
    assert sorted(r["data"] for r in got if r["pattern"] == "generic") == ["DUMPING FILE x", "abcd", "one", "three", "two", "zipped"]
    assert {r["pattern"] for r in got} == {"generic", "k_trap", "var"}
    assert {r["rxid"] for r in got} == {"R0000000001"}
    assert spark.read.parquet(f"{root}/imports").count() == 6
    assert tables.read_logs(spark, f"{root}/logs", "R0000000001", "2025-01-16 00:00:00", "2025-01-17 00:00:00").count() == 2


def test_ingest_of_any_split_agrees(spark, folder, tmp_path):
    rows = []
    for split in ("40", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            jobs.ingest(spark, folder, str(tmp_path / split), 2025)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        pick = ["data", "timestamp", "pattern", "line_no", "software", "value_num", "rxid"]
        rows.append(sorted(map(str, spark.read.parquet(str(tmp_path / split / "logs")).select(*pick).collect())))
    assert rows[0] == rows[1] and rows[0]


def test_batch_that_crashed_is_stored_once(spark, folder, tmp_path, monkeypatch):
    """Wherever ingest stops, a second run leaves the rows of one undisturbed run."""
    from boxlore.sources import hash_index

    pick = ["data", "rxid", "line_no", "pattern"]
    jobs.ingest(spark, folder, str(tmp_path / "whole"), 2025)
    want = sorted(map(str, spark.read.parquet(str(tmp_path / "whole" / "logs")).select(*pick).collect()))

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")

    for place, (owner, name) in {"rows": (hash_index.HashIndex, "learn"), "keys": (registry, "imports")}.items():
        root = str(tmp_path / place)
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(owner, name, stop)
            jobs.ingest(spark, folder, root, 2025)
        jobs.ingest(spark, folder, root, 2025)
        assert sorted(map(str, spark.read.parquet(f"{root}/logs").select(*pick).collect())) == want
        jobs.ingest(spark, folder, root, 2025)
        assert spark.read.parquet(f"{root}/logs").count() == len(want)


def test_hash_index(spark, tmp_path):
    from boxlore.sources import hash_index

    def rows(low, high):
        number = F.col("id")
        return spark.range(low, high).select(
            F.concat(F.lit("R"), (number % 3).cast("string")).alias("rxid"), F.md5(number.cast("string")).alias("data_hash"), "id")

    index = hash_index.open_index(spark, str(tmp_path / "index"), ["rxid", "data_hash"])
    assert index.unseen(rows(0, 100), "a").count() == 100
    index.learn(rows(0, 100), "a")
    assert index.unseen(rows(0, 100), "a").count() == 100  # its own batch again
    assert {r["id"] for r in index.unseen(rows(50, 150), "b").collect()} == set(range(100, 150))
    index.learn(rows(100, 150), "b")
    index.learn(rows(100, 150), "b")
    assert index.maybe_stored(rows(1000, 3000)).count() < 20
    touched = index.unseen(spark.range(1).select(F.lit("R1").alias("rxid"), F.md5(F.lit("1")).alias("data_hash")), "c")
    # of the index alone, and of its entries only a bucket
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)|isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)", plan)
    assert all(str(tmp_path / "index") in file for file in touched.inputFiles())
    assert index.compact(2) > 0 and index.compact(2) == 0
    assert index.entries().count() == 150 and index.learned() == {"a", "b"}
    larger = index.grow()
    assert hash_index.open_index(spark, str(tmp_path / "index"), ["rxid", "data_hash"]) == larger
    assert larger.entries().count() == 150
    assert {r["id"] for r in larger.unseen(rows(0, 200), "c").collect()} == set(range(150, 200))


def test_hash_index_with_times(spark, tmp_path):
    from boxlore.sources import hash_index

    rows = spark.sql("SELECT * FROM VALUES ('R1', 'h', TIMESTAMP '2024-01-01 00:00:00'), ('R1', 'h', NULL) AS t(rxid, data_hash, timestamp)")
    index = hash_index.open_index(spark, str(tmp_path / "index"), ["rxid", "data_hash", "timestamp"])
    index.learn(rows, "a")
    assert index.unseen(rows, "b").count() == 0
    later = rows.withColumn("timestamp", F.lit("2024-01-02").cast("timestamp")).distinct()
    assert index.unseen(later, "b").count() == 1


def test_stream_equals_batch(spark, folder, tmp_path):
    jobs.ingest(spark, folder, str(tmp_path / "a"), 2025)
    for _ in range(2):
        query = ingest_stream.start_ingest(spark, folder, str(tmp_path / "b"), str(tmp_path / "c"), 2025)
        query.awaitTermination(120)
        assert query.exception() is None
    pick = ["data", "timestamp", "pattern", "line_no", "data_hash"]
    a, b = (sorted(map(str, spark.read.parquet(str(tmp_path / s / "logs")).select(*pick).collect())) for s in "ab")
    assert a == b


def _parts(spark, tmp_path, parts=4):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from boxlore.catalog.views import logs

    rows = logs(spark, "/root/testdata/sf0.001").select("rxid", "id", "timestamp", "data")
    n = e.count()
    path = str(tmp_path / "rows")
    for p in range(parts):
        low, high = p * n // parts, (p + 1) * n // parts
        rows.where((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows, path = _parts(spark, tmp_path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    query = session_stream.start_sessions(stream, out, str(tmp_path / "cp"), slice_seconds=86400, groups=2)
    query.awaitTermination(240)
    assert query.exception() is None
    names = ["rxid", "session_no", "change_content_timestamp", "svc_name", "BlackScreen", "DisplayDrop_0_99", "n_other_events"]
    want = sessions.session_summary(sessions.number_sessions(rows))
    newest = want.groupBy("rxid").agg(F.max("session_no").alias("session_no"))
    got = spark.read.parquet(out).select(names).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, want.join(newest, ["rxid", "session_no"], "left_anti").select(names).collect()))


def test_pieces_and_state_of_a_session():
    """Pieces in order, a marker, rows after a timeout, rows without a stamp."""
    import pandas as pd

    class Held:
        value, timers = None, []

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    held = Held()
    state = session_stream.OpenSessions(10)
    state.state = held
    state.handle = type("Handle", (), {"registerTimer": held.timers.append, "deleteTimer": held.timers.remove})()
    zero = dict.fromkeys(session_stream.SUMS, 0)
    row = lambda us, marker, n=0: {"rxid": "a", "id": us or 9, "slice": 1, "us": us, "is_marker": marker, "svc_name": None, "video_resolution": None, **zero, "BlackScreen": n}

    def send(*rows):
        pieces = session_stream.pieces_of(pd.DataFrame(list(rows)))
        return [tuple(r) for f in state.handleInputRows(("a",), iter([pieces]), None) for r in f[["session_no", "ended", "BlackScreen"]].to_numpy().tolist()]

    assert send(row(3, False, 1), row(2, False, 1), row(None, False, 1)) == [] and held.timers == [10_001]
    assert send(row(5, True), row(4, False, 2), row(6, False, 3)) == [(0, "marker", 5)] and held.timers == [10_001]
    held.timers.clear()
    expired = pd.concat(list(state.handleExpiredTimer(("a",), None, None)))
    assert expired[["session_no", "ended", "BlackScreen"]].to_numpy().tolist() == [[1, "timeout", 3]]
    assert send(row(7, False, 1)) == [] and held.value[0] == 2
    assert send(row(9_000_000, True), row(9_500_000, True)) == [(2, "marker", 1), (3, "marker", 0)] and held.timers == [19_500]


def test_streamed_sessions_open_few_state_partitions(spark, tmp_path):
    """Partitions of the state as asked for, two a core otherwise, whatever the session shuffles into; its setting stays."""
    key, events = "spark.sql.shuffle.partitions", spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    path, before = str(tmp_path / "rows"), spark.conf.get(key)
    log_columns(events).coalesce(1).write.parquet(path)
    for given, want in ((3, 3), (None, 2 * spark.sparkContext.defaultParallelism)):
        spark.conf.set(key, "37")
        try:
            stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
            query = session_stream.start_sessions(stream, str(tmp_path / f"out{want}"), str(tmp_path / f"cp{want}"), 60, partitions=given, groups=2)
            query.awaitTermination(120)
            assert query.exception() is None and spark.conf.get(key) == "37"
        finally:
            spark.conf.set(key, before)
        assert len([x for x in (tmp_path / f"cp{want}" / "state" / "0").iterdir() if x.name.isdigit()]) == want


def test_a_receiver_without_ended_session_makes_no_frame():
    import pandas as pd

    state = session_stream.OpenSessions(None)
    state.state = type("Held", (), {"get": lambda self: None, "exists": lambda self: False, "update": lambda self, value: None})()
    row = {"rxid": "a", "id": 1, "slice": 1, "us": 1, "is_marker": False, "svc_name": None, "video_resolution": None, **dict.fromkeys(session_stream.SUMS, 0)}
    assert list(state.handleInputRows(("a",), iter([session_stream.pieces_of(pd.DataFrame([row]))]), None)) == []


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows, path = _parts(spark, tmp_path, 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = count_stream.start_counts(stream, str(tmp_path / "top"), str(tmp_path / "cp"), None)
    query.awaitTermination(120)
    got = {r["table_name"]: r["row_count"] for r in tables.read_latest(spark, str(tmp_path / "top")).collect()}
    want = {r["rxid"]: r["count"] for r in rows.groupBy("rxid").count().collect()}
    assert got == want
    top = [(r["table_name"], r["row_count"]) for r in count_stream.read_largest(spark, str(tmp_path / "top"), 2).collect()]
    assert top == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_streamed_embedding_sees_each_row_once(spark, tmp_path):
    rows, path = _parts(spark, tmp_path, 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    embed = lambda batch: batch.select("id", F.length("data").alias("n"))
    query = count_stream.start_embedding(stream, embed, str(tmp_path / "emb"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "emb")).select("id").distinct().count() == rows.count()


def test_train_enrich_score_publish(spark, tmp_path):
    from boxlore.catalog.views import logs

    root = str(tmp_path / "t")
    rows = logs(spark, "/root/testdata/sf0.001").select(
        "rxid", "id", "timestamp", "category", "event_type", "data", "directory_file", "dataset")
    model, config = jobs.train(rows, root, max_features=50, trees=3, depth=3)
    assert config["columns"] and config["importances"]
    loaded, read_back = classify.load_model(spark, classify.model_path(f"{root}/models", "event_type"))
    assert read_back["columns"] == config["columns"]
    a = classify.predict_labels(model, rows, config["columns"]).select("id", "predicted")
    b = classify.predict_labels(loaded, rows, config["columns"]).select("id", "predicted")
    assert a.exceptAll(b).count() == 0
    tables.write_next(jobs.enrich_logs(rows, loaded, config["columns"]), f"{root}/enriched")
    enriched = tables.read_latest(spark, f"{root}/enriched")
    assert enriched.count() == rows.count()
    assert enriched.where("important_investigate").count() > 0
    jobs.publish(jobs.score(enriched), root)
    assert tables.read_latest(spark, f"{root}/anomalies").where("table_name = rxid").count() > 0
    assert tables.read_latest(spark, f"{root}/row_counts").agg(F.sum("row_count")).first()[0] == rows.count()
    assert jobs.saved_forecaster(spark, root) is None
    jobs.train_forecaster(rows, root, epochs=1, steps=1)
    with_forecast = jobs.score(enriched, forecaster=jobs.saved_forecaster(spark, root))
    assert with_forecast.where("seq_score IS NOT NULL").count() == jobs.score(enriched).where("seq_score IS NOT NULL").count()
    jobs.publish(jobs.score(enriched, materialize=False), root)
    assert tables._versions(spark, f"{root}/anomalies") == [1, 2]


def test_inventory(spark, tmp_path):
    for name in ["a.py", "b.pyc", "lib/c.py", "sub/d.txt", ".git/e"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r["file_name"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.py", "sub/d.txt"}


def test_versions(spark):
    versions = spark.createDataFrame([("a", "m1", 1), ("a", "m2", 2), ("b", "x", 1)], "file_name string, md5 string, version_number int")
    now = spark.createDataFrame([("a", "m1"), ("b", "x"), ("c", "n"), ("b", "y")], "file_name string, md5 string")
    got = {(r["file_name"], r["md5"]): r["status"] for r in registry.version_status(now, versions).collect()}
    assert got == {("a", "m1"): "older", ("b", "x"): "up_to_date", ("c", "n"): "new", ("b", "y"): "new"}
    new = {(r["file_name"], r["version_number"]) for r in registry.next_versions(now, versions).collect()}
    assert new == {("c", 1), ("b", 2)}


def test_upsert_versions(spark, tmp_path):
    root = str(tmp_path / "u")
    tables.upsert_table(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), root, ["k"])
    tables.upsert_table(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), root, ["k"])
    assert {tuple(r) for r in tables.read_latest(spark, root).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "x")], "ID int, data string")
    assert tables.has_columns(df, ["id", "data"]) and not tables.has_columns(df, ["id", "timestamp"])


def test_jdbc_options():
    options = jdbc.read_options("jdbc:postgresql://db/x", "logs", "id", 0, 100, partitions=4)
    assert options["numPartitions"] == "4" and options["dbtable"] == "logs" and options["upperBound"] == "100"
    with pytest.raises(ValueError):
        jdbc.read_options("u", "t", "id")
    assert "partitionColumn" not in jdbc.read_options("u", "t")


def test_embedder_factory(spark):
    from boxlore.operators import embed

    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, data string")
    got = {r["id"]: r["embedding"] for r in embed.embed_with(factory, df, 2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_clock_is_not_read_for_run_time(spark):
    from boxlore.operators import embed

    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1))], "id int, timestamp timestamp")
    out = embed.with_timestamps(df, F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")).collect()
    assert [(r["id"], r["timestamp"].year, r["timestamp_imputed"]) for r in out] == [(1, 2025, True), (2, 2024, False)]


def test_topic_count_and_overview_file(spark, tmp_path):
    from boxlore.operators import topics

    texts = ["cat dog cow", "dog cat pig", "red blue green", "blue red grey"] * 5
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id int, tokens array<string>")
    k, model = topics.pick_topic_count(df, [2, 3], iterations=5)
    assert k in (2, 3)
    topics.write_overview(model, str(tmp_path / "topics"))
    got = spark.read.option("header", "true").csv(str(tmp_path / "topics")).collect()
    assert len(got) == k and all(r["terms"] for r in got)


def test_graph_tables(spark, tmp_path):
    from boxlore.operators import graph

    day = dt.datetime(2024, 1, 1)
    rows = [(day, None, "a", "e1", None, None, "f", 2), (day, None, "a", "e2", None, None, "f", 1), (day, "c", "b", None, "7", "8", "f", 3)]
    df = spark.createDataFrame(rows, "timestamp timestamp, category string, data string, event_type string, sid string, cid string, directory_file string, line_no int")
    graph.write_graph(df, str(tmp_path / "g"))
    nodes = spark.read.parquet(str(tmp_path / "g" / "nodes"))
    assert {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()} == {
        "LogLine": 2, "Process": 2, "Session": 1, "Connection": 1}
    assert nodes.where("label = 'LogLine' AND props['data'] = 'a'").first()["props"]["event_type"] == "e2"
    edges = spark.read.parquet(str(tmp_path / "g" / "edges"))
    assert {r["rel"]: r["count"] for r in edges.groupBy("rel").count().collect()} == {
        "GENERATED": 2, "PART_OF_SESSION": 1, "ASSOCIATED_WITH": 1}


def test_busy_keys_keep_their_values(spark, monkeypatch):
    from boxlore.plans import skew

    monkeypatch.setattr(skew, "BUSY_KEYS", 1)
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    df = df.withColumn("k", F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("k")))
    per_key = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = skew.join_per_key(df, per_key, ["k"], "n")
    assert got.columns == ["id", "k", "top"]
    want = {r["k"]: r["top"] for r in per_key.collect()}
    assert all(r["top"] == (want[r["k"]] if r["k"] is not None else None) for r in got.collect())
    assert got.count() == 300
