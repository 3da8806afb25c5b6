"""The three batch jobs: ingest, enrich, find and report anomalies."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxlore.functions.text import receiver_of_path
from boxlore.operators import anomaly, classify, enrich, extras, gather, mutual_info, network, parse, report, sessions, significance, store
from boxlore.plans.ordered import SEGMENT
from boxlore.session import checkpoint_dir, cut_lineage
from boxlore.sources import files as file_source
from boxlore.sources import folders, hash_index, registry, tables


# --- ingest -----------------------------------------------------------------------


def _read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not exist yet, or may have been written without rows."""
    return spark.read.parquet(path) if folders.filled(spark, path) else None


def parse_files(lines: DataFrame, reference_year: int) -> DataFrame:
    """Numbered lines with the ``format`` of their file to log rows."""
    of = lambda name: lines.where(F.col("format") == name)
    return tables.stack([
        parse.parse_lines(of("lines"), reference_year),
        parse.parse_var(of("var").drop(SEGMENT)),
        parse.parse_trap(parse.trap_blocks_of_lines(of("trap"))),
    ])


def provenance(files: DataFrame) -> DataFrame:
    """(path, format, source_table, rxid, rxid2) of files: what all rows of a file share is cut out of its path once."""
    path = F.col("path")
    named = files.select(
        "path", parse.file_format(F.col("first_line"), F.col("file_name")).alias("format"),
        store.source_table(receiver_of_path(path), path).alias("source_table"))
    return store.with_provenance(named, F.col("source_table"))


def log_rows(parsed: DataFrame, dataset: str) -> DataFrame:
    """Parsed rows, which have the provenance of their file, with hash, id and data set."""
    rows = store.fill_in(parsed, F.col("file_name"))
    # unique, and in line order within a file, so that rows of one stamp keep their order
    row_id = F.concat(F.md5("path"), F.lit("-"), F.lpad(F.coalesce("line_no", F.lit(0)).cast("string"), 12, "0"))
    rows = rows.withColumns({"id": row_id, "dataset": F.lit(dataset)})
    keep = [c for c in rows.columns if c not in ("path", "file_name", "file_hash", "format")]
    return rows.select(*keep)


def batch_name(files: DataFrame) -> str | None:
    """A name that the same set of new files always gets; None where there are no files."""
    count, mark = files.agg(F.count("*"), F.bit_xor(F.xxhash64("file_hash"))).first()
    return f"{count}-{mark & ((1 << 64) - 1):016x}" if count else None


def store_lines(raw: DataFrame, root: str, reference_year: int, dataset: str = "main", dedupe: str = "data",
                groups: int = tables.GROUPS) -> None:
    """Store the new rows of the new files among ``raw`` text rows, then note the files as imported.

    The text is read once and its lines are written to a table in the shared folder, which
    is read twice: to sum up the blocks (line counts, hashes, first lines) and to parse the files whose
    content is new.  What is stored already is asked of an index
    beside the table.  The rows of a batch are in a folder of their own, so a batch that is
    repeated after a crash replaces its rows; its keys are learned next, its files noted last."""
    spark = raw.sparkSession
    index = hash_index.open_index(spark, f"{root}/messages_by_{dedupe}", store.dedupe_keys(dedupe), groups)
    index.recover(f"{root}/logs")
    folder = f"{checkpoint_dir(spark)}/lines/{uuid.uuid4().hex}"
    try:
        _store_cut(file_source.stored_lines(file_source.cut_lines(raw), folder), index, root, reference_year, dataset, dedupe, groups)
    finally:
        folders.remove(spark, folder)


def _store_cut(lines: DataFrame, index: hash_index.HashIndex, root: str, reference_year: int, dataset: str, dedupe: str, groups: int) -> None:
    spark = lines.sparkSession
    placed = cut_lineage(file_source.placed_blocks(file_source.summed_blocks(lines)))
    files, known = file_source.files_of(placed), _read_if_any(spark, f"{root}/imports")
    fresh = cut_lineage(registry.new_files(files, known))
    batch = batch_name(fresh)
    if batch is None:
        return
    numbered = file_source.numbered_lines(lines, cut_lineage(placed.join(provenance(fresh), "path")))
    keys = extras.read_promoted(spark, f"{root}/promoted_keys")
    parsed = parse_files(numbered, reference_year)
    rows = cut_lineage(store.dedupe(extras.promoted(log_rows(parsed, dataset), keys), how=dedupe))
    tables.write_logs(index.unseen(rows, batch), f"{root}/logs/batch={batch}", "overwrite", groups)
    stored = _read_if_any(spark, f"{root}/logs/batch={batch}")
    if stored is not None:
        index.learn(stored, batch)
        extras.note_promoted(spark, f"{root}/promoted_keys", extras.frequent_keys(stored))
    registry.imports(fresh, known, F.current_timestamp()).write.mode("append").parquet(f"{root}/imports")


def read_stored(spark: SparkSession, root: str, receiver: str | None = None, start=None, end=None) -> DataFrame:
    """The log table with the columns of promoted keys, which rows stored before the promotion lack:
    ``extras.value_of`` reads those from ``extras``."""
    further = {name: kind for _, name, kind in extras.read_promoted(spark, f"{root}/promoted_keys")}
    return tables.read_logs(spark, f"{root}/logs", receiver, start, end, further=further)


def ingest(spark: SparkSession, source: str, root: str, reference_year: int, dataset: str = "main",
           name_contains: str | None = None, dedupe: str = "data", groups: int = tables.GROUPS) -> None:
    """All files under ``source``, whatever their size; ``groups`` of receivers make the folders of a day."""
    store_lines(file_source.raw_lines(spark, source, name_contains), root, reference_year, dataset, dedupe, groups)


# --- enrich -----------------------------------------------------------------------------


def choose_columns(logs: DataFrame, root: str) -> list[str]:
    """Telling text columns over all receivers, refined by their history."""
    spark = logs.sparkSession
    skip = {"rxid", "rxid2", "source_table", "directory_file", "data_hash", "message", "dataset"}
    names = [c for c in enrich.text_columns(logs) if c not in skip]
    rows = logs.select("rxid", "id", *names)
    found = [r["column"] for r in mutual_info.columns_of_any(mutual_info.relevant_columns(rows, names)).collect()]
    history = tables.read_latest(spark, f"{root}/column_history")
    if history is None:
        history = spark.createDataFrame([], "column string, low_runs int")
    kept, history = mutual_info.refine_columns(mutual_info.global_scores(rows, found), history)
    kept = cut_lineage(kept)
    tables.write_next(history, f"{root}/column_history")
    tables.write_next(mutual_info.grow_master(tables.read_latest(spark, f"{root}/master_columns"), kept), f"{root}/master_columns")
    return [r["column"] for r in kept.orderBy(F.desc("mi"), "column").collect() if r["column"] != "event_type"]  # one name per column of the table


def train(logs: DataFrame, root: str, model_type: str = "RandomForest", **options):
    """Train the event-type model on labelled rows and save it under ``root``."""
    columns = choose_columns(logs, root) or ["data"]
    rows = classify.training_rows_or_all(logs, columns)
    model = classify.fit_text_classifier(rows, columns, model_type, **options)
    config = {"columns": columns, "model_type": model_type, "importances": classify.feature_importances(model)
              if model_type == "RandomForest" else []}
    classify.save_model(model, config, classify.model_path(f"{root}/models", "event_type"))
    return model, config


def enrich_logs(logs: DataFrame, model=None, columns: list[str] | None = None) -> DataFrame:
    """Fields, labels, significance and the boost around marked moments."""
    predict = None if model is None else lambda rows: classify.predict_labels(model, rows, columns)
    rows = enrich.enrich(logs, predict)
    features = [c for c in significance.numeric_features(rows) if c.endswith("_num")]
    return significance.boost_marked(significance.significance(rows, features))


def enrich_stored(spark: SparkSession, root: str, receiver: str | None = None, start=None, end=None) -> None:
    """Enrich stored logs.  With a receiver or times only those rows are replaced, all
    others stay as they are; without a trained model labels come from the rules alone."""
    path, model, columns = classify.model_path(f"{root}/models", "event_type"), None, None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        model, config = classify.load_model(spark, path)
        columns = config["columns"]
    rows = enrich_logs(read_stored(spark, root, receiver, start, end), model, columns)
    if receiver is None and start is None and end is None:
        tables.write_next(rows, f"{root}/enriched")
    else:  # written once, as the upsert reads the keys and the rows
        tables.upsert_table(cut_lineage(rows), f"{root}/enriched", ["id"])


# --- anomalies ------------------------------------------------------------------------------


def _forecaster_path(root: str) -> str:
    return classify.model_path(f"{root}/models", "sequence", length=anomaly.SEQUENCE, hidden=16)


def train_forecaster(logs: DataFrame, root: str, **training) -> network.Trained:
    """Fit the recurrent forecaster on the known-good rows and save it under ``root``."""
    model = anomaly.fit_recurrent(logs.where("dataset = 'good'"), hidden=16, **training)
    model.save(logs.sparkSession, _forecaster_path(root))
    return model


def saved_forecaster(spark: SparkSession, root: str) -> network.Trained | None:
    path = _forecaster_path(root)
    return network.load(spark, path) if folders.filled(spark, path) else None


def score(logs: DataFrame, materialize: bool = True, forecaster: network.Trained | None = None) -> DataFrame:
    """Rows with sequence and reconstruction scores; without a forecaster each row is forecast as a mean."""
    seq = anomaly.score_recurrent(forecaster, logs) if forecaster else anomaly.score_sequences(logs, materialize=materialize)
    recon = anomaly.reconstruction_scores(
        logs.select("rxid", "id", anomaly.data_length().cast("double").alias("_len")).where("id IS NOT NULL"), ["_len"])
    rows = anomaly.attach_scores(logs, seq.drop("timestamp", "data", "data_len", "delta_s"))
    return anomaly.attach_scores(rows, recon.drop("_len"))


def publish(scored: DataFrame, root: str) -> None:
    """Anomalies of all receivers and the report tables; each run replaces the last."""
    spark = scored.sparkSession
    path = tables.write_next(gather.gather(scored), f"{root}/anomalies")
    found = spark.read.parquet(path)
    tables.write_next(report.row_counts(scored, run_time=F.current_timestamp()), f"{root}/row_counts")
    tables.write_next(report.daily_counts(found), f"{root}/daily_counts")
    documents = sessions.session_documents(sessions.number_sessions(scored.select("rxid", "id", "timestamp", "data")))
    tables.write_next(documents, f"{root}/session_documents")


def main(argv: list[str] | None = None) -> None:
    import argparse

    from boxlore.session import build_session

    parser = argparse.ArgumentParser(prog="boxlore")
    parser.add_argument("job", choices=["ingest", "train", "enrich", "anomalies"])
    parser.add_argument("--root", required=True, help="folder of the engine's tables")
    parser.add_argument("--source", help="folder of log files (ingest)")
    parser.add_argument("--year", type=int, help="year of stamps that have none (ingest)")
    parser.add_argument("--good", action="store_true", help="the files are known to be good")
    parser.add_argument("--forecast", action="store_true", help="train the sequence forecaster on known-good rows, too")
    parser.add_argument("--receiver", help="only this receiver")
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--model", default="RandomForest", choices=["RandomForest", "NaiveBayes"])
    args = parser.parse_args(argv)
    spark = build_session()
    if args.job == "ingest":
        ingest(spark, args.source, args.root, args.year, "good" if args.good else "main")
        return
    if args.job == "train":
        logs = read_stored(spark, args.root, args.receiver, args.start, args.end)
        if args.forecast:
            train_forecaster(logs, args.root)
        _, config = train(logs, args.root, args.model)
        print(json.dumps(config, indent=2))
    elif args.job == "enrich":
        enrich_stored(spark, args.root, args.receiver, args.start, args.end)
    else:
        publish(score(tables.read_latest(spark, f"{args.root}/enriched"), forecaster=saved_forecaster(spark, args.root)), args.root)
