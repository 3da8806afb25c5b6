"""Many text files, written by tasks that each hold a range of their names."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: files of one folder; listing goes by folder
FOLDER_FILES = 1000
#: how Spark's own writer calls the folder of a missing name
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path: local, or any that Arrow opens by URI."""
    if ":/" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def write_files(rows: DataFrame, name: str, order: list[str], text: str, folder: str, end: str = "\n") -> int:
    """One file per value of ``name``, with a line for each of its rows, by ``order``; returns their number.

    Names lie in ranges of tasks, and a task fills folders of ``FOLDER_FILES`` files, so
    paths sort like names.  Spark's partitioned writer makes a folder, a checksum and a
    rename by the driver for each file, and as many folders to list.  A null line is empty.
    A file gets its name when it is whole; a task that is repeated replaces its files."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    line_end, most = end.encode(), FOLDER_FILES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get(), 0
        current = out = aside = whole = None

        def close() -> None:
            out.close()
            store.move(aside, whole)

        for batch in batches:
            at = 0
            lines = batch.column(1)
            for found, run in itertools.groupby(batch.column(0).to_pylist()):
                if found != current:
                    if out is not None:
                        close()
                    into = f"{path}/part-{task.partitionId():06d}-{done // most:06d}"
                    if done % most == 0:
                        store.create_dir(into, recursive=True)
                    aside, whole = f"{into}/.{task.taskAttemptId()}", f"{into}/{name}={found}.txt"
                    current, out, done = found, store.open_output_stream(aside, compression=None), done + 1
                size = sum(1 for _ in run)
                out.write(b"".join([(line or b"") + line_end for line in lines.slice(at, size).to_pylist()]))
                at += size
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    named = rows.withColumn(name, F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(NO_NAME)))
    placed = named.select(name, *order, F.col(text).cast("binary").alias("_line")).repartitionByRange(name)
    sorted_rows = placed.sortWithinPartitions(name, *order).select(name, "_line")
    return sorted_rows.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
