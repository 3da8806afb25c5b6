"""Web archives: write records with an index, read chosen records by coalesced byte ranges.

Writing: each task writes its rows as gzip members to an archive of its own and returns
one index row per record (archive, offset, length, URL, digest).  The index is a table;
it names only files of tasks that succeeded, so files of lost tasks are never read.
Reading: chosen index rows are dealt out by stretches of an archive, sorted by offset,
and records that lie close together come from one read.

Of records whose payloads are equal and have at least ``SMALLEST`` bytes, the one with the
largest id is the response and the others are revisits of it, written without payload.

Defined results: null html is the empty payload; null URLs get the record's own name as
target; rows without id, and rows that repeat the largest id, are responses; control
characters in URLs are percent-encoded; an empty table gives no archive and no record.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from boxlore.llm.common import small_batches, written

SMALLEST = 1000
ARCHIVE_BYTES = 1 << 30
STRETCH = 2 << 20
TASK_BYTES = 32 << 20
GAP = 64 << 10
NAME = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, id long"
RECORD = "id long, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path: local, or any that Arrow opens by URI."""
    if ":/" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = f"<{NAME}{'' if key is None else key}>"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or name[1:-1])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple:
    """The fields of RECORD; a response whose payload doesn't match its digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(digits) if (digits := name[len(NAME) + 1 : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers_to = number(fields["WARC-Refers-To"]) if revisit else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], refers_to, digest, size, None if revisit else payload


def decide(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, html, digest, refers_to): refers_to is null for responses.

    Only keys and digests are grouped.  The wide rows are shuffled once, to meet the groups
    of several; a digest that many rows share is split there by adaptive execution.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("digest")
    )
    groups = (
        rows.where(F.octet_length("html") >= SMALLEST).groupBy("digest")
        .agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    )
    found = rows.join(written(groups, "equal-payloads"), "digest", "left")
    return found.select("id", "url", "html", "digest", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``decide`` as archives in ``folder``; their index, lazily."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        task = TaskContext.get()
        out, name, at, files = None, "", 0, 0
        try:
            for batch in small_batches(batches):
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0
                        out, files = store.open_output_stream(f"{path}/{name}", compression=None), files + 1
                    made = record(row["id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                    out.write(made)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    rows.append((name, at, len(made), row["url"], row["digest"], kind, row["id"]))
                    at += len(made)
                columns = zip(*rows) if rows else [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return records.mapInArrow(work, INDEX)


def read(chosen: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) of chosen index rows."""

    def ranges(rows: list[dict]) -> Iterator[list[dict]]:
        run: list[dict] = []
        for row in rows:
            if run and (
                row["archive"] != run[-1]["archive"] or row["offset"] > run[-1]["offset"] + run[-1]["length"] + GAP
                or row["offset"] + row["length"] - run[0]["offset"] > STRETCH
            ):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]
        opened, source = "", None
        for batch in batches:
            for run in ranges(batch.to_pylist()):
                if run[0]["archive"] != opened:
                    opened = run[0]["archive"]
                    source = store.open_input_file(f"{path}/{opened}")
                first = run[0]["offset"]
                data = source.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
                parsed = [parse(data[r["offset"] - first : r["offset"] - first + r["length"]]) for r in run]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parsed), kinds)], names)

    stretch = (F.col("offset") / STRETCH).cast("long")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))  # by what is read; index rows are too small to tell
    dealt = chosen.select("archive", "offset", "length", stretch.alias("stretch")).repartition(tasks, "archive", "stretch")
    return dealt.sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(work, RECORD)
