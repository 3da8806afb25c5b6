"""Removal of passages that occur more than once, by partitioned suffix trees.

A passage counts from ``WINDOW`` words on, so of each suffix only the path of its first
``WINDOW`` words matters, and of a suffix tree only nodes that deep with two suffixes below.

1. Each window is filed under the smallest (by hash) of its runs of ``PREFIX`` words, so
   equal windows are filed alike, and neighbouring windows mostly under the same place in
   the text: one row stands for a stretch of suffixes.  Stretches whose prefix occurs once
   in the corpus are dropped; their texts have not moved.
2. The stretches left get the path hash of each of their windows.  Prefixes with at most
   ``GROUP`` stretches make groups that fit in memory; a task walks its groups in order and
   sorts the paths in each, and equal neighbours are the deep nodes.  Prefixes with more
   stretches are lengthened to whole paths: equal stretches are taken together, their paths
   counted with partial sums, and the deep ones joined back, one row per stretch.
3. Overlapping windows merge into repeats, and the words they cover go.

Copies of a whole text are one text here, with a count: nothing of it stays if it has
``WINDOW`` words and a copy.

Defined results: null text has no words; texts with fewer words than a window stay whole;
every occurrence is removed, the first too; rows without id, and rows that repeat an id,
are treated each by its text.  A text of which nothing is removed is left as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.llm.common import small_batches, written
from boxlore.llm.jaccard_join import word_hashes

WINDOW = 35
PREFIX = 8
GROUP = 2000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: the six ASCII blanks only


def hashed(words: list[bytes]) -> np.ndarray:
    known = word_hashes()
    return np.array([known[word] for word in words], np.uint64)


def paths(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    made = np.full(len(hashes) - length + 1, length, np.uint64)
    for k in range(length):
        made = made * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(made)]
    made ^= made >> np.uint64(32)
    made *= np.uint64(0x9E3779B97F4A7C15)
    return made ^ (made >> np.uint64(29))


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, first, last): the window starts filed under each chosen run of PREFIX words."""
    runs = paths(hashes, PREFIX)
    wide = WINDOW - PREFIX + 1
    if len(runs) < wide:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(runs) - wide + 1) + sliding_window_view(runs, wide).argmin(axis=1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(at) - 1]])
    return runs[at[first]].view(np.int64), first, last


def text_class(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, text): id and mark find a text again; rows that share both have the same text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def found_again(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` of ``keyed`` with the columns of ``wanted``, which has id and mark."""
    wanted = wanted.withColumnsRenamed({"id": "wanted_id", "mark": "wanted_mark"})
    same = docs["id"].eqNullSafe(wanted["wanted_id"]) & (docs["mark"] == wanted["wanted_mark"])
    return docs.join(wanted, same).drop("wanted_id", "wanted_mark")


def batches_of(schema: pa.Schema, rows: Callable) -> Callable:
    """A function for mapInArrow from one that turns a batch into rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = list(rows(batch.to_pydict()))
            columns = zip(*made) if made else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return work


def describe(docs: DataFrame) -> DataFrame:
    """(id, mark, class, n_words, kept_sha256, stretches) per row; the sum is that of all words."""
    kind = docs.schema["id"].dataType.simpleString()
    stretch = pa.struct([("prefix", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, offsets, parts = [], [0], [(np.zeros(0, np.int64),) * 3]
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                hashes = hashed(words)
                rows.append((text_class(hashes), len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
                parts.append(stretches(hashes))
                offsets.append(offsets[-1] + len(parts[-1][0]))
            prefix, first, last = (np.concatenate(x) for x in zip(*parts))
            made = pa.StructArray.from_arrays(
                [pa.array(prefix), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], fields=list(stretch))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.binary(), pa.int64(), pa.string()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns, lists], ["id", "mark", "class", "n_words", "kept_sha256", "stretches"])

    return docs.mapInArrow(
        work, f"id {kind}, mark long, class binary, n_words long, kept_sha256 string, "
        "stretches array<struct<prefix: long, first: int, last: int>>")


def filed(docs: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with copies or shared prefixes (class, c, id, mark, copies), and their stretches with path hashes."""
    rows = described.where(F.size("stretches") > 0).select("class", F.explode("stretches").alias("s")).select("class", "s.*")
    counts = written(rows.groupBy("prefix").count().where("count > 1"), "shared-prefixes")
    left = rows.join(counts, "prefix").groupBy("class").agg(
        F.collect_set(F.struct("prefix", "first", "last", (F.col("count") > GROUP).alias("large"))).alias("found"))
    one = described.where(F.size("stretches") > 0).groupBy("class").agg(F.min(F.struct("id", "mark")).alias("one"), F.count("*").alias("copies"))
    texts = written(left.join(one, "class").select("class", F.monotonically_increasing_id().alias("c"), "one.*", "copies", "found"), "texts-left")
    schema = pa.schema([("prefix", pa.int64()), ("large", pa.bool_()), ("c", pa.int64()), ("first", pa.int32()), ("paths", pa.list_(pa.int64()))])

    def path_rows(batch: dict) -> Iterator[tuple]:
        for text, digest, c, found in zip(batch["text"], batch["class"], batch["c"], batch["found"]):
            hashes = hashed(words_of(text))
            if text_class(hashes) == digest:
                made = paths(hashes, WINDOW).view(np.int64)
                for s in found:
                    yield s["prefix"], s["large"], c, s["first"], made[s["first"] : s["last"] + 1]

    met = found_again(docs, texts.select("class", "c", "id", "mark", "found")).select("text", "class", "c", "found")
    return texts, met.mapInArrow(batches_of(schema, path_rows), "prefix long, large boolean, c long, first int, paths array<long>")


def equal_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by prefix: (c, at) of the windows whose path another window of the group has too."""
    held: list[pa.RecordBatch] = []

    def deep_nodes(rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("paths").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        path = lists.flatten().to_numpy(zero_copy_only=False)
        prefix = rows.column("prefix").to_numpy()[owner]
        c = rows.column("c").to_numpy()[owner]
        at = rows.column("first").to_numpy()[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((at, c, path, prefix))  # the leaves of the groups' trees in order
        path, prefix, c, at = path[order], prefix[order], c[order], at[order]
        same = (path[1:] == path[:-1]) & (prefix[1:] == prefix[:-1])
        other = same & ((c[1:] != c[:-1]) | (at[1:] != at[:-1]))
        deep = np.zeros(len(path), bool)
        deep[1:] |= other
        deep[:-1] |= other
        return pa.RecordBatch.from_arrays([pa.array(c[deep]), pa.array(at[deep].astype(np.int64))], ["c", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        prefix = batch.column("prefix").to_numpy()
        border = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on in the next batch
        if held and (border or prefix[0] != held[-1].column("prefix")[0].as_py()):
            done = pa.Table.from_batches([*held, batch.slice(0, border)])
            held = []
            if done.num_rows:
                yield deep_nodes(done)
        elif border:
            yield deep_nodes(pa.Table.from_batches([batch.slice(0, border)]))
        held.append(batch.slice(border))
    if held:
        yield deep_nodes(pa.Table.from_batches(held))


def repeated_windows(stretch_rows: DataFrame) -> DataFrame:
    """(c, starts) of the windows that occur elsewhere too."""
    rows = written(stretch_rows, "paths")
    small = rows.where("NOT large").repartition("prefix").sortWithinPartitions("prefix").select("prefix", "c", "first", "paths")
    # copies share whole stretches: equal ones are listed and counted as one
    large = rows.where("large").select("prefix", "paths", "c", "first")
    shapes = written(large.groupBy("prefix", "paths").agg(F.count("*").alias("n")), "large-stretches")
    single = shapes.select("prefix", "paths", "n", F.posexplode("paths").alias("k", "path"))
    nodes = single.groupBy("prefix", "path").agg(F.sum("n").alias("n")).where("n > 1").select("prefix", "path")
    deep = written(
        single.join(nodes, ["prefix", "path"]).groupBy("prefix", "paths").agg(F.collect_list("k").alias("deep")), "deep-nodes")
    met = large.join(deep, ["prefix", "paths"])
    starts = F.transform("deep", lambda k: (F.col("first") + k).cast("long"))  # per stretch, not per window
    found = small.mapInArrow(equal_paths, "c long, at long").select("c", F.array("at").alias("starts")).unionByName(
        met.select("c", starts.alias("starts")))
    return found.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def without(words: list[bytes], starts: list[int]) -> list[bytes]:
    """The words that no window at these starts covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[np.minimum(np.array(starts, np.int64) + WINDOW, len(words))] -= 1
    return [word for word, depth in zip(words, np.cumsum(edge[:-1]).tolist()) if not depth]


def repeats(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(class, id, mark, copies, starts) of the texts with repeats; no starts where copies go as a whole."""
    texts, stretch_rows = filed(docs, described)
    found = texts.drop("found").where("copies = 1").join(repeated_windows(stretch_rows), "c").select("class", "id", "mark", "copies", "starts")
    whole = described.where(F.size("stretches") > 0).groupBy("class").agg(
        F.first("id").alias("id"), F.first("mark").alias("mark"), F.count("*").alias("copies")).where("copies > 1")
    none = F.array().cast("array<long>").alias("starts")
    return written(found.unionByName(whole.select("class", "id", "mark", "copies", none)), "repeats")


def summarize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) per row of ``docs``."""
    rows = keyed(docs, key, text)
    described = written(describe(rows), "described-words")
    found = repeats(rows, described)
    schema = pa.schema([("class", pa.binary()), ("kept", pa.int64()), ("sha256", pa.string())])

    def kept(batch: dict) -> Iterator[tuple]:
        for value, digest, starts in zip(batch["text"], batch["class"], batch["starts"]):
            words = words_of(value)
            if text_class(hashed(words)) == digest:
                left = without(words, starts)
                yield digest, len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    met = found_again(rows, found.where("copies = 1").select("class", "id", "mark", "starts")).select("text", "class", "starts")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    changed = met.mapInArrow(batches_of(schema, kept), "class binary, kept long, sha256 string").unionByName(
        found.where("copies > 1").select("class", F.lit(0).cast("long").alias("kept"), empty.alias("sha256")))
    both = described.select("id", "class", "n_words", "kept_sha256").join(written(changed, "changed-texts"), "class", "left")
    return both.select(
        F.col("id").alias(key), "n_words", (F.col("n_words") - F.coalesce("kept", "n_words")).alias("n_removed"),
        F.coalesce("sha256", "kept_sha256").alias("kept_sha256"),
    )


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text where words were removed."""
    rows = keyed(docs, key, text)
    described = written(describe(rows), "described-words")
    found = repeats(rows, described).select("class", "starts")
    changed = described.select("id", "mark", "class").join(found, "class").select(
        F.col("id").alias("found_id"), F.col("mark").alias("found_mark"), "starts").dropDuplicates(["found_id", "found_mark"])

    def kept(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([
            value if at is None else b" ".join(without(words_of(value), at)).decode() if len(at) else ""
            for value, at in zip(texts, starts)
        ])

    whole = docs.select(
        F.struct("*").alias("doc"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    same = whole["id"].eqNullSafe(changed["found_id"]) & (whole["mark"] == changed["found_mark"])
    new = F.pandas_udf(kept, "string")(F.col("doc")[text], F.col("starts"))
    return whole.join(changed, same, "left").select(F.col("doc").withField(text, new).alias("doc")).select("doc.*")
