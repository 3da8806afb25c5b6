"""Ranked lexical search of all documents for many items at once, with shared partial sums.

One pass over the texts counts, per document, its terms and the occurrences of those that
any item asks for; this narrow table is written.  Corpus statistics are summed from it.  A
second pass turns the counts into the terms' values for each document, forms the sums of
term sets that several items share once (see shared_terms), combines them into all items'
scores and keeps the best of each task; the best of all tasks are merged.

Items are taken in blocks of about ``BLOCK`` terms, since tasks hold one block's terms and
graph; each block costs the two passes.  The one broadcast is a block.

Scores are whole numbers: a term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), where
N documents hold a term at all and df hold this one; a document of n terms, all of them
holding L, has m = 75 + (25 n N) div L; the score sums, over the item's terms with repeats,
w * ((10^9 tf) div (1000 tf + 12 m)).

Defined results: null text has no terms; items without terms, or whose terms occur nowhere,
give no rows; only scores above 0 count; equal scores go by smaller id; rows that repeat
an id are documents, or items, of their own; documents without an id count in the
statistics but are not reported; an item without an id is reported with a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from boxlore.llm.common import small_batches, written
from boxlore.llm.shared_terms import Plan

BLOCK = 1 << 17
#: numbers of a task's matrix of partial sums
CELLS = 1 << 21
#: groups in which the tasks' best are merged before the final merge
SALTS = 64
#: what separates terms becomes a space; only A-Z are lower-cased (fixed by the definition of a term)
LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, in order."""
    return (text or "").encode().translate(LETTERS).split()


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items as (id, terms) in blocks of about ``BLOCK`` terms."""
    kept = written(items.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")), "items")
    # a term and the separator after it take two characters at least
    count = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(count / 2 / BLOCK))
    for part in range(parts):
        rows = kept.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).sort("row").collect()
        if found := [(row.id, words) for row in rows if (words := terms(row.text))]:
            yield found


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, counts) per document: number of its terms, and the vocabulary's terms with their occurrences as 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = shared.value.get, len(shared.value)
        for batch in small_batches(batches):
            lengths, found = [], []
            for at, value in enumerate(batch.column(1).to_pylist()):
                words = terms(value)
                lengths.append(len(words))
                numbers = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                found.append(numbers[numbers >= 0] + at * size)
            cells, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            ends = np.searchsorted(cells, np.arange(1, len(lengths)) * size)
            columns = [(cells % max(size, 1)).astype("<i4"), counts.astype("<i4")]
            parts = [pa.array([x.tobytes() for x in np.split(column, ends)], pa.binary()) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *parts], ["id", "n", "terms", "counts"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(work, f"id {kind}, n long, terms binary, counts binary")


def document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(held, "<i4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in counted.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Best:
    """The k best documents of each query so far, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.to_beat = k, np.ones(queries, np.int64)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        query, column = np.nonzero(scores >= self.to_beat[:, None])
        if not len(query):
            return
        query, score, ident = (np.concatenate(x) for x in ((self.query, query), (self.score, scores[query, column]), (self.id, ids[column])))
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        starts = np.searchsorted(query, np.arange(len(self.to_beat)))
        rank = np.arange(len(query)) - starts[query]
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], ident[kept]
        full = rank == self.k - 1
        self.to_beat[query[full]] = score[full]


def best_documents(counted: DataFrame, plan: Plan, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(query, id, score): the best of each task for each query."""
    shared = counted.sparkSession.sparkContext.broadcast((plan, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        best, width = Best(len(plan.queries), k), max(16, CELLS // max(plan.rows, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                held = part.column(2).to_pylist()
                values = np.zeros((len(weights), part.num_rows), np.int64)
                columns = np.repeat(np.arange(part.num_rows), [len(x) // 4 for x in held])
                rows = np.frombuffer(b"".join(held), "<i4")
                counts = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i4").astype(np.int64)
                m = 75 + np.array([25 * n * documents // length for n in part.column(1).to_pylist()], np.int64)
                values[rows, columns] = weights[rows] * (1_000_000_000 * counts // (1000 * counts + 12 * m[columns]))
                best.add(plan.scores(values), part.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.query, best.id, best.score)], ["query", "id", "score"])

    asked = counted.where("id IS NOT NULL AND length(terms) > 0").select(F.col("id").cast("long").alias("id"), "n", "terms", "counts")
    return asked.mapInArrow(work, "query long, id long, score long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank, first merged in groups."""
    order = [F.desc("score"), F.asc("id")]
    grouped = Window.partitionBy("query", "salt").orderBy(*order)
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    found = found.withColumn("place", F.row_number().over(grouped)).where(F.col("place") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item."""
    spark, kind = docs.sparkSession, items.schema[item_key].dataType
    out = None
    for block in blocks(items, item_key, item_text):
        vocabulary = {term: n for n, term in enumerate(sorted({term for _, words in block for term in words}))}
        counted = written(count_terms(docs, vocabulary, key, text), "term-counts")
        total = counted.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        weights = np.array([weight(total.documents, int(n)) for n in document_counts(counted, len(vocabulary))], np.int64)
        plan = Plan([[vocabulary[term] for term in words] for _, words in block], len(vocabulary))
        found = merged(best_documents(counted, plan, weights, total.documents, total.length or 1, k), k)
        names = spark.createDataFrame([(n, ident) for n, (ident, _) in enumerate(block)], f"query long, item {kind.simpleString()}")
        named = written(found.join(F.broadcast(names), "query").select("item", "rank", "id", "score"), "ranked")
        out = named if out is None else out.unionAll(named)
    if out is None:
        return spark.createDataFrame([], f"item {kind.simpleString()}, rank int, id long, score long")
    return out
