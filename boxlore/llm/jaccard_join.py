"""Similarity join of documents on the Jaccard similarity of their 5-word shingles.

1. Documents with equal sets are one class.  A class can only have a partner if enough of
   its smallest shingles (by hash) occur in another document, however they are spread, so
   one count per shingle of that short prefix leaves few classes; no text has moved yet.
2. The classes left are ordered once more: shingles found in many prefixes go last, by
   their counts, so that prefixes hold what is rare and a passage that many unlike
   documents share is in none of them.
3. Grouped prefix join: classes that share a prefix shingle form a group.  Each group is
   first compared with one member, the one with fewest rare shingles, all else by its
   links' components: only members of different components of a group are compared, and
   only where sizes and positions in the prefix allow enough common shingles.
Candidates are verified on whole sets; components run over the verified links.

Every pair that reaches the similarity lies in one component, whatever the group sizes:
a pair is left out only if it is bound to fail or already connected.

Defined results: null text has no words; a document with fewer than five words has its
whole sequence as only shingle, one without words has none and links with nothing; rows
without id link with nothing and have no component; rows that repeat an id are described
each.  Hashes of shingles have 64 bits, those of sets 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from boxlore.llm.common import Workspace, small_batches, written
from boxlore.llm.components import components

WORDS = 5
#: similarity of at least 80 / 100
NUMERATOR, DENOMINATOR = 80, 100
#: the screening prefix is longer than the necessary one by this part of it
MARGIN = 4
#: a shingle in more prefixes than this is common; the list of common shingles is bounded
COMMON = 24
MOST_COMMON = 500_000
ROUNDS = 6
MEMORY_WORDS = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    known = word_hashes()
    hashes = np.array([known[word] for word in words], np.uint64)
    width = min(WORDS, len(hashes))
    if not width:
        return hashes
    made = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(made)]
    made ^= made >> np.uint64(29)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(made ^ (made >> np.uint64(32)))


def prefix_length(n: int) -> int:
    """So many shingles of a set, in any fixed order, hold one that a partner has too."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def screen_length(n: int) -> int:
    return min(n, prefix_length(n) + -(-prefix_length(n) // MARGIN))


def screen_need(n: int) -> int:
    """So many of the screening prefix must be shared with the smallest possible partner."""
    least = -(-NUMERATOR * n // DENOMINATOR)
    return screen_length(least) - prefix_length(least) + 1


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, class, need, first) per row; ``first`` are shortened hashes, good for screening only."""
    names = ["id", "n", "class", "need", "first"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(value)
                n = len(found)
                first = (found[: screen_length(n)] >> np.uint64(16)).astype(np.int64) if n else ()
                rows.append((number, n, xxhash.xxh3_128_digest(found.tobytes()), screen_need(n) if n else None, first))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(work, "id long, n long, class binary, need int, first array<long>")


def classes_left(described: DataFrame) -> DataFrame:
    """(class, c, id): the classes that may have a partner, with a number and their smallest id.

    A shingle travels with the number of its row only; the 128 bits of the class follow for rows with enough."""
    work = Workspace(described.sparkSession, "screening")
    rows = described.where("n > 0 AND id IS NOT NULL")
    held = rows.select("row", "need", F.explode("first").alias("shingle"))
    shared = work.written(held.groupBy("shingle").count().where("count > 1").select("shingle"), "shared-shingles")
    enough = held.join(shared, "shingle").groupBy("row", "need").count().where("count >= need").select("row")
    left = rows.select("row", "class", "id").join(work.written(enough, "rows"), "row").groupBy("class").agg(F.min("id").alias("id"))
    classes = written(left.select("class", F.monotonically_increasing_id().alias("c"), "id"), "classes")
    work.drop()
    return classes


def sets_of(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """(c, n, shingles): the whole set of each class left, made anew from its document's text."""
    names, kinds = ["c", "n", "shingles"], [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for c, digest, value in zip(*(column.to_pylist() for column in batch.columns)):
                found = shingles(value)
                if xxhash.xxh3_128_digest(found.tobytes()) == digest:  # else another row with the same id
                    rows.append((c, len(found), found.view(np.int64)))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = picked.join(classes, "id").select("c", "class", "text")
    sets = written(found.mapInArrow(work, "c long, n long, shingles array<long>"), "shingle-sets")
    # rows that repeat an id may give a set twice; only then do sets move to drop one
    once = sets.groupBy("c").count().where("count > 1").isEmpty()
    return sets if once else written(sets.dropDuplicates(["c"]), "shingle-sets")


def prefixes(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, c, n, at): each set's prefix in the order rare by hash, then common by count and hash."""
    keys, counts = common

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = [(np.zeros(0, np.int64),) * 4]
            for c, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = values.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1) if len(keys) else np.zeros(len(found), int)
                weight = np.where(keys[at] == found, counts[at], 0) if len(keys) else np.zeros(len(found), int)
                chosen = found[np.lexsort((found, weight))[: prefix_length(len(found))]]
                k = len(chosen)
                out.append((chosen, np.full(k, c), np.full(k, len(found)), np.arange(k)))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "c", "n", "at"])

    return sets.select("c", "shingles").mapInArrow(work, "shingle long, c long, n long, at long")


def ordered_prefixes(sets: DataFrame) -> DataFrame:
    """Prefix rows whose shingle is in two prefixes at least, common shingles last.

    Common shingles are found by counting prefixes again until no new ones turn up; the
    list has at most ``MOST_COMMON`` entries.  It only sets the order: any order is right.
    """
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        found = prefixes(sets, (keys, counts)).groupBy("shingle").count().where(F.col("count") > COMMON)
        got = found.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
        new = {s: n for s, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist())}
        for s in keys.tolist():
            new.pop(s, None)
        room = MOST_COMMON - len(keys)
        if not new or room <= 0:
            break
        items = list(new.items())[:room]
        keys = np.concatenate([keys, np.array([s for s, _ in items], np.int64)])
        counts = np.concatenate([counts, np.array([n for _, n in items], np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    work = Workspace(sets.sparkSession, "prefixes")
    rows = work.written(prefixes(sets, (keys, counts)), "all")
    repeated = work.written(rows.groupBy("shingle").count().where("count > 1").select("shingle"), "repeated-shingles")
    shared = written(rows.join(repeated, "shingle"), "shared-prefixes")
    work.drop()
    return shared


def can_link(x: str, y: str) -> str:
    """Whether sizes and positions leave room: the first common shingle stands at these positions."""
    common = f"(1 + least({x}.n - {x}.at - 1, {y}.n - {y}.at - 1))"
    return (
        f"{DENOMINATOR} * least({x}.n, {y}.n) >= {NUMERATOR} * greatest({x}.n, {y}.n) AND "
        f"{DENOMINATOR + NUMERATOR} * {common} >= {NUMERATOR} * ({x}.n + {y}.n)"
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("left"))
    other = sets.select(F.col("c").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    return pairs.join(one, "a").join(other, "b").where(both * DENOMINATOR >= union * NUMERATOR).select("a", "b")


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links that connect whatever has a chain of links.

    Pairs are written before their sets are fetched: where they are few, the sets stay where they are."""
    work = Workspace(rows.sparkSession, "link-work")
    pairs = lambda found, name: work.written(
        found.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), name)
    centre = work.written(rows.groupBy("shingle").agg(F.min(F.struct("at", "c", "n")).alias("x")).select("shingle", "x.*"), "centres")
    stars = rows.alias("r").join(centre.alias("x"), "shingle").where(F.expr("r.c != x.c AND " + can_link("r", "x")))
    first = work.written(verified(pairs(stars.select(F.col("r.c").alias("c"), F.col("x.c").alias("d")), "star-pairs"), sets), "star-links")
    part = components(first).withColumnsRenamed({"node": "c", "component": "part"})
    marked = rows.join(part, "c", "left").withColumn("part", F.coalesce("part", "c"))
    marked = work.written(marked, "marked-prefixes")
    main = marked.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct("at", "c", "part"))["part"].alias("main"))
    main = work.written(main.where("low != high").select("shingle", "main"), "mixed-groups")
    mixed = work.written(marked.join(main, "shingle"), "mixed-prefixes")
    crossing = mixed.where("part != main").alias("x").join(mixed.alias("y"), "shingle").where(
        F.expr("x.part != y.part AND (y.part = y.main OR x.c < y.c) AND " + can_link("x", "y")))
    second = verified(pairs(crossing.select(F.col("x.c").alias("c"), F.col("y.c").alias("d")), "crossing-pairs"), sets)
    found = written(first.union(second), "verified-links")
    work.drop()
    return found


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the smallest id reachable by links)."""
    work = Workspace(docs.sparkSession, "described")
    wide = work.written(describe(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = classes_left(wide)
    described = written(wide.select("id", "n", "class"), "described")
    work.drop()
    sets = sets_of(docs, classes, key, text)
    part = components(links(ordered_prefixes(sets), sets)).withColumnsRenamed({"node": "c", "component": "part"})
    placed = written(classes.join(part, "c", "left").withColumn("part", F.coalesce("part", "c")), "placed-classes")
    smallest = placed.groupBy("part").agg(F.min("id").alias("component_id"))
    found = written(placed.join(smallest, "part").select("class", "component_id"), "class-components")
    rows = described.join(found, "class", "left")
    return rows.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that a smaller id of their component stands for."""
    gone = join(docs, key, text).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(gone, key, "left_anti").select(docs.columns)
