"""Vectors of whole numbers in shards, and blocks of queries that meet every shard.

A shard holds about ``COMPONENTS`` numbers, whatever the vectors' length, as one row of a
table in the shared folder; so does a block of queries.  Every block meets every shard of
its length, each pair in one task: memory is bounded by one shard and one block, and what
moves is packed in the narrowest type that holds it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from boxlore.llm.common import written

COMPONENTS = 1 << 20
#: tasks at most; further pairs share tasks, one after the other
TASKS = 20_000
LARGEST = (1 << 63) - 1


def whole_numbers(table: DataFrame, key: str, values: str, scale: int, label: str | None = None) -> DataFrame:
    """(row, id, label, size, values) of rows with an id and finite components; each component x is floor(scale * x)."""
    numbers = F.col(values).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    made = table.where(F.col(key).isNotNull() & F.col(values).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
        (F.col(label) if label else F.lit(0)).cast("long").alias("label"), F.size(values).alias("size"),
        F.transform(numbers, lambda x: F.floor(x * scale)).alias("values"))
    return written(made, "whole-vectors")


def packed(rows: DataFrame, components: int, make: Callable[[pd.DataFrame, np.ndarray], object]) -> DataFrame:
    """(size, part, parts, blob): ``rows`` dealt into parts; ``make`` gets those of a part, by id, and their matrix."""
    numbers = F.count("*") * F.greatest(F.col("size"), F.lit(1))
    parts = rows.groupBy("size").agg(F.ceil(numbers / components).cast("int").alias("parts"))
    dealt = rows.join(parts, "size").withColumn("part", F.expr("int(pmod(xxhash64(row), parts))"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "row"], ignore_index=True)
        blob = pickle.dumps(make(group, narrow(np.stack(group["values"].to_list()))))
        return pd.DataFrame({k: [group[k].iat[0]] for k in ("size", "part", "parts")} | {"blob": [blob]})

    return written(dealt.groupBy("size", "part").applyInPandas(pack, "size int, part int, parts int, blob binary"), "vector-parts")


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    bound = largest(matrix)
    return matrix.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if bound <= np.iinfo(kind).max or kind is np.int64))


def largest(matrix: np.ndarray) -> int:
    return max(-int(matrix.min()), int(matrix.max())) if matrix.size else 0


def exact_type(bound: int) -> type:
    """The fastest type in which whole numbers and their sums up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def as_long(scores: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers; larger ones become the largest such number."""
    if scores.dtype == object:
        scores = np.array([min(max(int(x), -LARGEST), LARGEST) for x in scores], np.int64)
    return scores.astype(np.int64)


def meet(shards: DataFrame, blocks: DataFrame, work: Callable[[object, object], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``work(shard, block)`` for every shard and every block of its size."""
    def against(mine: DataFrame, other: DataFrame, part: str, other_part: str) -> DataFrame:
        counts = other.select("size", F.col("parts").alias("others")).distinct()
        every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
        return mine.join(counts, "size").select("size", F.col("part").alias(part), every.alias(other_part), "blob")

    left, right = against(shards, blocks, "shard", "block"), against(blocks, shards, "block", "shard")
    tasks = max(1, min(left.count(), TASKS))
    empty = pd.DataFrame({field.split()[0]: pd.Series(dtype="int64") for field in schema.split(", ")})

    def each(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or block.empty:
            return empty
        return work(pickle.loads(shard["blob"].iat[0]), pickle.loads(block["blob"].iat[0]))

    keys = ["size", "shard", "block"]
    grouped = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
    return grouped.applyInPandas(each, schema)


def first(found: DataFrame, k: int, by: list[str], ties: list[str]) -> DataFrame:
    """The ``k`` rows of highest score of each group, with their rank; each task keeps k of a group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
