"""Exact top-k search by inner product: MaxScore over shards of postings.

A term is a component; its postings are the rows of a shard with their whole-number
impacts.  For a query the contribution of a term lies between two ends, known from the
shard's smallest and largest impact.  A few rows with the strongest impacts of the query's
widest terms are scored first; the k-th best of them is the score to beat.  The terms,
widest first, then split: rows that are at the lower end in all essential terms cannot
beat that score with all the others at their upper ends.  The postings of the essential
terms are traversed; the other terms are probed, some at a time, for rows still
competitive, that is, whose score so far plus the upper ends of the terms left reaches the
score to beat.  Survivors have exact scores; the best k of all shards are merged.

Defined results: rows without an id, and vectors that are null or hold null or non-finite
components, take no part; vectors of different lengths don't meet; a query meets every row
but its own, so rows that repeat an id meet each other and are queries of their own; equal
scores go by smaller id; scores beyond 64 bits become the largest such number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.llm.vector_shards import COMPONENTS, LARGEST, as_long, exact_type, first, largest, meet, packed, whole_numbers

SCALE = 64
QUERY_COMPONENTS = 1 << 16
SEED_TERMS, SEED_ROWS = 8, 32
STEP = 8
#: rows are set apart once fewer than this share of them is competitive
FEW = 0.1


class Postings:
    """A shard by terms: impacts of all rows, their ends, and the rows at both ends."""

    def __init__(self, vectors: np.ndarray):
        self.lists = np.ascontiguousarray(vectors.T)
        rows = self.lists.shape[1]
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)
        some = min(SEED_ROWS, rows)
        order = np.argpartition(self.lists, (some - 1, rows - some), axis=1)
        self.weakest, self.strongest = order[:, :some].copy(), order[:, rows - some :].copy()
        self.largest = largest(vectors)

    def prepare(self, query_bound: int) -> None:
        """Impacts in the type in which all scores with such queries are exact."""
        kind = exact_type(len(self.lists) * self.largest * query_bound)
        self.lists = self.lists.astype(kind)
        wide = np.float64 if kind is np.float32 else kind
        self.low, self.high = self.low.astype(wide), self.high.astype(wide)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but ``own`` (-1: none), best first, ties by place."""
        weights, wide = query.astype(self.lists.dtype), query.astype(self.low.dtype)
        low, high = np.minimum(wide * self.low, wide * self.high), np.maximum(wide * self.low, wide * self.high)
        order = np.argsort((low - high).astype(float), kind="stable")
        zero = np.zeros(1, low.dtype)
        least = np.concatenate([zero, np.cumsum(low[order])])
        left = np.concatenate([np.cumsum(high[order][::-1])[::-1], zero])
        to_beat = self._to_beat(weights, order[:SEED_TERMS], own, k)
        terms = len(order)
        at = terms if to_beat is None else min(terms, int(np.argmax(least + left < to_beat)) or terms)
        scores = weights[order[:at]] @ self.lists[order[:at]] if at else np.zeros(self.lists.shape[1], self.lists.dtype)
        rows = None
        while True:
            if to_beat is not None:
                competitive = scores >= to_beat - left[at]
                if at == terms or np.count_nonzero(competitive) < FEW * len(competitive):
                    kept = np.flatnonzero(competitive)
                    rows, scores = kept if rows is None else rows[kept], scores[kept]
            if at == terms:
                break
            probed = order[at : at + STEP]
            scores = scores + weights[probed] @ (self.lists[probed] if rows is None else self.lists[probed[:, None], rows])
            at += len(probed)
        rows = np.arange(len(scores)) if rows is None else rows
        rows, scores = rows[rows != own], as_long(scores[rows != own])
        top = np.argsort(-scores, kind="stable")[:k]
        return rows[top], scores[top]

    def _to_beat(self, weights: np.ndarray, terms: np.ndarray, own: int, k: int):
        """The k-th best score among the strongest rows of these terms; None if they are fewer."""
        seeds = [(self.strongest if weights[t] > 0 else self.weakest)[t] for t in terms]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, int)
        seeds = seeds[seeds != own]
        if len(seeds) < k:
            return None
        to_beat = np.sort(weights @ self.lists[:, seeds])[len(seeds) - k]
        if to_beat <= -LARGEST:  # all such scores count as equal
            return None
        return min(to_beat, LARGEST) if self.lists.dtype == object else to_beat


def search(table: DataFrame, asks: Column, k: int, key: str = "vec_id", values: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each row for which ``asks``, a condition on "id", holds."""
    rows = whole_numbers(table, key, values, scale)
    shards = packed(rows, COMPONENTS, lambda group, matrix: (Postings(matrix), group["id"].to_numpy(), group["row"].to_numpy()))
    blocks = packed(rows.where(asks), QUERY_COMPONENTS, lambda group, matrix: (matrix, group["id"].to_numpy(), group["row"].to_numpy()))

    def work(shard, block) -> pd.DataFrame:
        (postings, ids, members), (queries, query_ids, query_rows) = shard, block
        postings.prepare(largest(queries))
        place = {row: n for n, row in enumerate(members.tolist())}
        found = [postings.best(query, place.get(row, -1), k) for query, row in zip(queries, query_rows.tolist())]
        sizes = [len(rows) for rows, _ in found]
        rows = np.concatenate([rows for rows, _ in found])
        return pd.DataFrame({
            "query_row": np.repeat(query_rows, sizes), "query_id": np.repeat(query_ids, sizes), "row": members[rows], "id": ids[rows],
            "score": np.concatenate([scores for _, scores in found]),
        })

    found = meet(shards, blocks, work, "query_row long, query_id long, row long, id long, score long")
    return first(found, k, ["query_row"], ["id", "row"]).select("query_id", "rank", "id", "score")
