"""Hard negatives by rotated one-bit codes and integer scores of what their intervals leave.

Vectors become whole numbers; a score is their integer inner product.  Codes of each shard
give, for an anchor, an interval around every row's score (see one_bit).  First the
anchor's positives, its best rows of the same label: rows of the best estimates are scored,
the k-th best of them is the score to beat, and every row whose interval reaches it is
scored.  The best of all shards are merged, and then each positive asks for the best
rows of other labels whose score lies within a window below its own; again only rows whose
interval meets a window, and reaches the k-th best score found in it, are scored.

Defined results: rows without id or label, and vectors that are null or hold null or
non-finite components, take no part; vectors of different lengths don't meet; rows that
repeat an id are rows and anchors of their own; equal scores go by smaller id; scores
beyond 64 bits become the largest such number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.llm.one_bit import Codes
from boxlore.llm.vector_shards import COMPONENTS, LARGEST, as_long, exact_type, first, largest, meet, packed, whole_numbers

SCALE = 256
ANCHOR_COMPONENTS = 1 << 15
#: rows of the best estimates that are scored to find a score to beat
TRIED = 64
#: a negative's share of the positive's score, as a fraction
SHARE = (80, 100)


class Shard:
    """A shard's vectors with their codes; places are in order of ids."""

    def __init__(self, group: pd.DataFrame, vectors: np.ndarray):
        self.vectors, self.largest, self.codes = vectors, largest(vectors), Codes(vectors)
        self.ids, self.rows, self.labels = (group[c].to_numpy() for c in ("id", "row", "label"))

    def scores(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        kind = exact_type(len(query) * self.largest * largest(query))
        return as_long(self.vectors[places].astype(kind) @ query.astype(kind))

    def best(self, query: np.ndarray, turned: list[np.ndarray], may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best of the rows that ``may`` allows."""
        allowed = np.flatnonzero(may)
        estimate, _, upper = self.codes.interval(query, turned, allowed)
        upper = np.maximum(upper, -LARGEST)
        tried = allowed[np.argpartition(-estimate, TRIED)[:TRIED]] if len(allowed) > TRIED else allowed
        if len(tried) >= k:
            allowed = allowed[upper >= np.sort(self.scores(query, tried))[-k]]
        scores = self.scores(query, allowed)
        top = np.argsort(-scores, kind="stable")[:k]
        return allowed[top], scores[top]

    def within(
        self, query: np.ndarray, turned: list[np.ndarray], may: np.ndarray, windows: list[tuple[int, int]], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends belong to it): places and scores of its k best allowed rows."""
        allowed = np.flatnonzero(may)
        estimate, lower, upper = self.codes.interval(query, turned, allowed)
        lower, upper = np.minimum(lower, LARGEST), np.maximum(upper, -LARGEST)  # as scores are cut
        wanted = np.zeros(len(allowed), bool)
        for low, high in windows:
            meets = (upper >= low) & (lower <= high)
            some = np.flatnonzero(meets)
            if len(some) > TRIED:
                near = some[np.argpartition(np.abs(estimate[some] - high), TRIED)[:TRIED]]
                scores = self.scores(query, allowed[near])
                scores = scores[(scores >= low) & (scores <= high)]
                if len(scores) >= k:
                    meets &= upper >= np.sort(scores)[-k]
            wanted |= meets
        places = allowed[wanted]
        scores = self.scores(query, places)
        order = np.argsort(-scores, kind="stable")
        places, scores = places[order], scores[order]
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))[:k]
            out.append((places[inside], scores[inside]))
        return out


def window(positive: int, share: tuple[int, int] = SHARE) -> tuple[int, int]:
    """Whole scores s with share[0] * positive <= share[1] * s <= share[1] * positive."""
    return -(-share[0] * positive // share[1]), positive


def mine(
    table: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, key: str = "vec_id", values: str = "embedding",
    label: str = "label", scale: int = SCALE, share: tuple[int, int] = SHARE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``asks``, a condition on "id", holds."""
    rows = whole_numbers(table.where(F.col(label).isNotNull()), key, values, scale, label)
    shards = packed(rows, COMPONENTS, Shard)
    anchors = rows.where(asks)
    blocks = packed(anchors, ANCHOR_COMPONENTS, lambda group, matrix: (group.drop(columns="values"), matrix))

    def same(shard: Shard, block) -> pd.DataFrame:
        out = []
        for anchor, query, *turned in zip(block[0].itertuples(), block[1], *shard.codes.turned(block[1])):
            places, scores = shard.best(query, turned, (shard.labels == anchor.label) & (shard.rows != anchor.row), positives)
            out.append(pd.DataFrame({"anchor": anchor.row, "row": shard.rows[places], "id": shard.ids[places], "score": scores}))
        return pd.concat(out).astype("int64")

    best = first(meet(shards, blocks, same, "anchor long, row long, id long, score long"), positives, ["anchor"], ["id", "row"])
    best = best.groupBy("anchor").agg(F.collect_list(F.struct("row", "id", "score")).alias("positives"))
    asking = anchors.join(best.withColumnRenamed("anchor", "row"), "row")
    asked = packed(asking, ANCHOR_COMPONENTS, lambda group, matrix: (group.drop(columns="values"), matrix))

    def other(shard: Shard, block) -> pd.DataFrame:
        out = []
        for anchor, query, *turned in zip(block[0].itertuples(), block[1], *shard.codes.turned(block[1])):
            windows = [window(int(p["score"]), share) for p in anchor.positives]
            found = shard.within(query, turned, shard.labels != anchor.label, windows, negatives)
            for p, (places, scores) in zip(anchor.positives, found):
                out.append(pd.DataFrame({
                    "anchor": anchor.row, "positive": p["row"], "anchor_id": anchor.id, "positive_id": p["id"], "positive_score": p["score"],
                    "row": shard.rows[places], "id": shard.ids[places], "score": scores}))
        return pd.concat(out).astype("int64")

    found = meet(
        shards, asked, other, "anchor long, positive long, anchor_id long, positive_id long, positive_score long, row long, id long, score long")
    return first(found, negatives, ["anchor", "positive"], ["id", "row"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
