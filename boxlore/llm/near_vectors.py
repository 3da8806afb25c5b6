"""Near-duplicate vectors by small-world graphs per shard.

Valid vectors of one label (and length) are dealt into shards of about ``SHARD`` rows; each
shard gets a graph over its leaders (see hnsw).  Every vector queries every shard of its
label: the leaders its beam finds within reach bring their followers, whose cosines are
then computed in double precision.  A sample of each shard's queries is audited against all
vectors of the shard; while fewer than ``RECALL`` of the links are found, the beam doubles,
up to all leaders, where the search is exact.

A link is a cosine of at least ``COSINE``.  Followers of one leader are all linked with one
another, so a vector needs one link per leader it reaches for components to come out right,
and crowds of copies never become pairs; their links are counted.

Defined results: vectors without label, and those that are null, empty, zero or hold null
or non-finite numbers, link with nothing; vectors of different lengths don't link; rows
that repeat an id are vectors of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from boxlore.llm.common import written
from boxlore.llm.components import components
from boxlore.llm.hnsw import Graph

COSINE = 0.93
FOLLOW = 0.983  # so that two followers of one leader are within 2 * acos(0.983) < acos(0.93)
SHARD = 8192
BEAM = 32
RECALL = 0.999
AUDITED = 64
BLOCK = 512


def reach(cosine: float, follow: float) -> float:
    """The least cosine to a leader of which some follower can be linked (with room for rounding)."""
    return float(np.cos(np.arccos(cosine) + np.arccos(follow))) - 1e-4


def unit(values: pd.Series) -> np.ndarray:
    made = np.stack([np.asarray(v, float) for v in values])
    made /= np.abs(made).max(axis=1, keepdims=True)  # lest squares vanish or overflow
    return made / np.sqrt(np.einsum("ij,ij->i", made, made))[:, None]


def search(graph: Graph, members: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, beam: int):
    """For each query: number of links and one linked member per leader; ``own`` is its place in members or -1."""
    bound = reach(cosine, FOLLOW)
    order = np.argsort(graph.follows, kind="stable")
    starts = np.searchsorted(graph.follows[order], np.arange(len(graph.leaders) + 1))
    counts, edges = np.zeros(len(queries), np.int64), []
    for at in range(0, len(queries), BLOCK):
        found, close = graph.search(queries[at : at + BLOCK], beam)
        for leader in np.unique(found[close >= bound]):
            asked = at + np.flatnonzero(((found == leader) & (close >= bound)).any(axis=1))
            crowd = order[starts[leader] : starts[leader + 1]]
            linked = queries[asked] @ members[crowd].T >= cosine
            linked &= crowd[None, :] != own[asked][:, None]
            counts[asked] += linked.sum(axis=1)
            some = linked.any(axis=1)
            edges.append(np.stack([asked[some], crowd[linked[some].argmax(axis=1)]], axis=1))
    return counts, np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def audited_search(graph: Graph, members: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float):
    """``search`` with a beam wide enough for the audit."""
    sample = np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(int))
    all_links = queries[sample] @ members.T >= cosine
    all_links &= np.arange(len(members))[None, :] != own[sample][:, None]
    beam, most = BEAM, len(graph.leaders)
    while beam < most and search(graph, members, queries[sample], own[sample], cosine, beam)[0].sum() < RECALL * all_links.sum():
        beam *= 2
    return search(graph, members, queries, own, cosine, beam)


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(row, n, other) for ``vectors`` (row, label, values): parts of link counts, and links that connect."""
    sized = vectors.withColumn("size", F.size("values"))
    shards = sized.groupBy("label", "size").count().select(
        "label", "size", F.ceil(F.col("count") / SHARD).cast("int").alias("shards"))
    dealt = sized.join(shards, ["label", "size"]).withColumn("shard", F.expr("int(pmod(xxhash64(row), shards))"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = unit(rows["values"])
        blob = pickle.dumps((Graph(made, FOLLOW), made, rows["row"].to_numpy()))
        return pd.DataFrame({k: [rows[k].iat[0]] for k in ("label", "size", "shard", "shards")} | {"graph": [blob]})

    graphs = written(
        dealt.groupBy("label", "size", "shard").applyInPandas(build, "label long, size int, shard int, shards int, graph binary"),
        "shard-graphs",
    )
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    asking = dealt.select("label", "size", F.col("shard").alias("asking"), every.alias("shard"), "row", "values")
    asked = graphs.select("label", "size", "shard", every.alias("asking"), "graph")
    keys = ["label", "size", "asking", "shard"]

    def ask(graph_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if graph_rows.empty or rows.empty:
            return pd.DataFrame({"row": [], "n": [], "other": []}).astype({"row": "int64", "n": "int64", "other": "Int64"})
        graph, members, ids = pickle.loads(graph_rows["graph"].iat[0])
        numbers = rows["row"].to_numpy()
        place = {r: k for k, r in enumerate(ids.tolist())}
        own = np.array([place.get(r, -1) for r in numbers.tolist()])
        counts, edges = audited_search(graph, members, unit(rows["values"]), own, cosine)
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "row": np.concatenate([numbers[some], numbers[edges[:, 0]]]),
            "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]),
            "other": pd.array([*[None] * len(some), *ids[edges[:, 1]].tolist()], "Int64"),
        })

    return asked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(ask, "row long, n long, other long")


def near_duplicates(table: DataFrame, key: str = "vec_id", values: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``table``: key, n_links, component_id (smallest key reachable by links), kept."""
    rows = written(table.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(label).cast("long").alias("label"),
        F.col(values).cast("array<double>").alias("values")), "vectors")
    finite = F.forall("values", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    valid = rows.where(F.col("label").isNotNull() & finite & F.exists("values", lambda x: x != 0))
    found = written(links(valid.select("row", "label", "values"), cosine), "vector-links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    part = components(found.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")))
    placed = rows.select("row", "id").join(part.withColumnsRenamed({"node": "row", "component": "part"}), "row", "left")
    placed = written(placed.withColumn("part", F.coalesce("part", "row")), "placed-vectors")
    smallest = placed.groupBy("part").agg(F.min("id").alias("component_id"))
    whole = placed.join(written(smallest, "vector-components"), "part").join(counts, "row", "left")
    return whole.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
