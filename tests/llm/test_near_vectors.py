"""Links and components against all pairs; recall of the graph; hard vectors."""

import numpy as np
import pandas as pd
import pytest

from boxlore.llm import near_vectors, queries
from boxlore.llm.hnsw import Graph
from tests.llm.helpers import SF, by, saved

SCHEMA = "vec_id long, embedding array<float>, label int"


def valid(vector, label):
    return label is not None and vector is not None and len(vector) and None not in vector and np.isfinite(vector).all() and np.any(vector)


def brute(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if valid(v, lab)]
    n, root = dict.fromkeys((i for i, _, _ in rows), 0), {i: i for i, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[:a]:
            if p == q and len(x) == len(y):
                u, v = x / np.abs(x).max(), y / np.abs(y).max()
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    low, high = sorted((find(i), find(j)))
                    root[high] = low
    return {i: (n[i], find(i), find(i) == i) for i in n}


def crowd(seed, size=260):
    """Groups at all distances about the threshold, copies, chains."""
    chance = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = chance.normal(size=16)
            for _ in range(int(chance.integers(1, 24))):
                noise = chance.normal(size=16) * chance.choice([0, 0.02, 0.1, 0.2, 0.3])
                rows.append((k := k + 1, [float(np.float32(x)) for x in base + noise], label))
    return rows[:size]


HARD = [
    (1001, None, 1), (1002, [], 1), (1003, [0.0, 0.0], 1), (1004, [1.0, None], 1), (1005, [float("nan"), 1.0], 1),
    (1006, [float("inf"), 1.0], 1), (1007, [1.0, 2.0], None), (1008, [1.0, 2.0], None), (1009, [1e38, 2e38], 1), (1010, [1e-38, 2e-38], 1),
    (1011, [1.0, 2.0, 0.0], 1), (1012, [3.0, 6.0], 2),
]


@pytest.mark.parametrize("seed, shard", [(1, 8192), (2, 20), (3, 5)])
def test_against_all_pairs(spark, tmp_path, monkeypatch, seed, shard):
    monkeypatch.setattr(near_vectors, "SHARD", shard)
    rows = crowd(seed) + HARD
    folder = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA))
    got = by(queries.op3_near_vectors(spark, folder), "vec_id")
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == brute(rows)


def test_recall_of_graph():
    chance = np.random.default_rng(0)
    vectors = near_vectors.unit(pd.Series(list(chance.normal(size=(3000, 16)))))
    graph = Graph(vectors, 0.9999)
    found, _ = graph.search(vectors[:300], 64)
    nearest = np.argsort(-(vectors[:300] @ vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(graph.leaders[f[f >= 0]]) & set(n)) / 10 for f, n in zip(found, nearest)]) > 0.95


def test_table_empty_and_repeated_rows(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = by(queries.op3_near_vectors(spark, SF), "vec_id")
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == brute(rows)
    assert queries.op3_near_vectors(spark, saved(spark, tmp_path, embeddings=spark.createDataFrame([], SCHEMA))).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [5.0, 1.0], 1)], SCHEMA)
    got = near_vectors.near_duplicates(twice.withColumnsRenamed({"vec_id": "row", "embedding": "size"}), "row", "size").collect()
    assert sorted((str(r.row), r.n_links, r.kept) for r in got) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]
