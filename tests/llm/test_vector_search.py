"""Top-k search and hard negatives against all pairs; bounds of codes; hard vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlore.llm import hard_negatives, max_score, queries
from boxlore.llm.one_bit import Codes
from boxlore.llm.vector_shards import largest, narrow
from tests.llm.helpers import saved

SCHEMA = "vec_id long, embedding array<float>, label int"
HARD = [
    (2000, None, 1), (2100, [], 1), (2200, [0.0] * 6, 1), (2300, [1.0, None], 1), (2400, [float("nan")] * 6, 1), (2500, [float("inf")] * 6, 1),
    (2600, [0.5] * 6, None), (None, [0.5] * 6, 1), (2700, [0.25, -0.5], 1), (2701, [0.5, -0.5], 2), (2800, [1e30] * 6, 3), (2801, [-1e30] * 6, 4),
]


def vectors(seed, n=400, size=6):
    """Few distinct values, so scores often tie; copies and small groups."""
    chance = np.random.default_rng(seed)
    base = chance.integers(-20, 20, (n, size)) / 16
    base[chance.random(n) < 0.3] = base[0]
    return [(int(k), [float(x) for x in v], int(chance.integers(0, 4))) for k, v in enumerate(base)]


def whole(rows, scale, labelled=False):
    good = [
        (i, [min(max(math.floor(scale * float(np.float32(x))), -(1 << 63)), (1 << 63) - 1) for x in v], lab) for i, v, lab in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (lab is not None or not labelled)
    ]
    return good


def product(a, b):
    exact = sum(x * y for x, y in zip(a, b))
    return min(max(exact, -(2**63 - 1)), 2**63 - 1)


def brute_top(rows, k=20):
    good, out = whole(rows, 64), []
    for n, (q, a, _) in enumerate(good):
        if q % 20 == 0:
            found = sorted((-product(a, b), i) for m, (i, b, _) in enumerate(good) if m != n and len(a) == len(b))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def brute_negatives(rows):
    good = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in whole(rows, 256, True)]
    out = []
    for n, (q, a, own) in enumerate(good):
        if q % 100:
            continue
        scored = sorted((-product(a, b), i, lab) for m, (i, b, lab) in enumerate(good) if m != n and len(a) == len(b))
        for s, p, _ in [x for x in scored if x[2] == own][:5]:
            window = [x for x in scored if x[2] != own and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(q, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, cells", [(1, 1 << 20), (2, 400)])
def test_against_all_pairs(spark, tmp_path, monkeypatch, seed, cells):
    for module, name in ((max_score, "COMPONENTS"), (max_score, "QUERY_COMPONENTS"), (hard_negatives, "COMPONENTS"), (hard_negatives, "ANCHOR_COMPONENTS")):
        monkeypatch.setattr(module, name, cells)
    rows = vectors(seed) + HARD
    folder = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA))
    got = queries.op11_max_score(spark, folder)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows)
    got = queries.op12_hard_negatives(spark, folder)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.select(*names).collect())) == brute_negatives(rows)


def test_empty_repeated_and_clashing(spark, tmp_path):
    empty = saved(spark, tmp_path, embeddings=spark.createDataFrame([], SCHEMA))
    assert queries.op11_max_score(spark, empty).count() == queries.op12_hard_negatives(spark, empty).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (5, [0.9], 2)], SCHEMA)
    odd = twice.withColumnsRenamed({"vec_id": "row", "embedding": "size", "label": "part"}).withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    found = max_score.search(odd, F.col("id") == 0, 2, "row", "size")
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect()) == [(0, 1, 0, 4096), (0, 1, 0, 4096), (0, 2, 5, 57 * 64), (0, 2, 5, 57 * 64)]
    found = hard_negatives.mine(odd, F.col("id") == 0, key="row", values="size", label="part")
    assert [tuple(r) for r in found.collect()] == [(0, 0, 1, 5, 65536, 230 * 256)] * 2


@pytest.mark.parametrize("size, scale", [(1, 5), (3, 2), (16, 8), (100, 1 << 30)])
def test_intervals_hold_every_score(size, scale):
    chance = np.random.default_rng(size)
    made = np.floor(chance.normal(size=(300, size)) * scale + 3).astype(np.int64)
    made[:50] = made[0]
    codes = Codes(made)
    for query in made[:60]:
        _, lower, upper = codes.interval(query, [x[0] for x in codes.turned(query[None])], np.arange(len(made)))
        scores = made.astype(float) @ query
        assert (lower <= scores).all() and (scores <= upper).all()


@pytest.mark.parametrize("size, scale", [(0, 1), (4, 5), (24, 9), (6, 1 << 28), (6, 1 << 61)])
def test_max_score_is_exact(size, scale):
    chance = np.random.default_rng(size)
    made = chance.integers(-scale, scale + 1, (600, size))
    made[chance.random(made.shape) < 0.5] = 0
    postings = max_score.Postings(narrow(made))
    postings.prepare(largest(made))
    exact = made.astype(object)
    for own in range(10):
        rows, _ = postings.best(made[own], own, 20)
        scores = [min(max(sum(exact[own] * other), -(2**63 - 1)), 2**63 - 1) for other in exact]
        assert rows.tolist() == sorted((r for r in range(600) if r != own), key=lambda r: (-scores[r], r))[:20]


def test_non_essential_terms_are_not_traversed():
    """Rows far below the score to beat are dropped before the last terms are probed."""
    made = np.zeros((5000, 40), np.int64)
    made[:, 20:] = np.random.default_rng(0).integers(0, 2, (5000, 20))
    made[:30, :20] = 50
    postings = max_score.Postings(narrow(made))
    postings.prepare(50)
    probed = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            probed.append(out.size)
            return out

    postings.lists = postings.lists.view(Counted)
    rows, _ = postings.best(made[0], -1, 20)
    assert set(rows.tolist()) <= set(range(30)) and sum(probed) < made.size / 2
