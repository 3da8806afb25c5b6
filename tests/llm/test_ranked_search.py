"""Ranked search against plain scoring of every document; the graph of shared sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from boxlore.llm import queries, ranked_search
from boxlore.llm.shared_terms import Plan
from tests.llm.helpers import DOCS, ODD_TEXTS, SF, docs_of, saved

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(i, Counter(words(t))) for i, t in docs]
    lengths = [sum(bag.values()) for _, bag in bags]
    n, total = sum(map(bool, lengths)), sum(lengths)
    df = Counter(term for _, bag in bags for term in bag)
    out = []
    for item, text in items:
        found = []
        for (i, bag), size in zip(bags, lengths):
            m = 75 + 25 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in words(text) if bag[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_against_plain_scoring(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CELLS", 200)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    texts = [(d.doc_id, d.text) for d in docs] + [(9000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "word one"), (9001, "word"), (9001, "word")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "zzzzqq"), (903, "word WORD word one"), (903, "word WORD word one"), (None, "Ünïcode word"), (905, "\x00 a|b~c")]
    folder = saved(
        spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS), benchmark=spark.createDataFrame(items, ITEMS))
    assert rows(queries.op13_ranked_search(spark, folder)) == brute(texts, items)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], ITEMS)
    folder = saved(spark, tmp_path, documents=docs_of(spark, []), benchmark=some)
    assert queries.op13_ranked_search(spark, folder).count() == 0
    folder = saved(spark, tmp_path, documents=docs_of(spark, ["a"]), benchmark=none)
    assert queries.op13_ranked_search(spark, folder).count() == 0
    odd = docs_of(spark, ["a b", "b", "c"]).withColumnsRenamed({"doc_id": "n", "text": "id", "lang": "terms", "source": "score"})
    found = ranked_search.rank(odd, some.withColumnsRenamed({"item_id": "row", "text": "query"}), 20, "n", "id", "row", "query")
    assert [(r.item, r.id) for r in found.sort("rank").collect()] == [(1, 1), (1, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_graph_of_shared_sums(seed):
    chance = np.random.default_rng(seed)
    common = chance.integers(0, 60, (6, 8))
    bags = [
        [*common[chance.integers(0, 6)].tolist(), *common[chance.integers(0, 6)].tolist(), *chance.integers(0, 60, chance.integers(0, 9)).tolist()]
        for _ in range(50)
    ] + [[], [3], [3, 3, 3], [3, 3, 3]]
    plan = Plan(bags, 60)
    values = chance.integers(0, 1000, (60, 7))
    assert (plan.scores(values) == np.array([values[bag].sum(axis=0) for bag in bags])).all()
    assert plan.additions() < 0.7 * sum(max(0, len(bag) - 1) for bag in bags)


def test_equal_queries_are_summed_once():
    plan = Plan([[1, 2, 3, 4]] * 9, 5)
    assert plan.additions() == 3
