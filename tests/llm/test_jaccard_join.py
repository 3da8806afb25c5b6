"""Components against brute force over all pairs."""

import random
import re
from itertools import combinations

import pytest

from boxlore.llm import jaccard_join, queries
from boxlore.llm.components import components
from tests.llm.helpers import ODD_TEXTS, by, docs_of, saved


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets, root = {k: shingle_set(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: (len(sets[k]), find(k)) for k in texts}


def mutated(chance, words, times):
    words = list(words)
    for _ in range(times):
        at = chance.randrange(len(words))
        kind = chance.random()
        if kind < 0.5:
            words[at] = f"m{chance.randrange(10**6)}"
        elif kind < 0.75 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{chance.randrange(10**6)}")
    return words


def corpus(seed):
    """Groups of near copies of all degrees, chains, a passage in unlike documents, short texts."""
    chance = random.Random(seed)
    word = lambda: f"w{chance.randrange(3000)}"
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(chance.choice([6, 12, 40, 90, 200]))]
        for _ in range(chance.choice([1, 2, 5, 30, 60])):
            out.append(" ".join(mutated(chance, base, chance.randint(0, 1 + len(base) // 18))))
    chain = [word() for _ in range(60)]
    for _ in range(25):
        chain = mutated(chance, chain, 2)
        out.append(" ".join(chain))
    out += [" ".join(passage + [word() for _ in range(chance.choice([3, 10, 30, 100]))]) for _ in range(60)]
    out += [" ".join(word() for _ in range(chance.randint(0, 7))) for _ in range(40)]
    out += chance.sample(out, 20)
    chance.shuffle(out)
    return out


@pytest.mark.parametrize("seed, common", [(1, 24), (2, 2), (3, 10**9)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    texts = dict(enumerate(corpus(seed), 1))
    folder = saved(spark, tmp_path, documents=docs_of(spark, texts.values()))
    got = by(queries.op7_jaccard_join(spark, folder), "doc_id")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute(texts)


def test_odd_texts_empty_table_and_names(spark, tmp_path):
    texts = dict(enumerate([*ODD_TEXTS, "A b C", "a B c", "É x", "é x"], 1))
    folder = saved(spark, tmp_path, documents=docs_of(spark, texts.values()))
    got = by(queries.op7_jaccard_join(spark, folder), "doc_id")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute(texts)
    assert queries.op7_jaccard_join(spark, saved(spark, tmp_path / "e", documents=docs_of(spark, []))).count() == 0
    docs = docs_of(spark, ["x y z"] * 3).withColumnsRenamed({"lang": "class", "source": "n"})
    docs = docs.union(docs.limit(1)).union(docs.limit(1).selectExpr("CAST(NULL AS LONG)", "text", "class", "n", "n_chars"))
    got = jaccard_join.join(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("None", "None")]
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_screening_lengths():
    for n in range(1, 400):
        for m in range(n, n * 5 // 4 + 1):
            common = -(-80 * (n + m) // 180)  # the smallest overlap that links sizes n and m
            if common > n:
                continue
            k = min(jaccard_join.screen_length(x) - (x - common) for x in (n, m))
            assert k >= jaccard_join.screen_need(n) and k >= jaccard_join.screen_need(m) and k >= 1, (n, m)


def test_components(spark):
    chance = random.Random(1)
    pairs = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)]
    pairs += [(chance.randrange(200, 260), chance.randrange(200, 260)) for _ in range(40)] + [(7, 7), (500, 499), (499, 500)]
    root = {k: k for p in pairs for k in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert sorted(map(tuple, got)) == sorted((k, root[k]) for k in linked)


def test_tables_of_finished_steps_are_removed(spark, tmp_path):
    """What a step needs alone goes when its result is written; repeated ids give each set once all the same."""
    import os

    folder, a = spark.conf.get("spark.checkpoint.dir"), " ".join(f"w{k}" for k in range(40))
    docs = docs_of(spark, [a, a + " x", a, "other text of six words here"])
    docs = docs.union(docs.where("doc_id = 1"))
    before = set(os.listdir(folder))
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)
    gone = ["screening", "prefixes", "link-work", "links", "stars", "large-star", "small-star", "star-links", "marked-prefixes", "shared-shingles"]
    assert not set(left) & set(gone), left
