"""Removed words against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from boxlore.llm import queries, substring_dedup
from tests.llm.helpers import ODD_TEXTS, SF, by, docs_of, saved


def brute(texts):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    counts = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    """Shared passages of lengths around the window, repeats inside a text, copies, loops of few words."""
    chance = random.Random(seed)
    words = lambda n: [f"w{chance.randrange(4000)}" for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 50, 80, 300)]
    out = []
    for _ in range(120):
        text = words(chance.choice([0, 3, 20, 60, 200]))
        for _ in range(chance.choice([0, 0, 1, 1, 2, 3])):
            p = chance.choice(passages)
            start = chance.randint(0, max(0, len(p) - 30))
            text += p[start : start + chance.randint(30, 400)] + words(chance.choice([0, 5, 40]))
        out.append(text)
    out += [["x"] * n for n in (34, 35, 36, 37, 500)] + [(["a", "b"] * 60) + words(10), ["p", "q", "r"] * 40]
    loop = words(7)
    out += [loop * 20, words(3) + loop * 9]
    texts = [" ".join(t) for t in out]
    texts += chance.sample(texts, 15)
    texts += [t.replace(" ", "\n\t", 3) for t in chance.sample(texts, 5)]
    chance.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, group", [(1, 2000), (2, 3), (3, 0)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    texts = dict(enumerate(corpus(seed), 1))
    got = by(queries.op8_substring_dedup(spark, saved(spark, tmp_path, documents=docs_of(spark, texts.values()))), "doc_id")
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute(texts)


@pytest.mark.parametrize("given", ["odd", "table", "empty"])
def test_odd_texts_and_table(spark, tmp_path, given):
    folder = SF if given == "table" else saved(spark, tmp_path, documents=docs_of(spark, ODD_TEXTS if given == "odd" else []))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = by(queries.op8_substring_dedup(spark, folder), "doc_id")
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute(texts)


def test_remove_keeps_columns_nulls_and_repeated_ids(spark):
    long = " ".join(f"u{k}" for k in range(60))
    docs = docs_of(spark, [long + " tail  one", "x\n" + long, None, "a  b", "c"]).withColumnsRenamed({"lang": "class", "source": "c"})
    docs = docs.union(docs.where("doc_id = 4").selectExpr("CAST(NULL AS LONG)", "text", "class", "c", "n_chars"))
    docs = docs.union(docs.where("doc_id = 5").selectExpr("4L", "text", "class", "c", "n_chars"))
    got = substring_dedup.remove(docs)
    assert got.columns == docs.columns
    rows = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert rows == sorted([("1", "tail one"), ("2", "x"), ("3", None), ("4", "a  b"), ("5", "c"), ("None", "a  b"), ("4", "c")], key=str)


def test_copies_go_with_other_white_space(spark):
    long = " ".join(f"u{k}" for k in range(40))
    docs = docs_of(spark, [long, long.replace(" ", "\n"), long, "short", "short"])
    assert [r.text for r in substring_dedup.remove(docs).orderBy("doc_id").collect()] == ["", "", "", "short", "short"]
