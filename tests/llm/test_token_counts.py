"""Counts against the unigram model of the tokenizers library over the same pieces."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from boxlore.llm import queries, token_counts
from tests.llm.helpers import ODD_TEXTS, SF, by, docs_of, saved

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library_of(pieces):
    made = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


@pytest.fixture(scope="module")
def library():
    return library_of(token_counts.read_pieces(PATH))


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_ties(seed):
    """Tiny vocabularies with few scores, so that most paths tie."""
    chance = random.Random(seed)
    pieces = {"".join(chance.choice("ab▁c") for _ in range(chance.randint(1, 4))) for _ in range(14)}
    pieces = [(p, -float(chance.randint(0, 2))) for p in sorted(pieces)]
    ours, theirs = token_counts.Counter(pieces), library_of(pieces)
    for _ in range(1500):
        text = "".join(chance.choice("abcd ") for _ in range(chance.randint(0, 24)))
        assert ours.count(text) == size(theirs, text), (pieces, text)


@pytest.mark.parametrize("given", ["odd", "table", "empty"])
def test_op1(spark, library, tmp_path, given):
    folder = SF if given == "table" else saved(spark, tmp_path, documents=docs_of(spark, ODD_TEXTS if given == "odd" else []))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = by(queries.op1_token_counts(spark, folder), "doc_id")
    assert {k: r.n_tokens for k, r in got.items()} == {k: size(library, t) for k, t in texts.items()}


def test_memory_bound_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_WORDS", 5)
    ours = token_counts.Counter(token_counts.read_pieces(PATH))
    assert [ours.count(" ".join(f"w{j}" for j in range(k))) for k in (30, 30)] == [ours.count(" ".join(f"w{j}" for j in range(30)))] * 2
    docs = docs_of(spark, ["a b", "a b"]).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "key")
    assert [r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()] == [2, 2]
