"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxlore.llm import byte_bpe, packing, queries
from tests.llm.helpers import ODD_TEXTS, SF, by, docs_of, saved

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_random_texts(library):
    chance = random.Random(3)
    made = ["".join(chance.choice(" \n\t ab'ts1٣é日 .,!<|>") for _ in range(chance.randint(0, 60))) for _ in range(5000)]
    made += ["".join(chance.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    ours = byte_bpe.Encoder(PATH)
    for text, ids in zip(made, ours.encode_batch(made)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text), text
        assert ours.decode(ids) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_packing_encodes_the_same(library):
    compiled = packing.Tokens(PATH)
    for text in [*filter(None, ODD_TEXTS), " " * 200_000 + "x", "z" * 50_000]:
        assert np.frombuffer(compiled.encode(text), "<u4").tolist() == ids_of(library, text)


def test_memory_bound_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY_WORDS", 20)
    ours = byte_bpe.Encoder(PATH)
    made = [" ".join(f"w{k}x{j}" for k in range(j % 60)) for j in range(80)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_batch(made)] == [ids_of(library, t) for t in made]


def test_decode_broken_bytes(library):
    ours = byte_bpe.Encoder(PATH)
    ids = [128, 200, 64, 250, 50256, 190]
    assert ours.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("given", ["odd", "table", "empty"])
def test_op5(spark, library, tmp_path, given):
    if given == "table":
        folder = SF
    else:
        folder = saved(spark, tmp_path, documents=docs_of(spark, ODD_TEXTS if given == "odd" else []))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = by(queries.op5_byte_bpe(spark, folder), "doc_id")
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = ids_of(library, text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[key].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("given", ["odd", "table", "empty"])
def test_op2(spark, library, tmp_path, given):
    folder = SF if given == "table" else saved(spark, tmp_path, documents=docs_of(spark, ODD_TEXTS if given == "odd" else []))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op2_packing(spark, folder).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = {}
    for row in rows:
        assert row.offset == 0 and row.length & (row.length - 1) == 0 and 0 < row.length <= 2048
        pieces.setdefault(row.doc_id, []).append(row)
    assert pieces.keys() == texts.keys()
    for key, text in texts.items():
        ids, at = [*ids_of(library, text), 1], 0
        for row in sorted(pieces[key], key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(np.array(ids[at : at + row.length], "<u4").tobytes())
            at += row.length
        assert at == len(ids)


def test_repeated_rows_and_buckets(spark, tmp_path):
    docs = docs_of(spark, ["a b c", "a b c"]).unionByName(docs_of(spark, ["a b c"]))
    pieces = packing.pack(docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "length"), PATH)
    assert pieces.count() == 3
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    assert {r.bucket for r in spark.read.parquet(f"{tmp_path}/buckets").collect()} == {4}


def test_a_batch_is_learned_once(library, monkeypatch):
    """Generations change between batches only, so a batch never forgets what it has learned."""
    monkeypatch.setattr(byte_bpe, "MEMORY_WORDS", 20)
    ours, calls = byte_bpe.Encoder(PATH), []
    learn = ours._learn
    monkeypatch.setattr(ours, "_learn", lambda chunks: (calls.append(1), learn(chunks)))
    made = [" ".join(f"w{k}y{j}" for k in range(60)) for j in range(40)]
    for batch in (made[:20], made[20:], made[:20]):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_batch(batch)] == [ids_of(library, t) for t in batch]
    assert len(calls) == 3 and len(ours.chunks) <= 20 * 60
