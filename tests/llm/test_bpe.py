"""Byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe

VOCABULARY = bpe.read_vocabulary()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


HARD = ["", " ", "  a", "a  b", "\n\n x", "don't we'll I'm", "naïve café ß", "日本語のテキスト", "🙂👍🏽", "<|endoftext|>a<|endoftext|>", "a<|endoftext", "123 4567 8", "x" * 5000, "ab" * 3000 + " " * 50, "   x", "a\r\nb\tc", "\x00\x7f\x80"]


def test_hard_texts(library):
    e = bpe.TrieEncoder(VOCABULARY)
    for t, data in zip(HARD, e.encode(HARD), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(data) == want
        assert e.decode(data) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    e = bpe.encoder(VOCABULARY)
    t = _library()
    assert ids_of(next(e.encode([text]))) == t.encode(text, add_special_tokens=False).ids


_made: list = []


def _library():
    if not _made:
        _made.append(Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))))
    return _made[0]


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op8_bpe_round_trip(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_operator_edges(spark):
    docs = spark.createDataFrame([(1, None, "n"), (1, "hello world", "x"), (None, "", "y"), (2, "hello world", None)], "doc_id long, text string, `_text2` string")
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted(map(repr, back.select("doc_id", "text", "_text2").collect())) == sorted(map(repr, docs.fillna("", ["text"]).select("doc_id", "text", "_text2").collect()))
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0
    clash = docs.withColumnRenamed("_text2", "_text")
    assert bpe.encode(clash, VOCABULARY).count() == 4


def test_few_words_remembered(monkeypatch):
    """Generations that change with every block give the same ids."""
    monkeypatch.setattr(bpe, "BLOCK_CHARACTERS", 40)
    vocabulary = bpe.read_vocabulary()
    texts = [f"the cat number {i} sat, on the mat {i % 7} don't  again\n" * (1 + i % 3) for i in range(60)] + ["", " ", "x"]
    assert list(bpe.TrieEncoder(vocabulary, 3).encode(texts)) == list(bpe.TrieEncoder(vocabulary).encode(texts))
