"""Packing: pieces equal the tokenizer's ids, every sequence is filled without gaps, few sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

VOCABULARY = bpe.read_vocabulary()


def check_packed(rows) -> int:
    """Sequences used; each is gapless from 0 and at most 2048 long."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_query(spark):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.op9_best_fit_packing(spark, SF_SMALL).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = r
    assert set(by) == set(texts)
    lengths = []
    for d, found in by.items():
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 0]
        at = 0
        for p in range(len(found)):
            r = found[p]
            assert r["start"] == at and (p == 0 or r["length"] == packing.CAPACITY or len(found) == 1)
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(ids)
    used = check_packed(rows)
    assert used <= packing.fewest(np.array(lengths)) * 1.01 + 1


@pytest.mark.parametrize("seed", range(5))
def test_bound_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 300)
    bins, offsets, full = packing.best_fit(lengths.tolist())
    assert max(full) <= packing.CAPACITY and packing.fewest(lengths) <= len(full)
    check_packed([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths.tolist(), strict=True)])


def test_exchange_between_partitions(spark, monkeypatch):
    """Many small partitions: the exchange leaves fewer sequences than packing each alone, and loses nothing."""
    monkeypatch.setattr(packing, "PARTITION_PIECES", 20)
    rng = np.random.default_rng(3)
    items = [(i, 0, int(n)) for i, n in enumerate(rng.integers(300, 1200, 400))]
    df = spark.createDataFrame(items, "_row long, _piece int, length long")
    placed = packing.place(df).collect()
    assert sorted((r["_row"], r["_piece"]) for r in placed) == [(i, 0) for i, _, _ in items]
    length = {i: n for i, _, n in items}
    used = check_packed([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": length[r["_row"]]} for r in placed])
    alone = packing._packed(df, 20, 0).select("_part", "_bin").distinct().count()
    assert packing.fewest(np.array([n for _, _, n in items])) <= used < alone


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "word " * 5000, 4), (2, "word " * 5000, 5)], "doc_id long, text string, piece long")
    out = packing.packed_documents(docs, VOCABULARY)
    rows = out.collect()
    check_packed(rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2
    assert len([r for r in rows if r["doc_id"] is None]) == 1
    assert len([r for r in rows if r["doc_id"] == 2]) == 6
    assert packing.packed_documents(docs.limit(0), VOCABULARY).count() == 0
