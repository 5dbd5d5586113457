"""The corpus pipeline, stage after stage."""

from __future__ import annotations

import random

import corpus_pipeline
from conftest import SF, SF_SMALL

from corpusloom.llm import jaccard, quality
from corpusloom.llm.common import clean_text


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "best_fit_packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF_SMALL)
        assert left.columns == docs.columns, name
        if name == "near_duplicates":  # what is left holds no near-duplicates
            again = jaccard.near_duplicates(left.select("doc_id", clean_text(left).alias("text")))
            assert again.filter("doc_id <> class_id or n_links > 0").count() == 0
    rows = left.collect()
    assert 0 < len(rows) < docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    kept = {r["doc_id"] for r in quality.op4_quality_rules(spark, SF_SMALL).filter("kept").collect()}
    assert {r["doc_id"] for r in rows} <= kept


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    per = {}
    for r in out.collect():
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0


def test_nulls_ties_and_long_texts(spark):
    """Null columns, repeated rows, empty and very long texts and ids above 2^53 through all stages."""
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["river", "stone", "walked", "under", "quiet", "seven", "letters", "carried", "morning", "bread"]) + rng.choice(["", "s", "ed", "ing", ","]) for _ in range(90)) + "."
    rows = [(2**53 + i, f"{prose()}\n{prose()}", None, f"s{i}", 5) for i in range(8)]
    rows += [(None, rows[0][1] + " and a half", "en", None, None), rows[3], rows[3], (9, None, None, None, None), (10, "", "en", "x", 0), (11, "word " * 60_000, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = [r["doc_id"] for r in docs.collect()]
    assert len(left) == len(set(left)) and set(left) <= {2**53 + i for i in range(8)} | {None} and len(left) >= 5
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(left)
