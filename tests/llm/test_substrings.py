"""Repeated passages against the contract's wording, evaluated by brute force."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from conftest import SF_SMALL

from corpusloom.llm import substrings
from corpusloom.llm.common import clean_text


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    def finish(part: pd.DataFrame, masks: list) -> pd.DataFrame:
        import hashlib

        out = []
        for i, t, m in zip(part["doc_id"], part["text"], masks, strict=True):
            words = t.encode().split()
            gone = set() if m is None else {j for j, x in enumerate(m.tolist()) if x}
            out.append((None if pd.isna(i) else int(i), len(words), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    docs = docs.select("doc_id", clean_text(docs).alias("text"))
    return substrings.without_repeats(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def planted(seed: int) -> list:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 120, 300)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([0, 3, 49, 60, 200]))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[rng.randrange(3) :]
        rows.append((rng.choice([i, i, i, 7]), rng.choice([" ", "\n", " \t "]).join(words)))
    same = "same words again " * 100
    return [*rows, (100, same), (90, same), (90, same), (101, None), (None, same), (102, ""), (103, "x" * 4000), (104, "a b " * 400)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = planted(seed)
    want = sorted(substrings.brute_force(rows), key=repr)
    assert sorted((tuple(r) for r in run(spark, rows).collect()), key=repr) == want
    assert sum(r[2] for r in want) > 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.op7_substring_dedup(spark, SF_SMALL).collect()), key=repr)
    assert got == sorted(substrings.brute_force(rows), key=repr)


def test_empty(spark):
    assert run(spark, []).count() == 0
