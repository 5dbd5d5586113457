"""Elias-Fano sequences and tries, and scores equal to a plain model of the same smoothing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import scoring, trie


def opened(fields) -> trie.Trie:
    return trie.Trie(np.frombuffer(b"".join(trie.to_bytes(fields)), dtype=np.uint8))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=300), st.sampled_from([5001, 8192, 1 << 40]))
def test_sequence(values, universe):
    v = np.array(sorted(values), dtype=np.int64)
    s = trie.Sequence(trie.Sequence.fields(v, universe, "x"), "x")
    n = len(v)
    if n:
        assert s.access(np.arange(n)).tolist() == v.tolist()
        x = np.arange(0, 5001)
        at, found = s.successor(x, np.zeros(len(x), dtype=np.int64), np.full(len(x), n))
        assert found.tolist() == np.isin(x, v).tolist()
        assert at[found].tolist() == np.searchsorted(v, x[found]).tolist()
        lo = np.minimum(np.searchsorted(v, x) + 1, n)  # past the number itself
        assert not s.successor(x, lo, np.full(len(x), n))[1].any()


def test_equal_neighbours():
    v = np.array([0, 0, 0, 3, 3, 9], dtype=np.int64)
    assert trie.Sequence(trie.Sequence.fields(v, 10, "p"), "p").access(np.arange(6)).tolist() == v.tolist()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_trie(order):
    rng = np.random.default_rng(order)
    columns = [rng.integers(0, 12, 3000) * (10 ** rng.integers(0, 4)) for _ in range(order)]
    counts = rng.integers(1, 5, 3000)
    want = Counter()
    for k, n in zip(zip(*(c.tolist() for c in columns), strict=True), counts.tolist(), strict=True):
        want[k] += n
    fields, _, _, total = trie.build(columns, counts)
    t = opened(fields)
    asked = [c[:500] if i % 2 else np.append(c[:499], 77_777) for i, c in enumerate(columns)]
    node = np.zeros(500, dtype=np.int64)
    for level in range(order):
        node = t.child(level, node, asked[level])
    got = [int(total[i]) if i >= 0 else 0 for i in node.tolist()]
    assert got == [want.get(k, 0) for k in zip(*(a.tolist() for a in asked), strict=True)]


def test_codes():
    a = np.array([0, 1, 255, 70_000, 1 << 40])
    for part in (a[:0], a[:2], a[:3], a[:4], a):
        assert scoring.unsqueeze(scoring.squeeze(part)).tolist() == part.tolist()
    p = np.array([0.0, 1.0, 0.5, 1e-7])
    assert np.abs(scoring.decoded(scoring.coded(p)) - p).max() < 3e-4


def plain(rows, order, held):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base and score of every row, without tries or blocks."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(i, held(i), [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), ""]) for i, t in rows]
    counts, follow = [Counter() for _ in range(order + 1)], defaultdict(Counter)
    for _, h, w in docs:
        if h:
            continue
        counts[1].update(w)
        s = ["\n", *w]
        for k in range(2, order + 1):
            for j in range(k - 1, len(s)):
                follow[tuple(s[j - k + 1 : j])][s[j]] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    out = []
    for i, h, w in docs:
        s, base, score = ["\n", *w], 0.0, 0.0
        for j in range(1, len(s)):
            p = (counts[1][s[j]] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if j - k + 1 >= 0 and (f := follow.get(tuple(s[j - k + 1 : j]))):
                    total = sum(f.values())
                    p = max(f[s[j]] - scoring.DISCOUNT, 0) / total + scoring.DISCOUNT * len(f) / total * p
            score += math.log10(p)
        out.append((i, h, len(w), sum(counts[1][x] > 0 for x in w), n, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], abs=1e-6, rel=1e-9)
        assert abs(a[6] - b[6]) <= 0.0008 * b[2] + 1e-9  # quantised numbers of each order


def crc(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "block", "shard", "split"), [(2, 8 << 20, 16 << 20, 1 << 20), (3, 8 << 20, 16 << 20, 1 << 20), (2, 300, 1500, 5), (3, 300, 1500, 5), (4, 700, 3000, 9)])
def test_plain_model(spark, monkeypatch, order, block, shard, split):
    """Null ids and texts, repeated rows, one word that is a third of all, a long text, many blocks and shards, contexts dealt over shards."""
    for name, value in (("BLOCK_BYTES", block), ("SHARD_BYTES", shard), ("SPLIT_COUNT", split)):
        monkeypatch.setattr(scoring, name, value)
    rng = np.random.default_rng(3)
    words = ["the", "The", "ÄB", "a\x1cb", *(f"w{i}" for i in range(60))]
    texts = [" ".join("the" if rng.random() < 0.33 else words[int(x)] for x in rng.integers(0, len(words), int(n))) for n in rng.integers(0, 60, 80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "the w1 w2"), (81, ""), (81, ""), (1 << 60, " \t\n"), (95, "the w3 " * 2000), (2, texts[2])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block long, shard string")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    close([tuple(r) for r in scoring.scored(docs, held, order).collect()], plain(rows, order, crc))


def test_query(spark):
    """The whole table of documents: equal to the plain model; texts held out are more likely than by words alone."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in scoring.op12_ngram_scores(spark, SF).collect()]
    close(got, plain(rows, scoring.ORDER, crc))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_sums_to_one():
    """Interpolated probabilities of all words and one unknown word."""
    text = "a b a c a b b d".split()
    follow = Counter(b for a, b in zip(text, text[1:], strict=False) if a == "a")
    unigrams, n = Counter(text), len(text)
    v, total = len(unigrams), sum(follow.values())
    p = lambda w: max(follow[w] - scoring.DISCOUNT, 0) / total + scoring.DISCOUNT * len(follow) / total * (unigrams[w] + 1) / (n + v + 1)
    assert sum(p(w) for w in [*unigrams, "?"]) == pytest.approx(1)


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, scoring.scored(docs, F.lit(True)).collect()))
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert scoring.scored(docs.limit(0), F.lit(True)).count() == 0
