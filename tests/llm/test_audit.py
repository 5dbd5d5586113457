"""Filter audit: equal to SQL, to counting every order over every row, and its edge cases."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest
from conftest import SF
from oracles import assert_same

from corpusloom.llm import audit


def test_query(spark, duck):
    assert_same(audit.op13_filter_audit(spark, SF), duck(SF), audit.ORACLE)


def plain(rows, labels):
    """All orders, row by row, without bitsets."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i), strict=True) if bad}
        docs.append((s or "", fails, i in good, i in toxic))
    out, total = [], Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in own if f in d[1] and not d[1] & before]
                total[part, f] += len(gone)
                out.append([part, "".join(order), step, sum(not d[1] & (before | {f}) for d in own), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_plain_counts(spark, tmp_path, monkeypatch, block):
    """Null texts, sources, ids and labels, repeated rows and labels, one text over many parts, a very long text."""
    monkeypatch.setattr(audit, "BLOCK", block)
    words = [f"w{i}" for i in range(80)]
    texts = [None, "", " ".join(words), " ".join(words[:49]), "A B C # d", "the the " * 40, "X" * 300_000, " ".join(words) + " |\x1c", "copy " * 10]
    rows = [(None if i % 31 == 7 else i // 3 * 2, texts[i % 9], [None, "", "hot", "hot", "hot", f"s{i}"][i % 6]) for i in range(200)]
    labels = [(i % 140 if i % 9 else None, [0, 1, None][i % 3], [1, 0][i % 2]) for i in range(150)]
    spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, fails int, part int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = audit.op13_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert audit.op13_filter_audit(spark, str(tmp_path)).count() == 0
