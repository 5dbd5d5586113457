"""Quality rules: equal to DuckDB, edge cases, held-out labels, and only native functions on the main path."""

from __future__ import annotations

import re
from pathlib import Path

from conftest import SF
from oracles import assert_same

from corpusloom.llm import quality


def test_query(spark, duck):
    assert_same(quality.op4_quality_rules(spark, SF), duck(SF), quality.oracle())


def reference_stats(text: str | None) -> tuple:
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_edges(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n\nx \n x", "#a *b\n#a *b", "é ü 🙂 é ü 🙂 z", " nbsp stays one", "w " * 3000, "line of words\n" * 40, "a" * 100_000]
    docs = spark.createDataFrame([(i // 2, t, "clash", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, _q_words string, n_words double")
    out = quality.judged(docs.select("doc_id", "text"), prefix="_z_")
    got = [(r["text"], *(r[f"_z_{c}"] for c in quality.BASE_COLUMNS)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((t, *reference_stats(t)) for t in texts), key=repr)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() <= len(texts)
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_labels(spark):
    """Documents labelled good stay, most of those labelled bad go."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op4_quality_rules(spark, SF).join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.95 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.5 * len(bad)


def test_native():
    source = Path(quality.__file__).read_text()
    assert not re.search(r"\budf\b|pandas|InPandas|InArrow|\.rdd\b|numpy", source)
