"""Passages, previews and contexts against plain rules."""

from __future__ import annotations

import difflib
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from corpusloom.operators import context


def values(spark, rows, make, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["y"] for r in df.select("i", make(F).alias("y")).orderBy("i").collect()]


def test_merged_lines(spark):
    cases = [
        ("a line of words\nshort", "a line of words short"),
        ("ends here。\nshort", "ends here。\nshort"),
        ("x" * 61 + "\nshort", "x" * 61 + "\nshort"),
        ("head\n- item\n图 3 x", "head\n- item\n图 3 x"),
        ("a\n\nb\nc", "a\n\nb c"),
        ("a\r\n" + "y" * 19 + "\nb", "a\n" + "y" * 19 + " b"),
        ("", ""),
        (None, ""),
    ]
    assert values(spark, [(c,) for c, _ in cases], lambda F: context.merged_lines(F.col("t")), "t string") == [w for _, w in cases]


def test_truncated(spark):
    got = [values(spark, [("abcdefghij" * 4,)], lambda F, n=n: context.truncated(F.col("t"), n), "t string")[0] for n in (40, 30, 24)]
    assert got == ["abcdefghij" * 4, "abcdefghijabcd\n[... truncated]", "abcdefghij" * 2 + "abcd"]


def test_format_hint(spark):
    names = ["a.PDF", "dir.x/file", ".md", " b.tar.GZ ", "", None, "a."]
    assert values(spark, [(n,) for n in names], lambda F: context.format_hint(F.col("t")), "t string") == [".pdf", None, ".md", ".gz", None, None, None]


@pytest.mark.parametrize("after", [True, False])
def test_widened(spark, after):
    """Each widening of random pages as a loop makes it."""
    rng = random.Random(4)
    cases = []
    for _ in range(80):
        n = rng.randint(1, 30)
        left = rng.randrange(n)
        cases.append(([rng.choice([0, 3, 40, 200]) for _ in range(n)], left, min(n - 1, left + rng.randint(0, 4))))
    wanted, span = 320, 14

    def plain(sizes, left, right):
        if after:
            while sum(sizes[left : right + 1]) < wanted and (left > 0 or right < len(sizes) - 1):
                left, right = max(0, left - 1), min(len(sizes) - 1, right + 1)
                if right - left > span:
                    break
            return left, right
        while True:
            seen = (left, right)
            if sum(sizes[left : right + 1]) >= wanted or (left == 0 and right == len(sizes) - 1):
                return seen
            left, right = max(0, left - 1), min(len(sizes) - 1, right + 1)
            if right - left > span:
                return seen

    got = values(spark, cases, lambda F: context.widened(F.col("s"), F.col("l"), F.col("r"), F.lit(wanted), span, after), "s array<int>, l int, r int")
    assert [(g["left"], g["right"]) for g in got] == [plain(*c) for c in cases]


def test_focus_seeds(spark):
    """Concepts in order, copies once, the whole question fills up; hits without page and chunk are told by their text."""
    hits = [(1, 0, 1, 7, 1, 1, "a"), (1, 0, 2, 8, 1, 2, "b"), (1, 1, 1, 8, 1, 2, "b"), (1, 1, 2, 9, None, None, "x" * 200), (1, 9, 1, 9, None, None, "x" * 160 + "y"), (1, 9, 2, 7, 1, 3, "c"), (2, 9, 1, 7, 1, 1, "a")]
    df = spark.createDataFrame(hits, "paper long, part int, rank int, doc_id long, page int, chunk int, text string")
    got = [(r["paper"], r["seed"], r["doc_id"], r["chunk"]) for r in context.focus_seeds(df, 4).orderBy("paper", "seed").collect()]
    assert got == [(1, 1, 7, 1), (1, 2, 8, 2), (1, 3, 9, None), (1, 4, 7, 3), (2, 1, 7, 1)]
    assert len(context.focus_seeds(df, 2).collect()) == 3


def test_copies():
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefg", k=120))
    near = "".join(c if rng.random() > 0.02 else "z" for c in base)
    assert context.copies("", []) and context.copies("abc", ["abc"]) and not context.copies("abc", ["abd"])
    for other in (near, base[:60], base + "x" * 30, base[::-1], base[:20]):
        want = difflib.SequenceMatcher(None, other, base).ratio() >= 0.94 and len(other) > 40
        assert context.copies(other, [base]) is want
    assert context.compared("  Ä b,\n C-d_e ") == "äbcd_e"


def test_composed():
    p = lambda seed, doc, n, q=0.5: {"seed": seed, "quality": q, "doc_id": doc, "source": doc, "text": doc * n}
    text, used = context.composed([p(1, "a", 30), p(2, "a", 30), p(3, "b", 30)], 1000, True)
    assert used == 3 and [x.split("\n")[0] for x in text.split("\n\n")] == ["来源: a", "来源: b", "来源: a"]
    text, used = context.composed([p(1, "a", 60), p(2, "b", 90)], 120, False)
    assert used == 2 and text.endswith("\n[... truncated]") and len(text) <= 120
    assert context.composed([p(1, "a", 60), p(2, "b", 90)], 66 + 2 + 40, False)[1] == 1
    assert context.composed([], 100, True) == ("", 0)


def test_seed_quality(spark):
    good = "A sentence about heat and work that goes on for quite a while, so that it says enough to be asked about."
    rows = [(good, False, None), (good, True, 0.15), ("", False, None), ("图 1 热力学系统与环境之间的能量交换过程示意", False, None), ("甲\n乙\n丙\n丁", False, None)]
    df = context.seed_quality(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, ocr boolean, page_quality double"), "text", "source").orderBy("i").collect()
    assert [r["drop"] for r in df] == [None, None, "empty", "short_caption", "low_quality"]
    assert df[0]["score"] - df[1]["score"] == pytest.approx(0.06 + 0.09, abs=1e-6)


def test_previews_find_their_chunk(spark):
    """Way, page and chunk of every document of the smallest tables, by going through the chunks in order."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["request"]: r for r in context.source_previews(spark, SF_SMALL).collect()}
    import regex

    for doc_id, text in docs.items():
        chunks, at = {}, 0
        for i, line in enumerate((text or "").split("\n")):
            c = chunks.setdefault(at // 800 + 1, {"page": at // 3000 + 1, "ids": [], "lines": []})
            c["ids"].append(f"{doc_id}:{i}")
            c["lines"].append(line)
            at += len(line) + 1
        order = sorted(chunks, key=lambda c: (chunks[c]["page"], c))
        words = [w for w in regex.split(r"[^\p{L}]+", text or "") if w]
        form, want = doc_id % 6, None
        if form == 0:
            want = next((("block_id", c) for c in order if chunks[c]["ids"][0] == f"{doc_id}:0"), None)
        elif form == 1:
            want = next((("chunk", c) for c in order if c == 2), None)
        elif form == 2:
            want = next((("page", c) for c in order if chunks[c]["page"] == 1), None)
        elif form in (3, 4):
            q = max(words, key=lambda w: (len(w), w.encode())) if form == 3 and words else "zzzz"
            want = next((("query", c) for c in order if q.lower() in "\n".join(chunks[c]["lines"]).lower()), None)
        r = got[doc_id]
        assert (r["matched_by"], r["chunk"], r["page"]) == ((want[0], want[1], chunks[want[1]]["page"]) if want else ("text", None, None)), doc_id


def test_contexts(spark):
    """A paper that loses poor seeds and copies, one whose seeds are all poor."""
    words = "heat work energy entropy law system state pressure volume gas liquid engine cycle process".split()
    rng = random.Random(1)
    line = lambda: " ".join(rng.choices(words, k=14)) + "."
    text = "\n".join(line() for _ in range(60))
    docs = [(1, text), (2, text), (3, "a\nb\nc\nd"), (4, "\n".join(line() for _ in range(40)))]
    lines = [(d, i, f"{d}:{i}", 1 + i // 30, 1 + i // 8, x) for d, t in docs for i, x in enumerate(t.split("\n"))]
    b = spark.createDataFrame(lines, "doc_id long, ord int, block_id string, page long, chunk long, text string")
    e = context.entries(b)
    seeds = e.join(spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 1), (1, 3, 3, 1), (1, 4, 4, 2), (5, 1, 3, 1)], "paper long, seed int, doc_id long, chunk long"), ["doc_id", "chunk"])
    seeds = seeds.select("paper", "seed", "doc_id", "page", "chunk", F.concat(F.lit("s"), "doc_id").alias("source"), F.col("content").alias("text"))
    got = {r["paper"]: r for r in context.contexts(seeds, e, context.pages(b), F.lit(4000)).collect()}
    assert (got[1]["seeds"], got[1]["filtered"], got[1]["used"], got[1]["fallback"], got[1]["dropped"]) == (4, 1, 2, False, "empty=1")
    assert got[1]["context"].count("来源: ") == 2 and "来源: s4" in got[1]["context"] and len(got[1]["context"]) <= 4000
    assert got[5]["fallback"] and got[5]["filtered"] == 1
