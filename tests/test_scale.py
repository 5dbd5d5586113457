"""What keeps work in proportion: expressions computed once, tables written once, lines found from the end of a text."""

from __future__ import annotations

import time
import unicodedata

from conftest import SF_SMALL
from pyspark.sql import functions as F

from corpusloom.functions import lexical as lx
from corpusloom.operators import base_graph, concepts, context, graph, papers, recommend, retrieval, text


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_passage_computes_places_once(spark):
    rows = [([str(i) for i in range(6)], [f"text {i}" for i in range(6)], ["2", "3"]), (["a"], ["text"], None)]
    df = context.with_passage(spark.createDataFrame(rows, "ids array<string>, texts array<string>, b array<string>"), "p", F.col("b"), 20, 4, True)
    assert [r["p"] for r in df.collect()] == ["text 1\n\ntext 2\n\ntext 3\n\ntext 4", None]
    assert optimized(df).count("array_contains") <= 2


def test_source_previews_plan_is_short(spark):
    assert optimized(context.source_previews(spark, SF_SMALL)).count("array_contains") <= 2


def test_last_line_of_long_text(spark):
    long = "x" * 400_000
    df = spark.createDataFrame([(f"{long}\nend",), (long,), ("a\n",), ("",), (None,)], "t string")
    began = time.time()
    got = df.select(F.char_length(text.first_line(F.col("t"))), text.last_line(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(400_000, "end"), (400_000, long), (1, ""), (0, ""), (None, None)]
    assert time.time() - began < 20


def test_repeated_edges_of_long_lines(spark, tmp_path):
    rows = [(i, "s", f"Head\n{'x' * 200_000}\nFoot") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    assert sorted(tuple(r) for r in text.repeated_edges(spark, str(tmp_path)).collect()) == [("s", "foot", 4), ("s", "head", 4)]
    assert [r["removed"] for r in text.edge_noise_removed(spark, str(tmp_path)).collect()] == [2] * 4
    assert time.time() - began < 30


def test_bm25_writes_chunks_not_postings(spark, monkeypatch):
    sizes, real = {}, retrieval.stored

    def stored(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(retrieval, "stored", stored)
    chunks = spark.createDataFrame([("s", i, [f"w{i // 2}_{j}" for j in range(20)]) for i in range(50)] + [("s", 50, ["rare", "rare"]), ("s", 51, [])], "scope string, id long, tokens array<string>")
    asked = spark.createDataFrame([("s", 1, ["rare", "w1_3"])], "scope string, question long, tokens array<string>")
    got = retrieval.bm25(chunks, asked, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [50, 2]
    assert max(sizes.values()) <= 501  # different terms; there are 1,001 postings


def test_points_are_analysed_once(spark):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1. red green", "2. red green blue", "x red green blue"])], "doc_id long, place int, text string")
    assert optimized(graph.edges_of(p)).count("regexp_extract_all") == 1
    got = sorted((r["from_place"], r["to_place"], r["confidence"], r["rank"]) for r in graph.edges_of(p).collect())
    assert got == [(0, 1, graph.STRONG, 1), (1, 2, graph.MEDIUM, 3)]


def test_base_points_are_written_once(spark):
    assert "Window" not in optimized(base_graph.base_points(spark, SF_SMALL))


def test_locks_go_to_the_tasks(spark):
    assert "strategy=broadcast" in recommend.state(spark, SF_SMALL)._jdf.queryExecution().analyzed().toString()


def test_levels_need_no_sort(spark):
    plan = recommend.state(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_questions_are_parsed_once(spark):
    df = papers.validated(spark.createDataFrame([('{"question": "Which?", "explanation": "So"}', "single")], "raw string, kind string"))
    assert optimized(df).count("parse_json(") + optimized(df).count("parseJson") <= 1
    assert optimized(df).count("$.question") == 1
    assert df.first()["reason"] == "invalid_options"


def test_candidates_are_computed_once(spark):
    lines = spark.createDataFrame([(1, 0, "One concept here"), (1, 1, "one  concept here."), (1, 2, "")], "doc_id long, place int, line string")
    out = concepts.postprocessed(lines)
    assert optimized(out).count("LogicalRDD") == 1
    assert [r["verdict"] for r in out.orderBy("place").collect()] == ["kept", "duplicate", "empty"]


def test_nfkc_in_blocks(spark):
    texts = ["plain", None, "", "ﬁ" * 700_000, "Ａ１", "é", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.coalesce(1).select("i", lx.nfkc("t").alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert "octet_length" in optimized(df.select(lx.nfkc("t")))
