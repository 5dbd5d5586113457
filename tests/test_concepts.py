"""Concepts: reasons of the strict mode, explanations."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import keys
from corpusloom.operators import concepts
from corpusloom.operators.ordering import followers, ranked


def test_strict_reasons(spark):
    lines = ["- 线性代数。", "线性 代数", "", "短", "第三章 矩阵", "2024", "核心概念", "本节的核心概念有", "长" * 41, "线性代数", "A line of words"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, place int, line string")
    got = {r["place"]: r["verdict"] for r in concepts.postprocessed(df).collect()}
    want = ["kept", "duplicate", "empty", "length", "heading", "heading", "generic", "generic", "length", "duplicate", "kept"]
    assert [got[i] for i in range(len(lines))] == want


def test_explanations(spark):
    rows = [("Matrix", None), ("Matrix", " "), ("Matrix", "matrix."), ("Matrix", "a matrix"), ("Matrix", "a table of numbers with rows"), ("Matrix", "x" * 100), ("Matrix", "y" * 78 + "., and more")]
    df = spark.createDataFrame(rows, "t string, e string").select(concepts.explanation_text(F.col("t"), F.col("e")).alias("x"))
    assert [r["x"] for r in df.collect()] == [None, None, None, None, "a table of numbers with rows", "x" * 80, "y" * 78]


def test_semantic_pairs_need_near_vectors(spark):
    pairs = spark.createDataFrame([("k", 1, 2, 0.5), ("k", 1, 3, 0.9), ("k", 2, 4, 0.6)], "kb string, a long, b long, similarity double")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.3, 1.0]), (3, [1.0, 0.0])], "id long, vector array<float>")
    assert [(r["a"], r["b"], r["distance"]) for r in concepts.semantic_pairs(pairs, vectors).collect()] == [(1, 2, 0.09)]


def test_lookup_takes_the_best_way(spark):
    members = spark.createDataFrame([("k", "矩阵的秩", 1, 1), ("k", "矩阵 秩", 5, 1), ("k", "矩阵秩", 3, 3), ("j", "Rank", 2, 2)], "kb string, concept string, doc_id long, representative long")
    asked = spark.createDataFrame([("k", "矩阵秩"), ("k", "矩阵 秩"), ("k", "1. 矩阵的秩。"), ("k", "rank"), ("j", "rank"), ("j", None)], "kb string, text string")
    got = {(r["kb"], r["text"]): r["representative"] for r in concepts.representative_of(asked, members).collect()}
    assert got == {("k", "矩阵秩"): 3, ("k", "矩阵 秩"): 1, ("k", "1. 矩阵的秩。"): 1, ("k", "rank"): None, ("j", "rank"): 2, ("j", None): None}


def test_places_and_followers_across_blocks(spark):
    ids = [0, 1, 2, 3, 4095, 4096, 9000, 9001, 9002, 9003, 9004, 30000, 40000, 40001]
    df = spark.createDataFrame([("a", i) for i in ids] + [(None, i) for i in ids[:3]], "g string, i long")
    r = {x["i"]: (x["_place"], x["_many"]) for x in ranked(df, "g", "i").filter("g = 'a'").collect()}
    assert r == {i: (n, len(ids)) for n, i in enumerate(ids)}
    rows = followers(df, "g", "i", ["i"], 3, "i").collect()
    assert len(rows) == len(ids) + 3
    for x in rows:
        line = ids if x["g"] else ids[:3]
        after = line[line.index(x["i"]) + 1 :][:3]
        assert [y and y["i"] for y in x["_next"]] == after + [None] * (3 - len(after))


def test_keys_in_compatibility_form(spark):
    """Full-width letters, ligatures and superscripts compare as plain ones."""
    df = spark.createDataFrame([("Ｍａｔｒｉｘ　Ａ",), ("１．ﬁeld²",), ("Matrix A",), (None,)], "t string")
    assert [r["k"] for r in df.select(keys.comparison_key(F.col("t")).alias("k")).collect()] == ["matrixa", "field2", "matrixa", ""]


def test_lookup_in_capitals_as_its_sql(spark, duck, tmp_path):
    """Letters whose full capitals are several letters (ß as SS) are found again."""
    heads = ["Die Straße ist naß", "ŉ ǰ ΐ ﬁ ᾀ ᾳ", "Größe ß", None, "", "plain words", "𐐨 ß 漢字"]
    rows = [(100 * i, h and f"{h}\nmore", "en", "a", 5) for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(concepts.ORACLES["concept_lookup"]).fetchall())
    assert sorted(tuple(r) for r in concepts.concept_lookup(spark, str(tmp_path)).collect()) == want
    assert [x[1] for x in want] == [0, 100, 200, None, None, 500, 600]


def test_shared_bigrams_dense_and_rare(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(concepts, "WIDTH", 3)
    monkeypatch.setattr(concepts, "TILE", 4)
    for letters in ("ab", "abcdefghij", "".join(map(chr, range(0x1F600, 0x1F640)))):
        a, b = ([{"".join(rng.choice(list(letters), 2)) for _ in range(9)} for _ in range(n)] for n in (11, 6))
        got, n, m = concepts.shared_counts(["".join(x) for x in a], ["".join(x) for x in b])
        assert got.tolist() == [[len(x & y) for y in b] for x in a] and n.tolist() == [len(x) for x in a] and m.tolist() == [len(y) for y in b]
    assert concepts.shared_counts(["abcd"], ["efgh"])[0].tolist() == [[0]]


def test_common_bigrams_are_not_met_pair_by_pair(spark, duck, monkeypatch):
    """However many pairs share their bigrams, a set is shuffled once a block of its base; in small blocks all results are as the SQL's."""
    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(concepts, "BLOCK", 3)
    for name in ("bigram_jaccard_pairs", "merged_clusters", "semantic_gate", "semantic_clusters"):
        assert sorted(map(tuple, concepts.QUERIES[name](spark, small).collect())) == sorted(duck(small).execute(concepts.ORACLES[name]).fetchall())
    rows = [("k", i, "abcdefgh" * 3 + chr(0x4E00 + i)) for i in range(200)]
    pairs = concepts._compared(spark.createDataFrame(rows, "kb string, id long, key string").coalesce(1), False)
    assert pairs.count() == 200 * 199 // 2
    assert "explode(grams" not in pairs._jdf.queryExecution().toString()


def test_pairs_leave_in_small_batches(monkeypatch):
    """A group whose pairs all reach the limit holds a tile of them, not all."""
    monkeypatch.setattr(concepts, "ROWS", 100)
    monkeypatch.setattr(concepts, "TILE", 7)
    rows = pa.table({"kb": ["k"] * 60, "id": range(60), "grams": ["abcd"] * 60, "n": [2] * 60, "_i": [0] * 60, "_j": [0] * 60, "_side": [0] * 60})
    sizes = [x.num_rows for x in concepts._pairs_of(False, None)(iter(rows.to_batches()))]
    assert sum(sizes) == 60 * 59 // 2 and max(sizes) <= 100


def test_pairs_are_dealt_by_work_and_size(spark, monkeypatch):
    """Few bytes make many tasks where pairs are many; sets of sizes too far apart do not meet; no pair at the limit is lost."""
    monkeypatch.setattr(concepts, "BLOCK", 4)
    monkeypatch.setattr(concepts, "PAIRS", 50)
    rng, letters = random.Random(7), [chr(0x4E00 + i) for i in range(90)]
    words = ["".join(letters[:n]) for n in range(5, 90, 2)] + ["".join(rng.sample(letters[:30], rng.randint(4, 20))) for _ in range(20)]
    df = spark.createDataFrame([("k", i, w) for i, w in enumerate(words)] + [("j", 500 + i, w) for i, w in enumerate(words[:3])], "kb string, id long, key string")
    pairs = concepts._compared(df, False)
    assert pairs.rdd.getNumPartitions() > 10
    sets = [{w[i : i + 2] for i in range(len(w) - 1)} for w in words]
    want = {("k", a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= concepts.MIN_JACCARD}
    got = concepts._reaching(pairs).collect()
    assert len(got) == len({tuple(r)[:3] for r in got}) and {(r["kb"], r["b"], r["a"]) for r in got if r["kb"] == "k"} == want
    assert {(r["a"], r["b"]) for r in got if r["kb"] == "j"} == {(500, 501), (501, 502), (500, 502)} - {(500 + b, 500 + a) for a in range(3) for b in range(a) if ("k", a, b) not in want}


def test_similarity_is_the_rounded_quotient(spark):
    """Every quotient of small sets, halves of the last place included (59 / 128), rounds as a decimal does."""
    pairs = spark.range(1, 1300).selectExpr("id AS any").selectExpr("any", "explode(sequence(1L, any)) AS both").filter("any < 700 OR any IN (1024, 1280)")
    both = concepts._reaching(pairs).withColumn("want", F.round(F.col("both") / F.col("any"), 6))
    assert both.filter("similarity <> want").isEmpty() and not both.filter("both = 59 AND any = 128 AND similarity = 0.460938").isEmpty()
    assert both.count() == pairs.filter(F.round(F.col("both") / F.col("any"), 6) >= concepts.MIN_JACCARD).count()
    assert "round(" not in both.drop("want")._jdf.queryExecution().optimizedPlan().toString()
