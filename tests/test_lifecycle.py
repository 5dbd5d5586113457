"""Change sets over all tables, against plain rules; names, refusals, versions."""

from __future__ import annotations

import pytest

from corpusloom.operators import lifecycle as lc


@pytest.fixture()
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "bases": make([(1, "u", "one"), (2, "u", "two"), (3, "v", "one")], "kb long, user_id string, name string"),
        "documents": make([(10, 1, "a"), (11, 1, "b"), (12, 2, "c"), (13, None, "d")], "doc_id long, kb long, name string"),
        "quizzes": make([(100, 10, 1), (101, 12, 2), (102, 99, 1)], "quiz_id long, doc_id long, kb long"),
        "attempts": make([(100, 1), (100, 2), (101, 1), (102, 1), (777, 1)], "quiz_id long, number int"),
        "keypoints": make([(1, 10, 1), (2, 11, 1)], "point long, doc_id long, kb long"),
        "vectors": make([(1, 12, 2)], "vec_id long, doc_id long, kb long"),
        "sessions": make([(5, 10, 1), (6, None, 1), (7, 12, 2)], "session_id long, doc_id long, kb long"),
        "messages": make([(5, 0), (6, 0), (7, 0)], "session_id long, turn int"),
        "edges": make([(1, 10, 11), (2, 12, 12)], "kb long, from_id long, to_id long"),
    }


def ids(df, column):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


def test_documents_removed(spark, tables):
    out = lc.documents_removed(tables, spark.createDataFrame([(10,), (10,), (55,)], "doc_id long"))
    assert ids(out["documents"], "doc_id") == [11, 12, 13] and ids(out["quizzes"], "quiz_id") == [101, 102]
    assert sorted(map(tuple, out["attempts"].collect())) == [(101, 1), (102, 1)]
    assert ids(out["keypoints"], "point") == [2] and ids(out["sessions"], "session_id") == [6, 7] and ids(out["messages"], "session_id") == [6, 7]
    assert ids(out["edges"], "kb") == [2] and ids(out["bases"], "kb") == [1, 2, 3]


def test_documents_moved(spark, tables):
    out = lc.documents_moved(tables, spark.createDataFrame([(10, 2, None), (11, None, "new")], "doc_id long, kb long, name string"))
    assert sorted(map(tuple, out["documents"].select("doc_id", "kb", "name").collect())) == [(10, 2, "a"), (11, 1, "new"), (12, 2, "c"), (13, None, "d")]
    assert sorted(map(tuple, out["quizzes"].collect())) == [(100, 10, 2), (101, 12, 2), (102, 99, 1)] and out["edges"].isEmpty()
    renamed = lc.documents_moved(tables, spark.createDataFrame([(11, None, "new")], "doc_id long, kb long, name string"))
    assert ids(renamed["edges"], "kb") == [1, 2]


def test_bases_removed(spark, tables):
    asked = spark.createDataFrame([(1,), (3,)], "kb long")
    out, answer = lc.bases_removed(tables, asked, False)
    assert sorted(map(tuple, answer.collect())) == [(1, False), (3, True)] and ids(out["bases"], "kb") == [1, 2] and out["documents"].count() == 4
    out, answer = lc.bases_removed(tables, asked, True)
    assert ids(out["documents"], "doc_id") == [12, 13] and ids(out["quizzes"], "quiz_id") == [101]  # by document, and by base alone
    assert ids(out["sessions"], "session_id") == [7] and ids(out["messages"], "session_id") == [7] and ids(out["edges"], "kb") == [2]


def test_names(spark, tables):
    asked = spark.createDataFrame([("u", " one "), ("u", "three"), ("u", "three"), ("v", "two"), ("v", " ")], "user_id string, name string")
    made = lc.bases_created(tables["bases"], asked)
    assert sorted((r["user_id"], r["name"]) for r in made.collect()) == [("u", "one"), ("u", "three"), ("u", "two"), ("v", "one"), ("v", "two")]
    assert len({r["kb"] for r in made.collect()}) == 5
    got = {r["kb"]: (r["name"], r["refused"]) for r in lc.bases_renamed(tables["bases"], spark.createDataFrame([(1, "two"), (2, "x"), (3, "two")], "kb long, to string")).collect()}
    assert got == {1: ("one", True), 2: ("x", False), 3: ("two", False)}
    got = {r["kb"]: (r["name"], r["refused"]) for r in lc.bases_renamed(tables["bases"], spark.createDataFrame([(1, "x"), (2, "x")], "kb long, to string")).collect()}
    assert got == {1: ("x", False), 2: ("two", True), 3: ("one", False)}


def test_defaults(spark):
    t = {"documents": spark.createDataFrame([(1, None, "u"), (2, 5, "u"), (3, None, "w")], "doc_id long, kb long, user_id string")}
    out = lc.with_default(t, spark.createDataFrame([("u", 9)], "user_id string, default_kb long"))
    assert sorted(((r["doc_id"], r["kb"]) for r in out["documents"].collect())) == [(1, 9), (2, 5), (3, None)]


def test_one_switch(spark, tables, tmp_path):
    """A version without its marker is not seen."""
    path = str(tmp_path / "library")
    assert lc.publish_all(tables, path) == 0
    after = lc.documents_removed(lc.read_all(spark, path), spark.createDataFrame([(12,)], "doc_id long"))
    assert lc.publish_all(after, path) == 1
    assert ids(lc.read_all(spark, path)["documents"], "doc_id") == [10, 11, 13]
    (tmp_path / "library" / "v=1" / "_SUCCESS").unlink()
    assert lc.read_all(spark, path)["documents"].count() == 4
