"""Nested documents: what is read, merged, pruned, coerced."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import nested


def column(spark, values, make, kind="string"):
    """make over values, as a list in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lenient(spark):
    cases = [
        ('{"a": 1}', {"a": 1}),
        ('say [1, 2] and {"a": 1}', [1, 2]),  # an array goes before an object
        ('say {"a": [1]} end', [1]),
        ("so {'a': None, 'b': (1, 2), 'c': True}", {"a": None, "b": [1, 2], "c": True}),
        ("[1, 2", None),
        ("no block", None),
        ("{'a': open('x')}", None),
        ("", None),
        (None, None),
        ("7", 7),
        ("x\n{\n'k': 'ü'\n}\ny", {"k": "ü"}),
    ]
    got = column(spark, [c for c, _ in cases], nested.lenient)
    assert [None if g is None else json.loads(g) for g in got] == [w for _, w in cases]


@pytest.mark.parametrize(
    ("base", "patch", "deep", "flat"),
    [
        ('{"a": {"b": 1, "c": {"d": 2}}, "e": 3}', '{"a": {"c": {"f": 4}}, "e": null}', {"a": {"b": 1, "c": {"d": 2, "f": 4}}, "e": None}, {"a": {"c": {"f": 4}}}),
        ('{"a": {"b": 1}}', '{"a": 5}', {"a": 5}, {"a": 5}),
        ('{"a": 5}', '{"a": {"b": 1}}', {"a": {"b": 1}}, {"a": {"b": 1}}),
        (None, '{"a": 1}', {"a": 1}, {"a": 1}),
        ('{"a": null}', "[1]", {"a": None}, {"a": None}),
        ("broken", None, {}, {}),
    ],
)
def test_merges(spark, base, patch, deep, flat):
    r = spark.createDataFrame([(base, patch)], "a string, b string").select(nested.deep_merge(F.col("a"), F.col("b")).alias("d"), nested.override_merge(F.col("a"), F.col("b")).alias("f")).first()
    assert (json.loads(r["d"]), json.loads(r["f"])) == (deep, flat)


def test_prune_and_forbidden(spark):
    got = column(spark, ['{"a": {"b": {}, "c": {"d": {}}}, "e": {}, "f": [], "g": {"h": 0}}', "{}", None], nested.prune_empty)
    assert [None if g is None else json.loads(g) for g in got] == [{"f": [], "g": {"h": 0}}, {}, None]
    got = column(spark, ['{"qa": {"top_k": 3, "x": {"y": 1}}, "z": 1, "quiz": {}}', "[]", None], lambda x: nested.allowed(x, nested.SETTINGS))
    assert json.loads(got[0]) == {"qa": {"top_k": 3}, "quiz": {}} and got[2] is None


def test_coerced(spark):
    values = ["true", '"Yes"', '"OFF "', '"maybe"', "0", "3", '"12"', '"x"', "2.75", "null", '" -4 "', "[1]"]
    read = lambda kind: column(spark, values, lambda x: nested.coerced(F.try_parse_json(x), kind))
    assert read("boolean") == [True, True, False, None, False, True, None, None, None, None, None, None]
    assert read("bigint") == [None, None, None, None, 0, 3, 12, None, 2, None, -4, None]
    assert read("double")[4:9] == [0.0, 3.0, 12.0, None, 2.75]
    assert read("string")[:2] == ["true", "Yes"] and read("string")[9] is None


def test_sources(spark):
    texts = [
        '[{"source": "s", "snippet": "t", "page": 3, "chunk": "4", "doc_id": "d", "more": 1}, {}, {"page": 1.5}, {"source": 1}, {"doc_id": 5}, [1], null]',
        "[]", "{}", "[1, 2]", "broken", None, '[{"source": null}]',
    ]
    got = column(spark, texts, nested.parsed_sources)
    assert [tuple(s) for s in got[0]] == [("s", "t", "d", None, 3, 4), ("", "", None, None, None, None)]
    assert got[1:] == [None] * 6


def test_pruned_items(spark):
    rows = [(1, '[{"image": 1, "q": 2}, 3, {"q": 1}]'), (2, '{"questions": [{"image": null}], "n": 1}'), (3, '{"image": 1}'), (4, "x"), (5, None), (6, "[]")]
    got = {r["i"]: (r["pruned"] and json.loads(r["pruned"]), r["removed"]) for r in nested.pruned_items(spark.createDataFrame(rows, "i int, raw string"), "raw", ["image"]).collect()}
    assert got == {1: ([{"q": 2}, 3, {"q": 1}], 1), 2: ({"questions": [{}], "n": 1}, 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
