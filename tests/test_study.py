"""Texts to concepts, against looking at every pair; guarded study steps."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import study


@pytest.mark.parametrize("seed", range(3))
def test_containing(spark, seed):
    """Short and empty needles, a piece that a third of all points share, scopes kept apart."""
    rng = random.Random(seed)
    points = [(rng.choice("xxy"), i, "".join(rng.choices("abc", k=rng.randint(0, 9))) + ("the" if rng.random() < 0.4 else "")) for i in range(80)]
    asked = [(i, rng.choice("xy"), rng.choice(["", "a", "th", "the", "bthe", "".join(rng.choices("abc", k=rng.randint(1, 6)))])) for i in range(60)]
    got = {tuple(r) for r in study.containing(spark.createDataFrame(asked, "id long, scope string, needle string"), spark.createDataFrame(points, "scope string, point long, text string")).collect()}
    assert got == {(i, p) for i, s, n in asked for t, p, text in points if s == t and n and n in text}


def test_by_text(spark):
    points = spark.createDataFrame([("k", 5, "Heat flow"), ("k", 7, "Heat"), ("k", 2, "the heat-flow law"), ("j", 1, "Heat")], "scope string, point long, text string")
    asked = [(1, "k", " Heat "), (2, "k", "HEAT!"), (3, "k", "heat flow"), (4, "k", "heatflow"), (5, "k", "cold"), (6, "j", "heat"), (7, "k", None), (8, "k", "?!")]
    got = {r["id"]: (r["point"], r["way"]) for r in study.by_text(spark.createDataFrame(asked, "id long, scope string, focus string"), points).collect()}
    assert got == {1: (7, "exact"), 2: (2, "contains"), 3: (5, "contains"), 4: (2, "contains"), 6: (1, "contains")}


def test_studied(spark):
    make = spark.createDataFrame
    out = study.studied(make([(1,), (2,), (2,), (3,), (4,)], "point long"), make([(1, 0.0), (2, 0.5), (3, 0.9), (4, 0.2), (9, 0.1)], "point long, mastery double"), make([(1,), (3,), (9,)], "point long"), make([(4, 9)], "point long, representative long"))
    assert sorted(map(tuple, out.collect())) == [(1, 0.0, 0.1, False), (2, 0.5, 0.5, True), (3, 0.9, 0.9, False), (9, 0.1, 0.19, False)]


def test_by_vector(spark):
    points = spark.createDataFrame([("k", i, [float(i) / 4, 0.0]) for i in range(8)], "scope string, id long, vector array<float>")
    asked = spark.createDataFrame([("k", 100, [0.0, 0.0]), ("k", 101, [9.0, 0.0])], "scope string, id long, target array<float>")
    assert sorted(map(tuple, study.by_vector(asked, points).collect())) == [(100, 0, 1), (100, 1, 2), (100, 2, 3)]


def test_containing_long_needles_moves_marks_not_texts(spark):
    """Needles of every length up to the whole text, and texts much longer than what is shuffled of them."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd", k=n)) for n in (3, 8, 12, 40, 400)] * 3 + ["漢字😀" * 9]
    points = [("x", i, t) for i, t in enumerate(texts)]
    asked = [(i, "x", (t := rng.choice(texts))[(a := rng.randrange(len(t))) : a + rng.randint(1, 30)]) for i in range(80)]
    found = study.containing(spark.createDataFrame(asked, "id long, scope string, needle string"), spark.createDataFrame(points, "scope string, point long, text string"))
    assert {tuple(r) for r in found.collect()} == {(i, p) for i, _, n in asked for _, p, text in points if n in text}
    assert len(study.marks("abcd" * 5000, 4)) <= 4 and len(study.marks("".join(rng.choices("abcd", k=4000)), 4)) < 1800
