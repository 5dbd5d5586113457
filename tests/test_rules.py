"""Golden cases of the learner's rules: levels, labels, profiles, recommendations, citation marks."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import learner, recommend, retrieval
from corpusloom.streaming import streams


def test_labels(spark):
    rows = [(0.0, 0), (0.0, 1), (0.29, 3), (0.3, 3), (0.69, 0), (0.7, 2), (0.75, 2), (0.79, 0), (0.8, 0), (1.0, 9)]
    df = spark.createDataFrame(rows, "m double, n int").select("m", "n", learner.priority(F.col("m"), F.col("n")).alias("p"), learner.action(F.col("m"), F.col("n")).alias("a"))
    want = ["high", "high", "high", "medium", "medium", "low", "low", "low", "completed", "completed"], ["quiz", "study", "study", "quiz", "quiz", "quiz", "quiz", "quiz", "review", "review"]
    got = [(r["p"], r["a"]) for r in df.collect()]
    assert got == list(zip(*want, strict=True))


def test_profile_steps(spark):
    """Recent accuracy and frustration are not rounded; theta is, and moves by the quiz's weight within a quarter."""
    tries = [(0.2, "hard"), (1.0, "easy"), (0.45, "medium"), (0.9, " HARD "), (0.123456, None), (1.0, "hard"), (1.0, "hard"), (1.0, "adaptive")]
    recent, fr, theta, low = 0.5, 0.0, 0.0, 0
    for i, (x, label) in enumerate(tries):
        w = {"easy": 0.8, "hard": 1.2}.get((label or "medium").strip().lower(), 1.0)
        recent = x if i == 0 else 0.7 * recent + 0.3 * x
        low = low + 1 if x < 0.3 else max(0, low - 1) if x < 0.5 else 0
        fr = min(1.0, fr + 0.15) if x < 0.3 else min(1.0, fr + 0.05) if x < 0.5 else max(0.0, fr - 0.05)
        theta = round(max(-2.0, min(2.0, theta + max(-0.25, min(0.25, (x - 0.6) * w - 0.15 * fr)))), 4)
    df = spark.createDataFrame([(i, x, label) for i, (x, label) in enumerate(tries)], "i int, x double, label string").withColumn("w", learner.difficulty_weight(F.col("label")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.5).alias("recent"), F.lit(0).alias("low"), F.lit(0.0).alias("frustration"), F.lit(0.0).alias("theta"), F.lit(1).alias("ability"))
    p = df.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("i", "x", "w"))), start, lambda acc, e: learner.profile_step(acc, e["x"], e["w"])).alias("p")).first()["p"]
    assert (p["n"], p["low"]) == (len(tries), low)
    assert (p["recent"], p["frustration"]) == pytest.approx((recent, fr), abs=1e-12) and p["theta"] == pytest.approx(theta, abs=1e-4)


def plain(s: dict) -> dict:
    """The rules of a recommendation, one after another."""
    if not s["has_summary"] or not s["has_keypoints"]:
        status = "blocked"
    elif s["attempts"] == 0:
        status = "ready_for_practice"
    elif s["avg_score"] < 0.65 or s["weak"]:
        status = "needs_practice"
    elif s["attempts"] >= 2 and s["avg_score"] >= 0.82 and s["stable"] >= 0.7:
        status = "ready_for_challenge"
    else:
        status = "on_track"
    u = 35 * (not s["has_summary"]) + 30 * (not s["has_keypoints"]) + min(15, 4 * len(s["weak"])) + 5 * (s["asked"] == 0 and s["has_keypoints"])
    u += 20 if s["attempts"] == 0 else max(0.0, 0.65 - s["avg_score"]) * 40
    u = min(u, 30) if status == "ready_for_challenge" else u
    done = 100 * (0.14 * s["has_summary"] + 0.14 * s["has_keypoints"] + 0.08 * min(1, s["attempts"] / 2) + 0.04 * min(1, s["asked"] / 2) + 0.6 * s["mastered"])
    acts = []
    if not s["has_summary"]:
        acts.append((100, "summary"))
    if not s["has_keypoints"]:
        acts.append((95, "keypoints"))
    else:
        if s["focus"]:
            acts.append((85, "review"))
        if s["attempts"] == 0:
            acts.append((86, "quiz"))
        elif s["avg_score"] < 0.65:
            acts.append((88, "quiz"))
        if s["asked"] == 0 and status != "ready_for_challenge":
            acts.append((65, "qa"))
        elif s["focus"] and s["avg_score"] < 0.75:
            acts.append((72, "qa"))
        if s["attempts"] >= 2 and s["avg_score"] >= 0.82 and s["stable"] >= 0.7:
            acts.append((55, "challenge"))
    return {"status": status, "urgency": max(5, min(100, u)), "completion": min(100, done), "actions": [a for _, a in sorted(acts or [(50, "review")], reverse=True)]}


def test_recommendations_by_rules(spark):
    names = ["has_summary", "has_keypoints", "attempts", "avg_score", "asked", "stable", "weak"]
    cases = [dict(zip(names, x, strict=True)) for x in itertools.product([True, False], [True, False], [0, 1, 2], [0.3, 0.64, 0.7, 0.82, 0.9], [0, 3], [0.5, 0.7], [[], ["a"], ["a", "b", "c", "d", "e"]])]
    cases = [c | {"mastered": 0.55, "focus": c["weak"][:3], "i": i} for i, c in enumerate(cases)]
    schema = "has_summary boolean, has_keypoints boolean, attempts int, avg_score double, asked int, stable double, weak array<string>, mastered double, focus array<string>, i int"
    df = spark.createDataFrame([tuple(c[k.split()[0]] for k in schema.split(", ")) for c in cases], schema).withColumn("status", recommend.status())
    got = {r["i"]: r for r in df.select("i", "status", recommend.urgency().alias("urgency"), recommend.completion().alias("completion"), recommend.actions().alias("actions")).collect()}
    for c in cases:
        want, r = plain(c), got[c["i"]]
        assert r["status"] == want["status"] and [a["type"] for a in r["actions"]] == want["actions"], (c, r)
        assert r["urgency"] == pytest.approx(want["urgency"], abs=0.051) and r["completion"] == pytest.approx(want["completion"], abs=0.051)
    easy = next(a for c in cases if c["avg_score"] == 0.3 and c["attempts"] == 1 and c["has_keypoints"] for a in got[c["i"]]["actions"] if a["type"] == "quiz")
    assert easy["difficulty"] == "easy"


def test_marks(spark):
    rows = [("See [1][23] and [1234].", "See and [1234]."), ("p.3c.1 and P.12 C.7, p. 3 c.1 xp.3 c.1", " and, p. 3 c.1 xp.3 c.1"), ("a\n\n\n\nb [2] .", "a\n\nb."), (None, None)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string, w string").select(retrieval.without_markers(F.col("t")).alias("x")).collect()]
    assert got == [w for _, w in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 30])
def test_marks_across_pieces(size):
    text = "Water [1] boils [23], see p.19 c.177 and P.3C.4; not [1234] or p. 9 c.1. [5" + "x" * 40 + "[7]" + " p.1 c.2"
    want = text
    for mark in ("[1]", "[23]", "p.19 c.177", "P.3C.4", "[7]", "p.1 c.2"):
        want = want.replace(mark, "", 1)
    assert "".join(streams.without_markers(text[i : i + size] for i in range(0, len(text), size))) == want
