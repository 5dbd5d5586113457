"""Properties of the concept graph."""

from __future__ import annotations

import random
import re

import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import graph

EDGES = st.lists(st.tuples(st.sampled_from([0.38, 0.46, 0.55]), st.integers(1, 3), st.integers(0, 8), st.integers(0, 8)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(EDGES)
def test_acyclic_with_bounded_degrees_and_order(edges):
    links = graph.acyclic(edges)
    assert len(set(links)) == len(links)
    assert all(sum(x == a for x, _ in links) <= 4 for a in range(9)) and all(sum(y == b for _, y in links) <= 3 for b in range(9))
    for rank in (None, lambda x: -x):
        order = graph.topological(list(range(9)), links, rank)
        assert sorted(order) == list(range(9))
        assert all(order.index(a) < order.index(b) for a, b in links)


@settings(max_examples=100, deadline=None)
@given(EDGES, st.sets(st.integers(0, 8)))
def test_insert_keeps_old_order(edges, old):
    links = graph.acyclic(edges)
    order = graph.topological(list(range(9)), links)
    anchor = [x for x in order if x in old]
    out = graph.bounded_insert(anchor, order, links)
    assert sorted(out) == list(range(9)) and [x for x in out if x in old] == anchor
    assert graph.bounded_insert(out, sorted(out), links) == out


def test_insert_between():
    assert graph.bounded_insert(["o1", "o2", "o3"], ["nx", "o1", "o2", "o3"], [("nx", "o1")]) == ["nx", "o1", "o2", "o3"]
    assert graph.bounded_insert([], ["b", "a"], []) == ["b", "a"]
    assert graph.bounded_insert(["gone", "b", "b"], ["a", "b"], []) == ["a", "b"]


def test_insert_moves_old_items_by_two_at_most():
    """Three new items belong before an old one: two may pass it, the third goes behind it, unless it has to come first."""
    assert graph.bounded_insert(["o"], ["x", "y", "z", "o"], []) == ["x", "y", "o", "z"]
    assert graph.bounded_insert(["o"], ["x", "y", "z", "o"], [("z", "o")]) == ["x", "y", "z", "o"]


def test_saved_order(spark, tmp_path):
    """Anchors are written once, again only when the order changes; new points enter the kept order."""
    path = str(tmp_path / "anchors")
    steps = lambda *places: spark.createDataFrame([(7, p, i) for i, p in enumerate(places)], "doc_id long, place int, step int")
    none = spark.createDataFrame([], "doc_id long, from_place int, to_place int")
    order = lambda df: [r["place"] for r in sorted(df.collect(), key=lambda r: r["shown"])]
    assert order(graph.saved_order(steps(3, 1, 2), none, path)) == [3, 1, 2]
    assert order(graph.saved_order(steps(1, 2, 3), none, path)) == [3, 1, 2]
    assert len(list((tmp_path / "anchors").iterdir())) == 1
    assert order(graph.saved_order(steps(9, 1, 2, 3), none, path)) == [9, 3, 1, 2]
    assert len(list((tmp_path / "anchors").iterdir())) == 2


def test_numbers(spark):
    texts = ["3. x", "第12章 y", "二十三、z", "一百零五、q", "十、a", "none", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(graph.order_number(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [3, 12, 23, 105, 10, None, None]


def test_surer_rule_first_then_rank():
    assert graph.acyclic([(0.46, 3, 1, 2), (0.46, 1, 2, 1)]) == [(2, 1)]
    assert graph.acyclic([(0.46, 1, 2, 1), (0.55, 3, 1, 2)]) == [(1, 2)]


def test_modules_by_connected_part():
    assert graph.modules([3, 1, 2], []) == {3: 0, 1: 0, 2: 0}
    assert graph.modules([1, 5, 2, 6], [(1, 2), (5, 6)]) == {1: 0, 2: 0, 5: 1, 6: 1}
    chain = graph.modules(list(range(9)) + [20], [(i, i + 1) for i in range(8)])
    assert [chain[i] for i in range(9)] == [0] * 6 + [1] * 3 and chain[20] == 2


@pytest.mark.parametrize("seed", range(3))
def test_cross_edges_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(kb, doc, place, rng.choice(["1. ", "基础 ", ""]) + " ".join(rng.choices(words, k=3))) for kb in ("x", "y") for doc in rng.sample(range(3 * 4096), 25) for place in range(rng.choice([1, 1, 2, 4, 9]))]
    rows = [(kb, doc + (20000 if kb == "y" else 0), place, text) for kb, doc, place, text in rows]
    want = set()
    for kb in ("x", "y"):
        line = sorted(r for r in rows if r[0] == kb)
        for i, (_, doc, place, text) in enumerate(line):
            for _, doc2, place2, text2 in line[i + 1 : i + 4]:
                shared = set(re.findall("[a-z0-9]+|[一-鿿]", text)) & set(re.findall("[a-z0-9]+|[一-鿿]", text2))
                if doc2 != doc and len(shared) >= 2 and text[0] in "1基":
                    want.add((kb, doc, place, doc2, place2))
    got = graph.cross_edges(spark.createDataFrame(rows, "kb string, doc_id long, place int, text string")).collect()
    assert want and {tuple(r)[:5] for r in got} == want and len(got) == len(want)


def plain_paths(lines: list[str]) -> list[dict]:
    """Items of one document's path by the rules, without Spark."""
    texts = [(i, " ".join(re.sub(r"\s+", " ", x).split(" ")).strip(" ")) for i, x in enumerate(lines)]
    texts = [(i, t) for i, t in texts if t]
    words = lambda t: set(re.findall("[a-z0-9]+|[一-鿿]", t.lower()))
    edges = {}
    for k, (i, left) in enumerate(texts):
        for off in (1, 2):
            if k + off < len(texts):
                j, right = texts[k + off]
                if len(words(left) & words(right)) >= off + 1:
                    edges[i, j] = 0.46 if off == 1 else 0.38
    links = sorted(edges)
    places = [i for i, _ in texts]
    into, outs = {i: [a for a, b in links if b == i] for i in places}, {i: [b for a, b in links if a == i] for i in places}
    need, ready, steps = {i: len(into[i]) for i in places}, [i for i in places if not into[i]], []
    while ready:
        x = ready.pop(0)
        steps.append(x)
        for y in outs[x]:
            need[y] -= 1
            if not need[y]:
                ready.append(y)
    depth: dict[int, int] = {}
    for x in steps:
        depth[x] = max((depth[y] + 1 for y in into[x]), default=0)
    size = {i: len(t) for i, t in texts}
    follow = {i: size[texts[k + 1][0]] if k + 1 < len(texts) else 0 for k, (i, _) in enumerate(texts)}
    out = []
    for step, x in enumerate(steps, 1):
        hard = 0.18 + 0.34 * min(size[x] / 80, 1) + 0.24 * min(len(into[x]) / 3, 1) + 0.14 * min(follow[x] / 120, 1) + 0.1 * min(len(outs[x]) / 4, 1)
        hard = round(max(0.05, min(1.0, hard)), 3)
        mastery = size[x] % 101 / 100
        c = 0.55 * depth[x] / max(1, max(depth.values())) + 0.45 * hard
        k = sum(c >= cut for cut in (0.3, 0.6, 0.82))
        raw = (8, 14, 22, 30)[k] + min(size[x] // 20, 4) + min(follow[x] // 60, 4) + round(6 * hard)
        out.append({"place": x, "step": step, "depth": depth[x], "prerequisites": len(into[x]), "dependents": len(outs[x]), "difficulty": hard, "mastery": mastery, "stage": graph.STAGES[k], "minutes": max(5, round(raw * (1 - min(0.55, 0.45 * mastery)))), "links": links})
    return out


def test_path_items_by_rules(spark):
    """Every document of the smallest tables: steps, depths, difficulty, stages, minutes, and what is rolled up from them."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got, stages, sums = {}, {}, {}
    for r in graph.path_items(spark, SF_SMALL).collect():
        got.setdefault(r["doc_id"], {})[r["place"]] = r
    for r in graph.stage_rollup(spark, SF_SMALL).collect():
        stages[r["doc_id"], r["stage"]] = r
    for r in graph.path_summary(spark, SF_SMALL).collect():
        sums[r["doc_id"]] = r
    checked = 0
    for doc_id, text in docs.items():
        if re.search(r"(?m)^\s*(第|\d+\s*[.、)\-:]|[一二三四五六七八九十百零两]+\s*[、.])|[^\x00-\x7f]", text or ""):
            continue  # numbered lines and other scripts: other tests
        want = plain_paths((text or "").split("\n"))
        assert len(want) == len(got.get(doc_id, {}))
        for w in want:
            r = got[doc_id][w["place"]]
            assert all(r[k] == w[k] for k in ("step", "depth", "prerequisites", "dependents", "stage")), (doc_id, w, r)
            assert abs(r["difficulty"] - w["difficulty"]) < 0.0011 and abs(r["minutes"] - w["minutes"]) <= 1
            checked += 1
        if want:
            done = sum(w["mastery"] >= 0.8 for w in want)
            s = sums[doc_id]
            assert (s["items"], s["completed"]) == (len(want), done) and s["completion"] == pytest.approx(done / len(want), abs=1e-4)
            open_ = [k for k in graph.STAGES if any(w["stage"] == k and w["mastery"] < 0.8 for w in want)]
            assert s["current_stage"] == (open_[0] if open_ else "completed")
            for k in {w["stage"] for w in want}:
                own = [w for w in want if w["stage"] == k]
                assert stages[doc_id, k]["items"] == len(own) and stages[doc_id, k]["milestone"] == own[-1]["place"]
    assert checked > 300
