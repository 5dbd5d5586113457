"""Fingerprints: the contract's edited texts, equal texts, likeness that falls with edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from corpusloom.llm import fingerprint
from corpusloom.llm.common import clean_text
from corpusloom.llm.lines import edit_distance, similar


def expected(rows: list[tuple[int | None, str]]) -> list[tuple]:
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = fingerprint.op1_fingerprints(spark, SF_SMALL).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected(rows))
    text = dict(rows)
    prints: dict[str, str] = {}
    for r in got:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    for i, (d, _) in enumerate(rows):
        r = next(x for x in got if x["doc_id"] == d)
        assert abs(r["near_next"] - fingerprint.likeness(by[d], by[rows[(i + 1) % len(rows)][0]])) < 1e-12


def test_edited_print_is_that_of_the_edited_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg hij klm") for _ in range(n)) for n in (0, 1, 2, 3, 50, 777, 20_000)]
    after = texts[1:] + texts[:1]
    own, edited, prints = fingerprint.fingerprints(texts, after)
    assert prints == fingerprint.fingerprints(edited)[0]


def test_likeness_follows_edits():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    base = [rng.choice(words) for _ in range(600)]
    found = []
    for edits in (0, 5, 40):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        found.append(" ".join(w))
    other = " ".join(rng.choice(words) for _ in range(600))
    p = fingerprint.fingerprints([*found, other])[0]
    same, near, mid, far = (fingerprint.likeness(p[0], x) for x in p)
    assert same == 1.0 and near > 0.85 and near > mid > far and far < 0.2


def test_edges(spark):
    rows = [(2**53 + 1, "abe"), (None, "other tail"), (None, "third"), (3, "abc"), (3, "abd"), (None, "tail"), (5, None), (9, ""), (8, "long " * 30_000), (3, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprint.with_edited(docs.select("doc_id", clean_text(docs).alias("text"))).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = fingerprint.with_edited(one).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    assert fingerprint.with_edited(one.limit(0)).count() == 0
    extra = docs.withColumn("fingerprint2", F.lit(1))
    assert fingerprint.fingerprint(extra).count() == len(rows)


def plain_classes(texts: list[str]) -> tuple[list[int], list[int]]:
    """(class, links) of each text: all pairs compared by their edit distance alone."""
    codes = [np.array([ord(c) for c in t]) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            n = max(len(codes[i]), len(codes[j]))
            if abs(len(codes[i]) - len(codes[j])) <= fingerprint.EDITS * n and similar(codes[i], codes[j], 1 - fingerprint.EDITS):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, links


def copies_with_edits(rng: random.Random, groups: int) -> list[str]:
    """Texts in groups of one to ten, which differ in 0.2 to 5 % of their characters."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choice(words) for _ in range(rng.choice([30, 80, 200, 400])))
        texts.append(base)
        for _ in range(rng.choice([0, 1, 2, 9])):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0.002, 0.01, 0.03, 0.05])) + 1):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice("xyz ") * rng.randrange(2)
            texts.append("".join(t))
    return list(dict.fromkeys(texts))


def test_near_documents(spark, monkeypatch):
    """Near copies with few to many edits, against all pairs by edit distance; groups larger than a block; recall 0.95."""
    monkeypatch.setattr(fingerprint, "BLOCK_TEXTS", 4)
    texts = copies_with_edits(random.Random(12), 40)
    root, links = plain_classes(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])] + [(None, None), (2**53 + 1, ""), (5000, None)]
    got = {(r["doc_id"]): r for r in fingerprint.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {d for d, _ in rows} and got[None]["class_id"] == got[2**53 + 1]["class_id"] == 5000
    for i in range(20):
        assert (got[1000 + i]["class_id"], got[1000 + i]["n_links"]) == (got[i]["class_id"], got[i]["n_links"])
    found, all_links = sum(got[i]["n_links"] for i in range(len(texts))), sum(links)
    assert all(got[i]["n_links"] <= links[i] for i in range(len(texts))) and all_links > 200
    assert found >= 0.95 * all_links
    for i in range(len(texts)):
        assert root[got[i]["class_id"]] == root[i]  # never across true classes
    assert fingerprint.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_of_the_query(spark, monkeypatch):
    """class_id against all pairs by edit distance: never across true classes, few pairs lost; copies, nulls, long texts, clashing names."""
    monkeypatch.setattr(fingerprint, "BLOCK_TEXTS", 3)
    rng = random.Random(7)
    texts = copies_with_edits(rng, 30)
    root, links = plain_classes(texts)
    long = " ".join(rng.choice(["up", "down", "left", "right", "straight", "back"]) + str(rng.randrange(1000)) for _ in range(40_000))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])]
    rows += [(None, None), (2**53 + 1, ""), (5000, None), (None, "alone"), (6000, long), (6001, long[:100_000] + "x" + long[100_001:]), (3, texts[3])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, class_id int, text_hash int")
    out = fingerprint.with_classes(docs.select("doc_id", clean_text(docs).alias("text"))).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)
    got = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert {r["class_id"] for r in out if r["doc_id"] is None} == {5000, None} and got[2**53 + 1] == got[5000] == 5000
    assert got[6000] == got[6001] == 6000
    assert all(got[1000 + i] == got[i] for i in range(20))
    together = [(i, j) for i in range(len(texts)) for j in range(i) if root[i] == root[j]]
    assert all(root[got[i]] == root[i] for i in range(len(texts))) and len(together) > 150
    assert sum(got[i] == got[j] for i, j in together) >= 0.9 * len(together)
    assert fingerprint.with_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_band_is_linear(spark):
    """Texts that all share a long head: each meets few others, and no pair that is not near is in a class."""
    rng = random.Random(4)
    tail = lambda: " ".join("".join(rng.choice("qwertyuiop") for _ in range(6)) for _ in range(120))
    head = tail() + " " + tail()
    texts = [head + tail() for _ in range(300)]
    prints = spark.createDataFrame([(i, p) for i, p in enumerate(fingerprint.fingerprints(texts)[0])], "id long, fingerprint string")
    pairs = fingerprint.met_pairs(prints).collect()
    assert 300 < len(pairs) <= 300 * fingerprint.NEIGHBOURS * 4 * fingerprint.BANDS
    assert fingerprint.near_classes(prints, spark.createDataFrame(list(enumerate(texts)), "id long, text string")).count() == 0


@pytest.mark.parametrize("short", [0, fingerprint.SHORT])
def test_within_is_the_edit_distance(monkeypatch, short):
    monkeypatch.setattr(fingerprint, "SHORT", short)
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.choice("abc") for _ in range(rng.randrange(40))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice("abc") * rng.randrange(2)
        most = rng.randrange(8)
        assert fingerprint.within(fingerprint.text_codes("".join(a)), fingerprint.text_codes("".join(b)), most) == (edit_distance(a, b) <= most)


def test_walk_character_by_character():
    """The walk emits a character at each step and moves on where the step's bit of its class is one; here step by step."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc déf") for _ in range(n)) for n in (0, 1, 7, 60, 61, 300)]
    codes, begin = fingerprint._codes(texts)
    classes, size = fingerprint._classes(codes), np.array([len(t) for t in texts])
    for w in range(fingerprint.WALKS):
        bits = np.random.default_rng(9001 + w).integers(0, 2, (64, 4096), dtype=np.uint8)
        bits[:, -1] = 1
        left = fingerprint.walk(classes, begin, size, np.zeros(len(texts), dtype=np.int64), w)
        for b, n in zip(begin.tolist(), size.tolist(), strict=True):
            step, gone = 0, []
            for c in classes[b : b + n].tolist():
                while not bits[c, step % 4096]:
                    step += 1
                step += 1
                gone.append(step)
            assert left[b : b + n].tolist() == gone


def test_partners_beyond_the_nearest_neighbours_are_compared(spark):
    """Many texts lie between two near copies in every table of bands: the pair is found all the same, and no pair inside a class."""
    rng = np.random.default_rng(5)
    one = "1." + "".join(rng.choice(list("0123456789abcdef"), 120))
    rows = [(i, f"{one}-{one}") for i in range(40)]
    texts = ["".join(rng.choice(list("abcdefghij"), 400)) for _ in rows]
    texts[39] = "x" + texts[0][1:]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = fingerprint.near_classes(spark.createDataFrame(rows, "id long, fingerprint string"), docs).collect()
    assert {(r["id"], r["component"]) for r in found} == {(0, 0), (39, 0)}
    classed = spark.createDataFrame([(i, f, i // 10) for i, f in rows], "id long, fingerprint string, class long")
    pairs = {(r["a"], r["b"]) for r in fingerprint.pairs_apart(classed).collect()}
    assert pairs == {(a, b) for b in range(40) for a in range(b) if a // 10 != b // 10}


def test_bands_of_many_are_those_of_each():
    prints = fingerprint.fingerprints(["", "a", "ab", "abc" * 50, "some words " * 400, "x" * 333])[0]
    of, *rest = fingerprint.bands_of(prints)
    got = sorted(zip(of.tolist(), *(x.tolist() for x in rest), strict=True))
    assert got == sorted((i, *x) for i, p in enumerate(prints) for x in zip(*fingerprint.bands(p).tolist(), strict=True))


def test_aligned_is_never_less_than_the_distance():
    rng = random.Random(17)
    for _ in range(150):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 400)))
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(3)] = rng.choice(["", "x", "yz", "".join(b[:20])])
        x, y = fingerprint.text_codes(a), fingerprint.text_codes("".join(b))
        bound, least = fingerprint.aligned(x, y), fingerprint.edit_distance(x.tolist(), y.tolist())
        assert bound >= least
    for _ in range(5):  # edits that lie apart are counted one by one, or nearly so
        a = "".join(rng.choice("abcdefgh ") for _ in range(2000))
        b = list(a)
        for i in range(50, 2000, 100):
            b[i] = rng.choice(["", "x", "yz"])
        assert 20 <= fingerprint.aligned(fingerprint.text_codes(a), fingerprint.text_codes("".join(b))) <= 40


def test_texts_of_far_lengths_are_no_pairs(spark):
    """Texts that agree on a whole band: those whose lengths differ by more than near copies' may are not compared."""
    print_of = fingerprint.fingerprints(["some words " * 40])[0][0]
    rows = [(1, print_of, 1000, 1), (2, print_of, 1111, 2), (3, print_of, 1112, 3), (4, print_of, 1235, 3)]
    prints = spark.createDataFrame(rows, "id long, fingerprint string, n_chars long, class long")
    assert {(r["a"], r["b"]) for r in fingerprint.pairs_apart(prints).collect()} == {(1, 2), (2, 3)}


def test_classes_joined_by_new_links(spark):
    classes = spark.createDataFrame([(1, 1), (5, 1), (3, 3), (7, 3), (2, 2), (9, 2)], "id long, component long")
    links = spark.createDataFrame([(5, 7), (0, 9), (10, 11)], "a long, b long")
    found = sorted((r["id"], r["component"]) for r in fingerprint._joined(classes, links).collect())
    assert found == [(0, 0), (1, 1), (2, 0), (3, 1), (5, 1), (7, 1), (9, 0), (10, 10), (11, 10)]
