"""Fuzzy lines against all pairs compared by brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import lines
from corpusloom.llm.common import Words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(0, 4), max_size=80))
def test_edit_distance(a, b):
    assert lines.edit_distance(a, b) == plain_distance(a, b)


def brute_force(rows: list[tuple]) -> dict:
    """doc -> text left: all pairs of lines compared by their words' edit similarity alone, closed over, first occurrence stays."""
    found = []  # (doc, line, norm words)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if words := lines.normalised(x).split():
                found.append((d, i, tuple(words)))
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, (_, _, w) in enumerate(found):
        if w in by:
            root[find(i)] = find(by[w])
        by.setdefault(w, i)
    some = sorted(by.values(), key=lambda i: len(found[i][2]))
    bags = {i: Counter(found[i][2]) for i in some}
    for x, i in enumerate(some):
        for j in some[x + 1 :]:
            a, b = found[i][2], found[j][2]
            if len(a) < lines.SIMILARITY * len(b):
                break
            if (bags[i] & bags[j]).total() >= lines.SIMILARITY * len(b) and plain_distance(a, b) <= (1 - lines.SIMILARITY) * len(b):
                root[find(i)] = find(j)
    first = {}
    for i, (d, n, _) in enumerate(found):
        c = find(i)
        first[c] = min(first.get(c, (2**63, 0)), (d, n))
    gone = defaultdict(set)
    for i, (d, n, _) in enumerate(found):
        if first[find(i)] != (d, n):
            gone[d].add(n)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in rows}


def planted(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{chr(97 + i % 26)}word{i}" for i in range(800)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 9, 14, 30]))] for _ in range(60)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(rng.randrange(8)):
            w = list(rng.choice(pool))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            line = " ".join(w)
            text.append(line.upper() if rng.random() < 0.3 else line + rng.choice(["", ".", "!", " 17"]))
        rows.append((d, "\n".join(text)))
    return rows


def test_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        out = lines.without_copied_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_force(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    import hashlib

    want, given = brute_force(rows), dict(rows)
    assert sum(want[d] != (given[d] or "") for d in want) > 20
    for r in lines.op6_line_dedup(spark, SF_SMALL).collect():
        left = want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        assert r["n_lines_kept"] + r["n_lines_removed"] == len((given[r["doc_id"]] or "").split("\n"))


def test_edges(spark):
    line = "one two three four five six"
    rows = [(2, f"{line}\nother", 1), (1, line.upper() + "!", 2), (3, None, 3), (4, "", 4), (None, line, 5), (5, f"{line}\n{line}", 6), (5, f"{line}\n{line}", 7), (6, "a b\n\n---\na b\n---", 8), (2**53 + 1, "not alike", 11), (7, "w " * 70_000, 9), (8, "w " * 70_000 + "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines int")
    out = lines.without_copied_lines(docs)
    assert out.columns == [*docs.columns, "_lines_removed"]
    got = {r["lines"]: (r["text"], r["_lines_removed"]) for r in out.collect()}
    assert got[2] == (line.upper() + "!", 0) and got[1] == ("other", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[8] == ("a b\n\n---\n---", 1)
    assert got[5] == ("", 1) and got[6] == ("", 2) and got[7] == ("", 2)
    assert got[9][1] == 0 and got[10] == ("", 1)
    assert {r["doc_id"] for r in out.collect()} >= {2**53 + 1, None}
    assert lines.without_copied_lines(docs.limit(0)).count() == 0


def test_equal_lines_have_equal_hashes_wherever_they_stand():
    line = lines.normalised("one two three four five six")
    w = Words([line + b"\n" + b"pad " * n + b"\n" + line for n in range(50)])
    starts = np.flatnonzero(w.hash == w.hash[0])
    found = lines.segment_hashes(w.hash, starts, starts + 6)
    assert len(starts) == 100 and len(set(found.tolist())) == 1


def near_pairs(seed: int, sizes: tuple, each: int) -> list[list[str]]:
    """Lines 2i and 2i + 1 are similar: from one changed word up to all that 0.85 allows, at random places or evenly spread."""
    rng = random.Random(seed)
    vocabulary = [f"{chr(97 + i % 26)}word{i}" for i in range(3000)]
    out = []
    for n in sizes:
        for k in sorted({1, int(0.15 * n + 1e-9)}):
            for _ in range(each if (most := int(0.15 * (n + (n == 6)) + 1e-9)) else 0):
                w = [rng.choice(vocabulary) for _ in range(n)]
                near = list(w)
                if n == 6:
                    near.insert(rng.randrange(7), "more")
                else:
                    for i in rng.sample(range(n), min(k, most)) if rng.random() < 0.5 else range(n // (2 * most), n, -(-n // most)):
                        near[i] = rng.choice(vocabulary)
                assert lines.similar(w, near)
                out += [w, near]
    return out


def test_pairs_at_the_edit_similarity_are_found(spark):
    """Recall against edit similarity alone; pairs within two edits are never missed."""
    pairs = near_pairs(7, (6, 7, 10, 13, 20, 30, 50, 100), 8)
    rows = [(i, " ".join(w)) for i, w in enumerate(pairs)]
    out = lines.without_copied_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r["doc_id"] for r in out if r["_lines_removed"]}
    assert gone <= set(range(1, len(rows), 2)) and len(gone) >= 0.99 * len(rows) / 2


def test_recall_of_first_runs():
    """Of very many pairs, the share that meets on a run: all within two edits, 0.99 of those with as many as 0.85 allows."""
    pairs = near_pairs(8, (7, 13, 20, 30, 50, 100), 400)
    w = Words([" ".join(x) for x in pairs])
    line, key = lines.first_runs(w, w.first[:-1], w.first[1:], lines.Order(np.zeros(0, dtype=np.uint64)))
    of = defaultdict(set)
    for x, k in zip(line.tolist(), key.tolist(), strict=True):
        of[x].add(k)
    few = [lines.edit_distance(pairs[i], pairs[i + 1]) <= 2 for i in range(0, len(pairs), 2)]
    met = [bool(of[i] & of[i + 1]) for i in range(0, len(pairs), 2)]
    assert all(m for m, f in zip(met, few, strict=True) if f)
    assert sum(m for m, f in zip(met, few, strict=True) if not f) >= 0.99 * few.count(False)


def test_why_no_simhash():
    """What blocks of a 64-bit SimHash would find: majority bits of word hashes, pairs within 4 bits."""
    pairs = near_pairs(9, (10, 20, 50), 200)
    w = Words([" ".join(x) for x in pairs])
    bits = (w.hash[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    n = np.diff(w.first)
    sim = np.add.reduceat(bits, w.first[:-1], axis=0) * np.uint64(2) > n[:, None]
    near = (sim[::2] != sim[1::2]).sum(axis=1) <= 4
    assert near.mean() < 0.5  # see the README


def test_no_similar_pair_is_ruled_out(monkeypatch):
    """Few words, so that runs repeat and are frequent: each similar pair shares a first run and passes the bounds."""
    rng = random.Random(3)
    monkeypatch.setattr(lines, "MEET", None)
    for trial in range(300):
        a = [f"w{rng.randrange(rng.choice([2, 5, 50]))}" for _ in range(rng.randrange(6, 60))]
        b = list(a)
        for _ in range(rng.randrange(1, 9)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = [f"w{rng.randrange(5)}"] * rng.randrange(2)
        if a == b or not b or not lines.similar(a, b):
            continue
        w = Words([" ".join(a), " ".join(b)])
        first, last = w.first[:-1], w.first[1:]
        frequent = np.unique(lines._runs(w, first, last)[1])[::2] if trial % 2 else np.zeros(0, dtype=np.uint64)
        line, key = lines.first_runs(w, first, last, lines.Order(frequent))
        assert set(key[line == 0].tolist()) & set(key[line == 1].tolist())
        p = lines.parities(w.hash, first, last, 2)
        assert lines.possible(np.array([len(a)]), p[:1], np.array([len(b)]), p[1:])[0]


def test_no_similar_pair_of_long_lines_is_missed():
    """As the operator is called: all pairs with as many edits as the similarity allows meet, not most of them."""
    missed = 0
    for seed in range(4):
        w = Words([" ".join(x) for x in near_pairs(seed, (30, 60, 100), 250)])
        line, key = lines.first_runs(w, w.first[:-1], w.first[1:], lines.Order(np.zeros(0, dtype=np.uint64)))
        own = [set() for _ in range(len(w.first) - 1)]
        for i, k in zip(line.tolist(), key.tolist(), strict=True):
            own[i].add(k)
        missed += sum(not a & b for a, b in zip(own[::2], own[1::2], strict=True))
    assert missed == 0


def test_work_is_linear_in_the_lines(spark):
    """Runs of one line alone end at the first step; of lines that are all alike few pairs are verified; only pairs that met are."""
    rng = random.Random(11)
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike
    words = [f"word{i}".translate(letters) for i in range(5000)]
    alone = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(20)]
    alike = [" ".join([*base[:i], f"x{i}y{j}z".translate(letters), *base[i + 1 :]]) for i in range(20) for j in range(10)]
    docs = spark.createDataFrame(list(enumerate([*alone, *alike])), "doc_id long, text string")
    runs = lines.run_table(docs, 2).collect()
    n = sum(len(r["two"]) // 8 for r in runs)
    assert n > 300 * 9 and sum(len(r["one"]) + len(r["two"]) for r in runs) == 14 * n
    shared = lines.shared_runs(lines.run_table(docs, 2), 2)
    met = {x for r in shared.collect() for x in np.frombuffer(r["one"], dtype=np.int64).tolist()}
    assert len(met) == len(alike)
    own = lines.line_table(docs, 2).filter("part is not null").selectExpr("part", f"{lines._LINES} as kind", "one", "two")
    pairs = [(r["a"], r["b"]) for r in lines.near_lines(lines.met_lines(own.unionByName(shared), 2)).collect()]
    assert {x for p in pairs for x in p} == met and len(pairs) < 4 * len(alike)
    gone = {r["doc_id"] for r in lines.without_copied_lines(docs).collect() if r["_lines_removed"]}
    assert gone == set(range(301, 500))


def test_lines_of_few_words_are_told_apart():
    """Lines of eight words, each repeated many times: their sketches rule them out, but not those a few edits away."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    runs = [[w for w in ["the", *rng.sample(words, 7)] for _ in range(rng.randrange(24, 28))] for _ in range(40)]
    w = Words([" ".join(x) for x in runs])
    n, p = np.diff(w.first), lines.parities(w.hash, w.first[:-1], w.first[1:], 4)
    i, j = np.triu_indices(len(runs), 1)
    assert not lines.possible(n[i], p[i], n[j], p[j]).any()
    near = [x[:-9] if k % 2 else [*x[:100], *["odd"] * 20, *x[120:]] for k, x in enumerate(runs)]
    w = Words([" ".join(x) for x in near])
    m, q = np.diff(w.first), lines.parities(w.hash, w.first[:-1], w.first[1:], 4)
    assert lines.possible(n, p, m, q).all()


def test_lines_with_one_long_passage(spark):
    """Heads of many lengths before one passage: few pairs are verified though all share most runs, and classes are those of all pairs."""
    rng = random.Random(8)
    letters = str.maketrans("0123456789", "abcdefghij")
    passage = [f"common{i}".translate(letters) for i in range(60)]
    texts = [" ".join([*(f"own{k}of{i}".translate(letters) for k in range(rng.randrange(4, 22))), *passage]) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(len(texts)))
    split, pairs = [t.split() for t in texts], 0
    for i in range(len(texts)):
        for j in range(i):
            if lines.similar(*(np.array([hash(x) for x in split[k]]) for k in (i, j))):
                pairs += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    found = lines.without_copied_lines(docs).select("doc_id", "_lines_removed").collect()
    assert {r["doc_id"] for r in found if r["_lines_removed"]} == {i for i, r in enumerate(root) if r != i}
    assert pairs > 2 * len(texts) and 1 < len(set(root)) < len(texts)
