"""Near-duplicate documents against all pairs compared by brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from conftest import SF_SMALL

from corpusloom.llm import jaccard


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows: list[tuple]) -> list[tuple]:
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    shared = Counter((i, j) for at in owners.values() for n, i in enumerate(at) for j in at[n + 1 :])
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    place = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        c = find(place[t or ""])
        least[c] = min(least.get(c, 2**63), 2**63 - 1 if d is None else d)
    return sorted((d, None if least[find(place[t or ""])] == 2**63 - 1 else least[find(place[t or ""])], links[place[t or ""]]) for d, t in rows)


def planted(seed: int, n: int = 150) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(n):
        base = [word() for _ in range(rng.choice([1, 3, 5, 30, 120, 300]))]
        rows.append((len(rows) + 1, " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 60)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) + 1, " ".join(w)))
    return [*rows, (9001, None), (9002, ""), (9003, "w1 w2"), (9003, "w1 w2")]


def test_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").fillna("", ["text"]))
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_force(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard.op3_chosen_path_join(spark, SF_SMALL).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_force(rows)


def test_large_nodes_and_groups(spark, monkeypatch):
    """One group of many near copies and many exact copies, with nodes and blocks far smaller than the group."""
    monkeypatch.setattr(jaccard, "NODE_TEXTS", 20)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 16)
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(30)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_force(rows)


def test_filter(spark):
    rows = planted(3, 60)
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows] + [(None, "null id", 1, "x"), (None, "null id", 1, "x")], "doc_id long, text string, class_id long, _maybe2 string")
    out = jaccard.without_near_duplicates(docs)
    assert out.columns == docs.columns
    want = {c for _, c, _ in brute_force(rows)}
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1
    assert jaccard.without_near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_close():
    rng = random.Random(2)
    a = [f"w{rng.randrange(5000)}" for _ in range(400)]
    b = list(a)
    for i in range(0, 400, 80):
        b[i] = "changed"
    rows = jaccard.signatures([" ".join(a), " ".join(b)])
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(float(np.mean(rows[0] == rows[1])) - len(sa & sb) / len(sa | sb)) < 0.15


def template_pairs(n: int) -> list[str]:
    """2 * n texts that share a long passage, at a similarity of about 0.5; 2i and 2i + 1 are at 0.8 to 0.82."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**7)}"
    shared = [word() for _ in range(200)]
    texts = []
    for _ in range(n):
        own = [word() for _ in range(100)]
        near = list(own)
        for i in range(28):
            near[i] = word()
        texts += [" ".join(shared + own), " ".join(shared + near)]
    return texts


def test_recall_in_deep_nodes(spark, monkeypatch):
    """Texts that share a template part late, many steps down: the runs follow the depth."""
    texts = template_pairs(300)
    a, b = shingles(texts[0]), shingles(texts[1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    made = []
    count = jaccard.runs
    monkeypatch.setattr(jaccard, "runs", lambda *args, **named: made.append(count(*args, **named)) or made[-1])
    rows = [(i, r.tobytes()) for i, r in enumerate(jaccard.signatures(texts))]
    of = {r["id"]: r["component"] for r in jaccard.candidate_groups(spark.createDataFrame(rows, "id long, sketch binary")).collect()}
    found = sum(i in of and of[i] == of.get(i + 1) for i in range(0, len(texts), 2))
    assert made[-1] > count() and found >= jaccard.RECALL * len(texts) / 2
    assert len(set(of.values())) > len(texts) / 10  # the template alone does not tie all
