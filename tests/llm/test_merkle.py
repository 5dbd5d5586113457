"""Merkle manifest: equal to SQL, to a plain tree, and its edge cases."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pytest
from conftest import SF
from oracles import assert_same

from corpusloom.llm import merkle


def test_query(spark, duck):
    assert_same(merkle.op11_merkle(spark, SF), duck(SF), merkle.oracle())


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests: list[str]) -> tuple[str, list[list[list[str]]]]:
    """Root of one tree, and its levels as runs of 16."""
    levels, now = [], digests
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        levels.append(runs)
        now = [h(*r) for r in runs]
    return now[0], levels


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root of every row, without Spark."""
    rows = sorted(((s, i, h(*map(field, (i, s, g, n, t))), (i, s, g, n, t)) for i, t, g, s, n in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    trees = [(s, list(g)) for s, g in groupby(rows, key=lambda r: r[0])]
    climbed = [climb([r[2] for r in g]) for _, g in trees]
    root, top = climb([c[0] for c in climbed])
    out = []
    for k, ((_, g), (sub, levels)) in enumerate(zip(trees, climbed, strict=True)):
        for j, r in enumerate(g):
            i, s, lang, n, t = r[3]
            now, proof = r[2], []
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
                low = None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
                now = h(*map(field, (i, s, lang, n, low)))
            for place, tree in ((j, levels), (k, top)):
                for runs in tree:
                    run, at = runs[place // 16], place % 16
                    proof += run[:at] + run[at + 1 :]
                    now = h(*run[:at], now, *run[at + 1 :])
                    place //= 16
            out.append((i, r[2], sub, root, h(*proof), now, now == root))
    return out


@pytest.mark.parametrize("many", [0, 1, 2, 16, 17, 700])
def test_plain_tree(spark, tmp_path, many):
    """Null and empty fields, repeated rows, a hot source, sources of one row, more sources than one run, clashing names."""
    texts = [None, "", "Ärger Über ALLES", "ABC " * 5000, "same", "same"]
    rows = [(None if i % 97 == 5 else i // 2 * 7, texts[i % 6], "en" if i % 3 else None, None if i % 50 == 3 else "" if i % 50 == 4 else "hot" if i % 3 else f"s{i % 41}", i if i % 4 else None) for i in range(many)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, path string, tree int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, merkle.op11_merkle(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain(rows) if rows else [], key=repr)
    if many == 700:
        assert {r[-1] for r in got} == {True, False}
