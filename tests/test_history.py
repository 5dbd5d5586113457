"""Histories whose lines pass their budgets, against a plain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.analytics import fitted, history_window


def plain(lines: list[str], most: int) -> str:
    kept: list[str] = []
    for line in lines:
        room = most - len("\n".join([*kept, ""]))
        if len(line) <= room:
            kept.append(line)
            continue
        if room > 6:
            kept.append(line[: room - 3].rstrip() + "...")
        break
    return "\n".join(kept)


def test_fitted(spark):
    cases = [["a" * n, "b" * m, "c d " * 5 + "e"] for n in (1, 10, 33, 40, 41, 50) for m in (2, 4, 5, 6, 7, 30)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<string>")
    got = {r["i"]: r["t"] for r in df.select("i", fitted(F.col("x"), 40).alias("t")).collect()}
    assert got == {i: plain(x, 40) for i, x in enumerate(cases)}


def test_long_role_and_many_messages(spark, tmp_path):
    rows = [(1, i, "r" * 300, "word " * 100) for i in range(30)] + [(2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["older"], r["history"]) for r in history_window(spark, str(tmp_path)).collect()}
    assert got[2] == (0, "[Recent messages] user:")
    older, text = got[1]
    assert older == 18 and len(text) <= 2400 and text.startswith("[Earlier conversation summary] messages=18, user=0, assistant=0 rrr")
