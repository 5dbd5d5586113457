"""K-d tree shards: near-equal bytes, gapless slots, hot values split."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusloom.llm import sharding


def test_query(spark):
    rows = sharding.op5_kd_shards(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.octet_length("text").alias("n"), F.crc32(F.col("text").cast("binary")).alias("c")).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == (d["n"] or 0) + 16 and r["text_crc32"] == d["c"] and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(size.values()) / 40, max(r["size"] for r in rows)
    assert max(size.values()) <= mean + most


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_hot_values(spark, shards):
    """A third of all rows alike in every dimension still spread evenly."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).alias("a"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 97).alias("b"), (F.lit(10) + F.col("id") % 5).alias("size"))
    got = sharding.kd_shards(df, ["a", "b"], shards=shards).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == shards
    mean = sum(r["s"] for r in got) / shards
    assert all(abs(r["s"] - mean) <= 30 for r in got)


def test_target_and_edges(spark):
    df = spark.range(100).select("id", F.lit(1).cast("long").alias("a"), F.lit(100).cast("long").alias("size"))
    assert sharding.kd_shards(df, ["a"], shards=None, target=1000).agg(F.countDistinct("shard")).first()[0] == 10
    assert sharding.kd_shards(df.limit(0), ["a"]).count() == 0
    few = sharding.with_slots(sharding.kd_shards(df.limit(3), ["a"]), ["id"]).collect()
    assert len(few) == 3 and all(0 <= r["shard"] < 40 for r in few)


def test_clashing_names(spark):
    df = spark.range(50).select("id", F.lit(1).alias("_node"), F.lit("x").alias("_tie"), F.lit("y").alias("row"), F.lit(9).alias("part"), F.lit(3).cast("long").alias("size"), F.lit(None).cast("long").alias("a"))
    out = sharding.with_slots(sharding.kd_shards(df, ["a"], shards=5), ["id"])
    assert out.columns == [*df.columns, "shard", "slot"] and out.count() == 50
    assert out.filter("_tie = 'x' and row = 'y' and part = 9 and _node = 1").count() == 50
