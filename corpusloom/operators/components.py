"""Connected components of a distributed edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import shared_folder

ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges(a, b) connect each id to.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its smaller
    neighbours on the smallest of those; components shrink to stars in few rounds. Each round is written to
    the shared folder, which cuts the lineage; only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "0")
    seen = None
    for r in range(1, ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hung = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = hung.groupBy("b").agg(F.min("a").alias("m"))
        next_edges = hung.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        now = stored(next_edges, str(r))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return own.unionByName(now.select(F.col("b").alias("id"), F.col("a").alias("component")))
