"""Connected components, block-wise comparison of groups, and membership filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, free_memory, mix, partitions, written

ROUNDS = 60
#: Bits of a membership filter: 8 MB, however many keys; too many keys only make it pass more.
FILTER_BITS = 1 << 26
_CHUNK_BITS = 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges(a, b) connect each id to; ids without edges are absent.

    Alternating large-star and small-star steps: each needs one grouping and one join, and shrinks every
    component towards a star around its smallest id. Edges stay distributed; only whether all are stars reaches the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(ROUNDS):
        # done once no node hangs on two others, or on one that hangs itself
        roles = now.select(F.col("b").alias("k"), F.col("a").alias("on")).unionByName(now.select(F.col("a").alias("k"), F.col("a").alias("on")))
        if roles.groupBy("k").agg(F.min("on").alias("low"), F.max("on").alias("high")).filter("low <> high").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node hangs on the node's smallest neighbour
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: the node and its smaller neighbours hang on the smallest of them
        under = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "k")
        joined = large.join(under, F.col("b") == F.col("k"))
        small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        before, now = now, written(small, "edges")
        discarded(before)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("a").alias("component")))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n nodes with edges (i, j): each node's smallest connected node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: list[str] | None = None, rows: int = 5_000) -> DataFrame:
    """Call work on many groups (all rows of each key combination) at a time, of at least so many rows together.

    A group must fit one task: callers cut larger ones into blocks first (see `block_pairs`).
    """
    n = max(1, partitions(df.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        have, wanted = 0, rows
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            have += len(pdf)
            if have < wanted:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(_new_group(pdf, keys))[-1])
            if last and (got := work(pdf.iloc[:last])) is not None and len(got):
                yield got
            held = [pdf.iloc[last:].reset_index(drop=True)]
            have = len(pdf) - last
            wanted = max(rows, 2 * have)
        if held and (got := work(pd.concat(held, ignore_index=True))) is not None and len(got):
            yield got
        free_memory()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def _new_group(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def by_group(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Call work on all rows of each key combination, group after group within a task: no Python start-up per group."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame | None:
        starts = [*np.flatnonzero(_new_group(pdf, keys)).tolist(), len(pdf)]
        out = [got for s, e in zip(starts[:-1], starts[1:], strict=True) if (got := work(pdf.iloc[s:e])) is not None and len(got)]
        return pd.concat(out, ignore_index=True) if out else None

    return by_groups(df, keys, each, schema, order)


def block_pairs(df: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """df with `_i`, `_j`: groups of more than `block` members are cut into blocks and every pair of blocks is one comparison.

    A member goes to as many comparisons as its group has blocks, as `_side` -1 (the only block), 0 or 1.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks")).withColumnRenamed(group, "_g")
    df = df.join(sizes, F.col(group) == F.col("_g")).drop("_g")
    df = df.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    df = df.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    return df.withColumn("_side", F.when(F.col("_own") == F.col("_i"), 0).otherwise(1)).drop("_blocks", "_own", "_other")


class Members:
    """A test of long keys that passes all of those given and few others: a bitmap of `FILTER_BITS` bits for use in Python tasks."""

    def __init__(self, keys: DataFrame, column: str):
        size = _CHUNK_BITS // 8

        def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            marks: dict[int, np.ndarray] = {}
            for pdf in batches:
                b = _places(pdf[column].to_numpy())
                for c in np.unique(b // _CHUNK_BITS).tolist():
                    flags = np.zeros(_CHUNK_BITS, dtype=np.uint8)
                    flags[b[b // _CHUNK_BITS == c] % _CHUNK_BITS] = 1
                    packed = np.packbits(flags)
                    marks[c] = marks[c] | packed if c in marks else packed
            yield pd.DataFrame({"chunk": [*marks], "bits": [m.tobytes() for m in marks.values()]})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(size, dtype=np.uint8)
            for x in pdf["bits"]:
                total |= np.frombuffer(x, dtype=np.uint8)
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [total.tobytes()]})

        each = keys.select(column).mapInPandas(bits, "chunk long, bits binary")
        merged = each.groupBy("chunk").applyInPandas(merge, "chunk long, bits binary")
        table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for r in merged.toLocalIterator():
            table[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    def have(self, keys: np.ndarray) -> np.ndarray:
        b = _places(keys)
        return (np.frombuffer(self.shared.value, dtype=np.uint8)[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1


def _places(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
