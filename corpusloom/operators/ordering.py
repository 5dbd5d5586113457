"""Places and followers in a long order, without one task for a whole group.

A group (a base, a source) may hold a third of all rows, so its window is taken over blocks of ids; what
crosses blocks is settled on the few rows at their edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that one block spans.
BLOCK = 4096


def _block(ident: str) -> Column:
    return F.floor(F.col(ident) / BLOCK)


def ranked(df: DataFrame, by: str, ident: str) -> DataFrame:
    """df with _place (from 0, by ident, within its group) and _many (rows of the group); ties in any order.

    The window over a whole group sees one row per block of ids.
    """
    df = df.withColumn("_block", _block(ident))
    blocks = df.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_by")
    before = F.sum("_rows").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_many", F.sum("_rows").over(whole))
    inside = df.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_block").orderBy(ident)) - 1)
    both = inside.join(blocks, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_of")))
    return both.withColumn("_place", F.col("_in") + F.col("_before")).drop("_block", "_by", "_of", "_rows", "_before", "_in")


def summed_before(df: DataFrame, by: str, ident: str, count: str) -> DataFrame:
    """df with _before: the sum of count over the rows of its group before it, by ident, which tells them apart.

    The window over a whole group sees one row per block of ids.
    """
    df = df.withColumn("_block", _block(ident))
    blocks = df.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_of")).agg(F.sum(count).alias("_sum"))
    sums = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_earlier", sums("_sum", Window.partitionBy("_by").orderBy("_of")))
    inside = df.withColumn("_in", sums(count, Window.partitionBy(by, "_block").orderBy(ident)))
    both = inside.join(blocks, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_of")))
    return both.withColumn("_before", F.col("_in") + F.col("_earlier")).drop("_block", "_by", "_of", "_sum", "_earlier", "_in")


def followers(df: DataFrame, by: str, ident: str, order: list[str], n: int, *payload: str) -> DataFrame:
    """df with _next: the payload of the next n rows of its group, null past the end; order begins with ident.

    Rows with n followers in their own block take them from there. The others are the last n of their block,
    and all that may follow them are the first n or last n rows of blocks: the window over the whole group has these only.
    """
    df = df.withColumn("_block", _block(ident)).withColumn("_row", F.struct(*payload))
    inner, whole = Window.partitionBy(by, "_block").orderBy(*order), Window.partitionBy(by).orderBy(*order)
    nexts = lambda w: F.array(*(F.lead("_row", i).over(w) for i in range(1, n + 1)))
    placed = df.withColumn("_next", nexts(inner)).withColumn("_head", F.row_number().over(inner) <= n)
    placed = placed.withColumn("_tail", F.col("_next")[n - 1].isNull())
    edges = placed.filter("_head or _tail").withColumn("_next", nexts(whole)).filter("_tail")
    return placed.filter("not _tail").unionByName(edges).drop("_block", "_row", "_head", "_tail")


def numbered(df: DataFrame, by: str, order: list[str], folder: str) -> DataFrame:
    """df with _place (from 0, in the order, within its group): one sort by ranges, written to the folder.

    The windows see one row per group and range, whatever the groups' sizes. Order must tell the rows of a group apart.
    """
    kept = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id())
    kept.write.parquet(folder)
    kept = df.sparkSession.read.schema(kept.schema).parquet(folder).withColumn("_range", F.shiftright("_at", 33))
    spans = kept.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_by").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_before", before)
    both = kept.join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in")))
    return both.withColumn("_place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_by", "_in", "_first", "_rows", "_before")
