"""Shards of near-equal bytes by a k-d tree over document metadata.

All rows start in one node. Each round splits every node that stands for more than one shard: along its
widest metadata dimension (range relative to the whole corpus), at the weighted quantile that gives each
side the bytes of its share of shards. The quantile is found over all rows by refining a histogram of
bytes; only histograms (shards x buckets sums) and node extents reach the driver, however many rows.
Names (language, source) count by their rank in the alphabet. Equal values are told apart by a hash of the row,
and equal rows by a number drawn once and stored, so a cut can fall within a value that very many rows share, copies
included: which of equal rows goes where is all that another file split could change.

Defined edge cases: a null text has 16 bytes; null metadata is the smallest value; equal rows are placed one
by one; input columns named shard or slot are replaced; a null weight is 0; with fewer rows than shards
some shards stay empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, partitions, whole_row, written

SHARDS, BUCKETS, OVERHEAD = 40, 4096, 16
#: A cut is final once the bucket it falls in has at most this part of a shard's bytes.
TOLERANCE = 1e-4
_TIE = 32
#: Rows that one task numbers at most, on average.
SLOT_ROWS = 50_000


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the rank of a column's value among its distinct values as `name`; null is 0, others from 1 on.

    The distinct values are sorted in ranges; only the ranges' counts reach the driver.
    """
    spark = rows.sparkSession
    distinct = rows.select(F.col(f"`{column}`").cast("string").alias("v")).filter("v is not null").distinct()
    number = F.monotonically_increasing_id()
    ranges = distinct.repartitionByRange(max(1, partitions(spark)), "v").sortWithinPartitions("v")
    ranges = written(ranges.select("v", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit(2**33 - 1)).alias("at")), "ranks")
    before, offsets = 1, []
    for r in sorted(ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "p int, before long"))  # one row a range
    ranks = ranges.join(starts, F.col("part") == F.col("p")).select("v", (F.col("before") + F.col("at")).alias(name))
    both = rows.select(whole_row(rows), F.col(f"`{column}`").cast("string").alias("_v")).join(ranks, F.col("_v") == F.col("v"), "left")
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns), F.coalesce(name, F.lit(0)).alias(name))


def _tie(rows: DataFrame) -> Column:
    """20 bits of the row's content before 12 that tell equal rows apart."""
    content, number = F.xxhash64(*(f"`{c}`" for c in rows.columns)), F.xxhash64(F.monotonically_increasing_id())
    return F.shiftleft(content.bitwiseAND(F.lit(2**20 - 1)), 12).bitwiseOR(number.bitwiseAND(F.lit(2**12 - 1)))


def kd_shards(rows: DataFrame, dims: list[str], weight: str = "size", shards: int | None = SHARDS, target: int | None = None) -> DataFrame:
    """rows with `shard`. dims: long columns from 0 to 2^31 - 1. shards: how many; or target: bytes a shard."""
    kept = [c for c in rows.columns if c.lower() != "shard"]
    back = [F.col(f"row.`{c}`").alias(c) for c in kept]
    given = rows.select(whole_row(rows), *(F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("long").alias(f"_d{i}") for i, d in enumerate(dims)), F.coalesce(F.col(f"`{weight}`"), F.lit(0)).cast("long").alias("_w"), _tie(rows).alias("_tie"))
    rows, dims, weight = written(given, "shard-rows"), [f"_d{i}" for i in range(len(dims))], "_w"
    total, *extent = rows.agg(F.sum(weight), *(f(d) for d in dims for f in (F.min, F.max))).first()
    if total is None:
        return rows.select(*back, F.lit(0).alias("shard"))
    if target is not None:
        shards = max(1, -(-total // target))
    span = {d: max(1, extent[2 * i + 1] - extent[2 * i]) for i, d in enumerate(dims)}
    at: dict[int, int] = {0: shards}  # a node is known by its first shard; its count of shards
    df = rows.withColumn("_node", F.lit(0))
    dim_of = F.array(*(F.col(d) for d in dims))
    while any(n > 1 for n in at.values()):
        extents = [f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
        cuts: dict[int, dict] = {}
        for r in df.filter(_at([n > 1 for n in _row(at, shards, 0)], "_node")).groupBy("_node").agg(F.sum(weight).alias("bytes"), *extents).collect():
            k, n = r["_node"], at[r["_node"]]
            width = [(r[f"hi{i}"] - r[f"lo{i}"]) / span[d] for i, d in enumerate(dims)]
            i = max(range(len(dims)), key=lambda j: (width[j], -j))
            cuts[k] = {"dim": i, "from": r[f"lo{i}"] << _TIE, "to": (r[f"hi{i}"] + 1) << _TIE, "before": 0, "want": r["bytes"] * (n // 2) / n, "done": False}
        dim = _at([cuts[k]["dim"] if k in cuts else 0 for k in range(shards)], "_node")
        df = df.withColumn("_key", F.shiftleft(F.get(dim_of, dim), _TIE).bitwiseOR(F.col("_tie")))
        while todo := {k: c for k, c in cuts.items() if not c["done"]}:
            for c in todo.values():
                c["step"] = max(1, -(-(c["to"] - c["from"]) // BUCKETS))
            of = lambda name, other, todo=todo: _at([todo[k][name] if k in todo else other for k in range(shards)], "_node")
            inside = df.filter((F.col("_key") >= of("from", 0)) & (F.col("_key") < of("to", 0)))
            inside = inside.withColumn("_off", F.col("_key") - of("from", 0)).withColumn("_step", of("step", 1))
            sums: dict[int, list] = {k: [] for k in todo}
            for r in inside.groupBy("_node", F.expr("_off div _step").alias("_bucket")).agg(F.sum(weight).alias("bytes")).collect():
                sums[r["_node"]].append((r["_bucket"], r["bytes"]))
            for k, c in todo.items():
                before = c["before"]
                for b, size in sorted(sums[k]):
                    if before + size >= c["want"]:
                        break
                    before += size
                start = c["from"] + b * c["step"]
                if c["step"] == 1 or size <= total / shards * TOLERANCE:
                    # the bucket goes to the side that leaves the smaller error
                    c["cut"] = start + c["step"] if before + size - c["want"] <= c["want"] - before else start
                    c["done"] = True
                else:
                    c["from"], c["to"], c["before"] = start, start + c["step"], before
        cut = _at([cuts[k]["cut"] if k in cuts else 2**63 - 1 for k in range(shards)], "_node")
        right = _at([k + n // 2 for k, n in enumerate(_row(at, shards, 0))], "_node")
        placed = F.when(F.col("_key") < cut, F.col("_node")).otherwise(right).cast("int")
        df = written(df.withColumn("_next", placed).drop("_node", "_key"), "shard-level").withColumnRenamed("_next", "_node")
        at = {j: m for k, n in at.items() for j, m in (((k, n // 2), (k + n // 2, n - n // 2)) if n > 1 else ((k, n),))}
    return df.select(*back, F.col("_node").alias("shard"))


def _row(at: dict[int, int], shards: int, other: int) -> list[int]:
    return [at.get(k, other) for k in range(shards)]


def _at(values: list, column: str) -> Column:
    """values[column], as a constant array; one expression, since a call into the JVM for each value took most of the driver's time."""
    constants = ", ".join(str(v).lower() if isinstance(v, bool) else f"{v}L" for v in values)
    return F.expr(f"get(array({constants}), `{column}`)")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `slot`: 0, 1, ... without gaps in each shard; numbered in many parts, joined by their offsets."""
    names = [c for c in rows.columns if c.lower() != "slot"]
    order = [f"row.`{c}`" for c in order]
    rows = written(rows.select(whole_row(rows), "shard"), "shard-placed")
    parts = max(1, rows.count() // SHARDS // SLOT_ROWS + 1) * 4
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), before.alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    both = rows.withColumn("at", at).join(offsets, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in names), (F.col("before") + F.col("at")).cast("long").alias("slot"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    data = clean_text(docs).cast("binary")
    size = F.octet_length(data).cast("long") + OVERHEAD
    rows = docs.select("doc_id", size.alias("size"), F.crc32(data).alias("text_crc32"), "lang", "source")
    rows = ranked(ranked(rows, "lang", "d_lang"), "source", "d_source")
    rows = rows.withColumn("d_size", F.least(F.col("size"), F.lit(2**31 - 1))).withColumn("d_id", F.coalesce(F.col("doc_id").bitwiseAND(F.lit(2**31 - 1)), F.lit(0)))
    out = kd_shards(rows, ["d_source", "d_lang", "d_size", "d_id"])
    out = with_slots(out.select("doc_id", "size", "text_crc32", "shard"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
