"""Filter interaction audit over a packed bitmap index.

The index has one row per block of rows: a packed bitset for every filter (bit set: the row fails it), every label and
every part that the block holds. What survives a set of filters is an AND-NOT of bitsets, and each number of the audit is a
popcount; blocks are counted apart and their counts summed, so orders, parts and labels never meet the rows again.

Defined edge cases: a null text counts as empty, a null source is the part '' together with empty ones; a row without doc_id is never
a copy of a smaller one, nor is any row of it; rows with equal doc_id and text are not copies of each other;
a label holds for a doc_id if any of its label rows says so, and a null label says nothing; very long texts are read in place, one at a time; further
columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, mapped, written

#: The contract's filters, in the order of their bits.
FILTERS, LABELS = "ABCDE", ("good", "toxic")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
#: Rows of one block of the index.
BLOCK = 1 << 16
INDEX = "rows long, filters array<binary>, labels array<binary>, parts array<struct<part:string,first:int,bits:binary>>"


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > MAX_CAPITAL_PERCENT * len(text)) << 2 | bool(SYMBOLS.search(raw)) << 3


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): what the filters need of every text, without the text."""
    asked = docs.select("doc_id", F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), clean_text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fails = [], []
            for x in batch.column("text"):
                text = x.as_py()
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
                fails.append(failures(text))
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], names=["doc_id", "part", "digest", "fails"])

    return mapped(asked, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, fails int")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, marks): bits of all filters that a row fails, E among them, and of its labels.

    A row copies a smaller one unless it is the first of its text; the firsts are joined on text and id together, so a
    text with any number of copies meets one row.
    """
    rows = written(judged(docs), "judged")
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    marks = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    both = rows.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("digest") == F.col("_digest")), "left").join(marks, F.col("doc_id") == F.col("_doc"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    fails = F.col("fails").bitwiseOR(copy.cast("int") * 16)
    return both.select("part", fails.alias("fails"), (F.coalesce("_good", F.lit(0)) + 2 * F.coalesce("_toxic", F.lit(0))).alias("marks"))


def bitmap_index(rows: DataFrame, filters: int, labels: int) -> DataFrame:
    """The index of (part, fails, marks) rows, a row per block. Rows of a part are neighbours in their block, so a part's bitset is kept without the zero bytes around it."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        parts = table.column("part").combine_chunks().dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, names = code[order], parts.dictionary.to_pylist()
        fails, marks = (table.column(c).to_numpy()[order] for c in ("fails", "marks"))
        sets = lambda bits, n: [np.packbits((bits >> i) & 1).tobytes() for i in range(n)]
        ends = np.flatnonzero(np.diff(code, append=-1)) + 1
        held = []
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = np.zeros((hi - 1) // 8 * 8 + 8 - lo // 8 * 8, dtype=np.uint8)
            own[lo - lo // 8 * 8 : hi - lo // 8 * 8] = 1
            held.append({"part": names[code[lo]], "first": lo // 8, "bits": np.packbits(own).tobytes()})
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.struct([("part", pa.string()), ("first", pa.int32()), ("bits", pa.binary())]))]
        values = [[len(code)], [sets(fails, filters)], [sets(marks, labels)], [held]]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["rows", "filters", "labels", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, BLOCK - many)
                held, many, batch = [*held, head], many + head.num_rows, batch.slice(head.num_rows)
                if many == BLOCK:
                    yield packed(pa.Table.from_batches(held))
                    held, many = [], 0
        if many:
            yield packed(pa.Table.from_batches(held))

    return mapped(rows, run, INDEX)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def prefix_counts(index: DataFrame, filters: int) -> DataFrame:
    """(part, before, filter, counts): for every set of filters applied before (bits) and every filter applied then, summed over all blocks."""
    every = (1 << filters) - 1
    combos = [(before, f) for before in range(1 << filters) for f in range(filters) if not before >> f & 1]
    ones = np.array([i.bit_count() for i in range(256)], dtype=np.int64)
    count = lambda bits: int(ones[bits].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fails, (good, toxic) = ([np.frombuffer(x, dtype=np.uint8) for x in row[c]] for c in ("filters", "labels"))
                out: list[tuple] = []
                for part in row["parts"]:
                    own = np.frombuffer(part["bits"], dtype=np.uint8)
                    at = slice(part["first"], part["first"] + len(own))
                    gone = {0: np.zeros_like(own)}
                    for s in range(1, every + 1):
                        low = s & -s
                        gone[s] = gone[s ^ low] | fails[low.bit_length() - 1][at]
                    for before, f in combos:
                        failing = fails[f][at] & own
                        now = failing & ~gone[before]
                        n = [count(own & ~gone[before | 1 << f]), count(now), count(failing & gone[before]), count(failing & ~gone[every ^ 1 << f]), count(now & good[at]), count(now & toxic[at])]
                        out.append((part["part"], before, f, *n))
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "before", "filter", *COUNTS])

    each = mapped(index, run, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return each.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, before, filter) of all permutations: factorial in the number of filters, not in the data."""
    out = []
    for p in itertools.permutations(range(len(letters))):
        for step, f in enumerate(p, 1):
            out.append(("".join(letters[i] for i in p), step, sum(1 << i for i in p[: step - 1]), f))
    return spark.createDataFrame(out, "filter_order string, step int, before int, filter int")


def audit(index: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step and its filter's removals over all orders."""
    n = len(letters)
    counts = prefix_counts(index, n)
    size = F.bit_count("before")
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)
    counts = counts.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "filter")))
    return counts.join(F.broadcast(orders(index.sparkSession, letters)), ["before", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(bitmap_index(filtered(docs, labels), len(FILTERS), len(LABELS)), FILTERS)


_BITS = ", ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate("abcde")).replace(", ", " + ")
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (SELECT doc_id, part, len(ws) < {MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws) AS b,
 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > {MAX_CAPITAL_PERCENT} * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, {_BITS} AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
s AS (SELECT unnest(string_split('ABCDE', '')) AS letter),
p AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS o FROM s a JOIN s b ON b.letter <> a.letter JOIN s c ON c.letter NOT IN (a.letter, b.letter) JOIN s d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN s e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
q AS (SELECT o, step, 1 << (ascii(o[step]) - 65) AS own, list_sum(list_transform(string_split(o[:step - 1], ''), lambda ch: CASE WHEN ch = '' THEN 0 ELSE 1 << (ascii(ch) - 65) END))::INT AS before FROM p CROSS JOIN range(1, 6) r(step)),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (fails & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & own > 0), 0) AS removed,
 coalesce(sum(n) FILTER (fails & before > 0 AND fails & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
 coalesce(sum(g) FILTER (fails & before = 0 AND fails & own > 0), 0) AS good_lost, coalesce(sum(x) FILTER (fails & before = 0 AND fails & own > 0), 0) AS toxic_lost FROM m CROSS JOIN q GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
