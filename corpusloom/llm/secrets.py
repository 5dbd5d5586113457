"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds the base spans (assignments, access keys, hexadecimal runs) and further
candidates: long runs of token characters with letters, digits and high entropy. The hashes of all values,
those in base spans included, are then counted over the whole corpus by distinct repository and distinct
owner. The tables have neither: a distinct text stands for a repository, its `source` for the owner. A value
that few repositories of few owners hold looks live; any other is a widely copied example. Every base span
stays a span, told live or example; of the further candidates the live ones join as kind `live`.

Defined edge cases: a null text is empty; a null owner is one owner of its own; rows with equal texts have the
same spans; offsets are code points, end exclusive; texts of any length are scanned whole; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, mapped, text_blocks, whole_row, written

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_CHARACTERS, TOKEN_CHARACTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEYWORDS = ("password", "passwd", "secret", "token", "api")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "live")
#: Method: least length and entropy (bits a character) of a candidate; most repositories and owners of a live one.
MIN_TOKEN, MIN_ENTROPY, MAX_REPOSITORIES, MAX_OWNERS = 20, 3.0, 3, 2

_BLOCK = 2_000_000


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(129, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


_HEX, _TOKEN = _flags(HEX_CHARACTERS), _flags(TOKEN_CHARACTERS)


def runs(codes: np.ndarray, flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs, of at least so many characters, of the flagged ones."""
    edge = np.diff(np.concatenate([[False], flags[codes], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def looks_random(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and entropy(token) >= MIN_ENTROPY


def scan_block(texts: list[str]) -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]]:
    """Of each text: base spans (start, kind number, end, start of the value), and candidate spans that touch none of them."""
    joined = "\n".join([*texts, ""])
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]).astype(np.int64)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    wanted: list[list[tuple[int, int]]] = [[] for _ in texts]
    for flags, least, kind in ((_HEX, MIN_HEX, 2), (_TOKEN, MIN_TOKEN, None)):
        start, end = runs(codes, flags, least)
        of = np.searchsorted(begin, start, side="right") - 1
        for i, s, e in zip(of.tolist(), (start - begin[of]).tolist(), (end - begin[of]).tolist(), strict=True):
            if kind is None:
                wanted[i].append((s, e))
            else:
                found[i].append((s, kind, e, s))
    for i, text in enumerate(texts):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[i] += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
        if "AKIA" in text:
            found[i] += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        found[i].sort()
        if wanted[i]:
            free, j, reach = [], 0, 0
            for s, e in wanted[i]:
                while j < len(found[i]) and found[i][j][0] < e:
                    reach = max(reach, found[i][j][2])
                    j += 1
                if reach <= s and looks_random(text[s:e]):
                    free.append((s, e))
            wanted[i] = free
    return list(zip(found, wanted, strict=True))


def _joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


SPAN = "start:int,kind:int,end:int"
SCANNED = f"text_key binary, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<{SPAN},hash:binary>>"


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One narrow row per document: key, owner, counts and digest of the base spans, and all spans and candidates with their values' hashes."""
    kind = docs.schema[key].dataType.simpleString()
    t = clean_text(docs, text)
    part = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("_owner"), F.unhex(F.md5(t.cast("binary"))).alias("text_key"), t.alias("_text"))
    digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in text_blocks(batch, "_text", _BLOCK):
                rows = []
                for t, (base, wanted) in zip(texts, scan_block(texts), strict=True):
                    n = Counter(k for _, k, _, _ in base)
                    found = [{"start": s, "kind": k, "end": e, "hash": digest(t[v:e])} for s, k, e, v in base]
                    found += [{"start": s, "kind": 3, "end": e, "hash": digest(t[s:e])} for s, e in wanted]
                    rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), found))
                more = [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)]
                yield pa.record_batch([*block.columns[:3], *more], names=["_key", "_owner", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return mapped(part, run, f"_key {kind}, _owner string, {SCANNED}")


def values(rows: DataFrame) -> DataFrame:
    """(hash, repositories, owners, live) of every value that scanned() rows hold, over the whole corpus."""
    each = rows.select("_owner", "text_key", F.explode(F.array_distinct("found.hash")).alias("hash")).distinct()
    counted = each.groupBy("hash").agg(F.count_distinct("text_key").alias("repositories"), F.count_distinct("_owner").alias("owners"))
    return counted.withColumn("live", (F.col("repositories") <= MAX_REPOSITORIES) & (F.col("owners") <= MAX_OWNERS))


def with_live(rows: DataFrame) -> DataFrame:
    """scanned() rows with `spans` (base spans and live candidates by start, then kind), each with its value's repositories, owners and `live`.

    Values are matched once per distinct text, so copies of a text are no load.
    """
    some = rows.filter(F.size("found") > 0)
    each = some.dropDuplicates(["text_key"]).select("text_key", F.explode("found").alias("c")).select("text_key", "c.*")
    told = each.join(values(some).withColumnRenamed("hash", "h"), F.col("hash") == F.col("h")).filter((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "repositories", "owners", "live")
    of = told.groupBy(F.col("text_key").alias("t2")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    both = rows.drop("found").join(of, F.col("text_key") == F.col("t2"), "left").drop("t2")
    return both.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<struct<{SPAN},repositories:bigint,owners:bigint,live:boolean>>")))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """_key, text_key, counts, base_sha256 and spans of every row of docs."""
    return with_live(written(scanned(docs, key, text, owner), "secrets"))


def masked(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", mask: str = "<secret>") -> DataFrame:
    """docs with the characters of all spans replaced by a mask (overlapping spans by one), other columns unchanged.

    The table of spans has only the texts that have some; Spark broadcasts it where its measured size allows.
    """
    spans = find_secrets(docs, key, text, owner).filter(F.size("spans") > 0).dropDuplicates(["text_key"])
    spans = written(spans.select(F.col("text_key").alias("span_text"), F.transform("spans", lambda x: F.struct(x["start"], x["end"])).alias("spans")), "secret-spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, some in zip(texts, spans, strict=True):
            if some is None or not len(some):
                out.append(t)
                continue
            parts, at = [], 0
            for x in sorted((x["start"], x["end"]) for x in some):
                if x[0] >= at:
                    parts += [t[at : x[0]], mask]
                at = max(at, x[1])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    given = docs.select(whole_row(docs), F.unhex(F.md5(clean_text(docs, text).cast("binary"))).alias("digest"))
    both = given.join(spans, F.col("digest") == F.col("span_text"), "left")
    old, has = F.col(f"row.`{text}`"), F.col("span_text").isNotNull()
    new = F.when(has, cut(F.when(has, old), F.col("spans"))).otherwise(old)  # only texts with spans go to Python
    return both.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = find_secrets(docs)
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    more = [live.alias("n_live"), (F.size("spans").cast("long") - live).alias("n_examples"), F.array_max(F.transform("spans", lambda x: x["owners"])).alias("most_owners")]
    return found.select(F.col("_key").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", *more, spans_text(F.col("spans")).alias("spans"))
