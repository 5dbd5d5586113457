"""Helpers that the training-data operators share: scratch tables, text columns, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and any executor can reread it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each query as it ends: for tables that are written, not computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discarded(table: DataFrame) -> None:
    """Remove the files of a table from `written` that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def known(column: Column | str) -> list[Column]:
    """A long column that may hold nulls as two that hold none, `_id` and `_unknown`: pandas makes floats of longs with nulls."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.coalesce(c.cast("long"), F.lit(0)).alias("_id"), c.isNull().alias("_unknown")]


def id_again(name: str = "doc_id") -> Column:
    """The column that `known` took apart."""
    return F.when(~F.col("_unknown"), F.col("_id")).alias(name)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run), after which the worker gives freed memory back: idle workers would keep it."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free_memory()

    return df.mapInArrow(freed, schema)


def free_memory() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts have about so many bytes together (a longer text is one slice), with the texts."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
        part = batch.slice(at, stop - at)
        yield part, part.column(column).to_pylist()
        at = stop


def clean_text(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has: the given one, behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that names of working columns cannot clash with them."""
    return F.struct(*(f"`{c}`" for c in df.columns)).alias("row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_rng = np.random.default_rng(20240501)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word boundaries and 64-bit word hashes of many texts at once, without a Python object per word.

    data: all texts in UTF-8, each followed by a line feed; start, end: byte bounds of every word in
    data; hash: its hash; first: index of each text's first word (one more entry than texts).
    """

    def __init__(self, texts: list[str] | list[bytes], chunk: int = 1_000_000):
        parts = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join([*parts, b""])
        raw = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        space = _IS_SPACE[raw]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        # hash = sum of table[byte] * base^(place in the word), from prefix sums modulo 2^64
        w = 0
        while w < len(self.start):
            lo = int(self.start[w])
            stop = max(w + 1, int(np.searchsorted(self.end, lo + chunk, side="right")))
            hi = int(self.end[stop - 1])
            n = hi - lo
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_TABLE[raw[lo:hi]] * _forward(n)[:n], out=sums[1:])
            s, e = self.start[w:stop] - lo, self.end[w:stop] - lo
            self.hash[w:stop] = mix((sums[e] - sums[s]) * _backward(n)[s])
            w = stop

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each window of k consecutive words, whether it lies inside one text)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        inside = np.ones(n - k + 1, dtype=bool)
        for f in self.first[1:-1]:
            inside[max(0, f - k + 1) : f] = False
        return window_hashes(self.hash, k), inside


def window_hashes(hashes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (order counts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(base)
        out += hashes[j : j + n]
    return mix(out)


_cache: dict[str, np.ndarray] = {}


def _forward(n: int) -> np.ndarray:
    if len(_cache.get("f", ())) < n + 1:
        _cache["f"] = powers(_BASE, n)
    return _cache["f"]


def _backward(n: int) -> np.ndarray:
    if len(_cache.get("b", ())) < n + 1:
        _cache["b"] = powers(_INVERSE, n)
    return _cache["b"]
