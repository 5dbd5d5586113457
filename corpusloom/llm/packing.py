"""Best-fit packing of token sequences with certified bin counts.

Documents become runs of token ids that end with id 0; a run longer than a sequence is cut into full
pieces, the first of which may be shorter. The pieces are dealt at random over partitions, each of which
packs its own best-fit decreasing and compares its bins with a lower bound from dual feasible functions:
equal, they are certified the fewest possible. Partitions with a gap give up the bins that are not full,
certified ones their emptiest bin; what was given up is dealt anew over fewer partitions and packed
again, round by round, as long as that saves bins. Only counts of bins and pieces reach the driver.

Defined edge cases: a null text is empty and has the one id 0; repeated rows are packed one by one;
documents of any length are cut, never shortened; an empty table gives no pieces.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, TrieEncoder, read_vocabulary
from .common import clean_text, free_memory, mapped, text_blocks, unused, written

CAPACITY, END = 2048, 0
#: Pieces that one partition packs, on average; rounds of exchange at most.
PARTITION_PIECES, ROUNDS = 20_000, 6
#: A bin of a partition with a gap is given up if it has more than this part of its room left.
SLACK = 0.005
_BLOCK = 4_000_000


class WholeTextEncoder:
    """Encodes whole texts in native code with the vocabulary file's tokens and merges; equal to the trie encoder.

    Where the tokens' ids are not in the order of their merges, or native code gives up on a text, the trie encoder steps in.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        self.vocabulary = vocabulary
        trie = TrieEncoder(vocabulary)
        in_order = [trie.id_of[a + b] for (a, b), _ in sorted(trie.rank.items(), key=lambda x: x[1])]
        self.native = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=trie.id_of, special_tokens=trie.specials) if in_order == sorted(in_order) else None

    @cached_property
    def trie(self) -> TrieEncoder:
        """Built when a text first needs it."""
        return TrieEncoder(self.vocabulary)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.native is None:
                yield next(self.trie.encode([text]))
                continue
            try:
                yield self.native.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except (RuntimeError, ValueError):
                yield next(self.trie.encode([text]))


_encoders: dict[str, WholeTextEncoder] = {}


def _encoder(vocabulary: str) -> WholeTextEncoder:
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = WholeTextEncoder(vocabulary)
        gc.collect()
        free_memory()
    return _encoders[vocabulary]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a run of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: key and columns `keep` of its document, piece, start, length, ids_crc32, and with ids=True the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns, given = [key, *(keep or [])], unused(docs, "_text")
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "piece int, start long, length long, ids_crc32 long", *(["ids binary"] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = _encoder(shared.value), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for block, texts in text_blocks(batch, given, _BLOCK):
                rows, of = [], []
                for i, data in enumerate(e.encode(texts)):
                    data += end
                    for p, (s, n) in enumerate(cuts(len(data) // 4)):
                        part = data[4 * s : 4 * (s + n)]
                        rows.append((p, s, n, zlib.crc32(part), part))
                        of.append(i)
                own = [block.column(c).take(pa.array(of, pa.int32())) for c in range(len(columns))]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if ids else [])]
                more = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([*own, *more], names=[*columns, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    return mapped(docs.select(*(f"`{c}`" for c in columns), clean_text(docs, text).alias(given)), run, fields)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset in it) of each length, and how full each bin is."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    full: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(full)
            full.append(0)
        bins[i], offsets[i] = b, full[b]
        full[b] += n
        if rest := room - n:
            if not by_room.setdefault(rest, []):
                rooms |= 1 << rest
            by_room[rest].append(b)
    return bins, offsets, full


def fewest(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound on bins: the best over all thresholds t of the dual feasible function that counts
    lengths over capacity - t as whole bins and those below t as nothing."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    weight = counts * np.arange(capacity + 1)
    many, much = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(weight)])
    t = np.arange(0, capacity // 2 + 1)
    large = many[-1] - many[capacity - t + 1]
    middle = much[capacity - t + 1] - much[t]
    # lengths over half a bin exclude each other, whatever their room
    return int(max(np.max(large + -(-middle // capacity)), many[-1] - many[capacity // 2 + 1])) if len(lengths) else 0


STATE = "_row long, _piece int, length long, _part long, _bin long, offset long, _full long, _bins long, _bound long, _emptiest boolean"


def _packed(items: DataFrame, parts: int, salt: int) -> DataFrame:
    """Pack items(_row, _piece, length) in so many partitions."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "_piece"])
        lengths = pdf["length"].to_numpy()
        bins, offsets, full = best_fit(lengths.tolist())
        out = pdf.assign(_bin=bins, offset=offsets, _full=np.array(full)[bins], _bins=len(full), _bound=fewest(lengths))
        return out.assign(_emptiest=out["_bin"] == int(np.argmin(full)))[[f.split()[0] for f in STATE.split(", ")]]

    dealt = items.select("_row", "_piece", "length").withColumn("_part", F.pmod(F.xxhash64("_row", "_piece", F.lit(salt)), F.lit(parts)).cast("long"))
    return dealt.groupBy("_part").applyInPandas(pack, STATE)


def place(items: DataFrame) -> DataFrame:
    """items(_row, _piece, length) with `sequence_id` and `offset`: rounds of packing and exchange."""
    final: list[DataFrame] = []
    todo, before = items, None
    number = lambda r: F.lit(r + 1) * F.lit(1 << 56) + F.col("_part") * F.lit(1 << 28) + F.col("_bin")
    count = items.count()
    for r in range(ROUNDS):
        parts = max(1, -(-count // PARTITION_PIECES))
        state = written(_packed(todo, parts, r).withColumn("sequence_id", number(r)), "packed")
        used = state.groupBy("_part").agg(F.first("_bins").alias("b")).agg(F.sum("b")).first()[0] or 0
        if before is not None and used >= before[0]:
            final.append(before[1])  # the exchange saved nothing: the bins stay as they were
            break
        gap = F.col("_bins") > F.col("_bound")
        given = (F.col("_emptiest") | (gap & (F.col("_full") < int(CAPACITY * (1 - SLACK))))) & (F.col("_full") < CAPACITY)
        state = state.withColumn("_given", given)
        if parts == 1 or r == ROUNDS - 1:
            final.append(state)
            break
        final.append(state.filter(~F.col("_given")))
        todo = state.filter("_given")
        found = todo.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not found[0]:
            break
        count, before = found[0], (found[1], todo)
    columns = ["_row", "_piece", "sequence_id", "offset"]
    out = final[0].select(columns)
    for f in final[1:]:
        out = out.unionByName(f.select(columns))
    return out


def packed(cut: DataFrame) -> DataFrame:
    """A table of pieces with sequence_id and offset. Full pieces are sequences of their own; the others are placed.

    cut must be a stored table with a row number per document in `_row`.
    """
    full = cut.filter(F.col("length") == CAPACITY).withColumn("sequence_id", -1 - (F.col("_row") + F.col("piece"))).withColumn("offset", F.lit(0).cast("long"))
    items = cut.filter(F.col("length") < CAPACITY).select("_row", F.col("piece").alias("_piece"), "length")
    placed = place(items).withColumnRenamed("_row", "_r")
    rest = cut.filter(F.col("length") < CAPACITY).join(placed, (F.col("_row") == F.col("_r")) & (F.col("piece") == F.col("_piece"))).drop("_r", "_piece")
    return full.unionByName(rest)


def packed_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every piece of every document with its place: key, keep, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, vocabulary, key, text, keep).withColumn("_at", F.monotonically_increasing_id())
    # a document's pieces are consecutive rows of one task: its row number is that of its first piece
    cut = written(cut.withColumn("_row", F.col("_at") - F.col("piece")).drop("_at"), "pieces")
    return packed(cut).drop("_row")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, read_vocabulary(path))
