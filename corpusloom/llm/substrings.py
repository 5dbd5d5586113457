"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 25 words, and every rolling window of 25
words of every document probes them: a passage of 50 words that two documents share holds a whole block
of each, so a probe of the other hits it. Hits are extended to the 50-word windows around them; the
hashes of those windows meet the same windows of other documents, each with the smallest doc_id it starts
in, which yields the maximal exact repeats without pairing documents. Words that a window with a smaller
first doc_id covers are removed.

Documents are dealt at random into groups by one shuffle. What groups exchange are sorted sets of hashes,
coded as differences, dealt by ranges of the hash: no passage, however common, brings more than one entry
per group to a task.

Defined edge cases: a null text has no words; a null doc_id is larger than any other; equal doc_ids do not
count as smaller; texts shorter than a window stay whole; words of any length and texts of any number of
words are treated whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, clean_text, mix, partitions, window_hashes

WINDOW = 50
BLOCK = WINDOW // 2
#: Groups per shuffle partition: a group is held in memory by one task.
GROUPS_PER_PARTITION = 4
_LAST = np.iinfo(np.int64).max
_PROBE_BITS = 32
_CHECK, _CHECK_BASE = np.uint64(0xA0761D6478BD642F), 0xE7037ED1A0B428DB


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, byte by byte of equal weight, which compresses well."""
    steps = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(steps), steps.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Group:
    """The word hashes of a group's texts, and their windows."""

    def __init__(self, texts: list[str]):
        self.words = Words(texts)
        self.first = self.words.first
        self.blocks, self.whole = self.words.windows(BLOCK)
        at = np.arange(len(self.blocks))
        self.doc = np.searchsorted(self.first, at, side="right") - 1
        self.aligned = self.whole & ((at - self.first[self.doc]) % BLOCK == 0) if len(at) else self.whole

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, check) of each 50-word window that holds a hit block, a hit being a block's start.

        Hash and check together are 128 bits: windows are equal if both are.
        """
        n = len(self.words.hash) - WINDOW + 1
        if n <= 0 or not len(hits):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        near = np.zeros(n + WINDOW + 1, dtype=np.int32)
        np.add.at(near, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
        np.add.at(near, hits + 1, -1)
        wanted = np.cumsum(near)[:n] > 0
        end = self.first[self.doc[:n] + 1]
        wanted &= np.arange(n) + WINDOW <= end
        start = np.flatnonzero(wanted)
        return start, window_hashes(self.words.hash, WINDOW)[start], window_hashes(mix(self.words.hash ^ _CHECK), WINDOW, _CHECK_BASE)[start]


def _bits(ranges: int) -> int:
    return max(1, (ranges - 1).bit_length())


def probes(ranges: int) -> Callable:
    """Of a group: for each hash range, the set of all probes, which of them are reference blocks, and which of those recur here."""
    b = _bits(ranges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf["text"].tolist())
        short = g.blocks[g.whole] >> np.uint64(64 - b - _PROBE_BITS)
        value, count = np.unique(short, return_counts=True)
        index = np.isin(value, g.blocks[g.aligned] >> np.uint64(64 - b - _PROBE_BITS))
        again = index & (count > 1)
        which = (value >> np.uint64(_PROBE_BITS)).astype(np.int64)
        low = value.astype(np.uint32)
        bounds = np.searchsorted(which, np.arange((1 << b) + 1))
        rows = [(r, int(pdf["_group"].iloc[0]), pack(low[s:e]), np.packbits(index[s:e]).tobytes(), np.packbits(again[s:e]).tobytes()) for r, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if e > s]
        return pd.DataFrame(rows, columns=["range", "_group", "probes", "index", "again"])

    return run


PROBES = "range int, _group int, probes binary, index binary, again binary"


def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a hash range: for each group, the reference blocks that some other place holds too."""
    sets = [unpack(x, np.uint32) for x in pdf["probes"]]
    sizes = np.array([len(x) for x in sets])
    value, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flag = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(pdf[c], sizes.tolist(), strict=True)]).astype(bool)
    index, again = flag("index"), flag("again")
    order = np.argsort(value, kind="stable")
    value, of, index, again = value[order], of[order], index[order], again[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    many = np.diff(np.concatenate([start, [len(value)]]))
    hit = np.logical_or.reduceat(index, start) & ((many > 1) | np.logical_or.reduceat(again, start))
    hit = np.repeat(hit, many)
    value, of = value[hit], of[hit]
    rows, r = [], int(pdf["range"].iloc[0])
    for i in np.unique(of).tolist():
        rows.append((int(pdf["_group"].iloc[i]), r, pack(value[of == i])))
    return pd.DataFrame(rows, columns=["_group", "range", "hits"])


ANCHORS = "_group int, range int, hits binary"


def _hit_positions(g: Group, found: pd.DataFrame, ranges: int) -> np.ndarray:
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    b = _bits(ranges)
    keys = np.unique(np.concatenate([unpack(x, np.uint32).astype(np.uint64) + (np.uint64(r) << np.uint64(_PROBE_BITS)) for r, x in zip(found["range"], found["hits"], strict=True)]))
    short = g.blocks >> np.uint64(64 - b - _PROBE_BITS)
    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
    return np.flatnonzero((keys[at] == short) & g.whole)


def _first_ids(start: np.ndarray, hashes: np.ndarray, checks: np.ndarray, g: Group, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (hash, check) in ascending order and the smallest doc_id of the group that each starts in."""
    own = ids[g.doc[start]]
    order = np.lexsort((own, checks, hashes))
    h, c, own = hashes[order], checks[order], own[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    return h[keep], c[keep], own[keep]


def _places(h: np.ndarray, c: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where each window (hashes, checks) stands among the ascending ones (h, c), all of which are there."""
    at = np.searchsorted(h, hashes)
    while len(off := np.flatnonzero(c[at] != checks)):
        at[off] += 1
    return at


def windows(ranges: int) -> Callable:
    """Of a group and its anchors: for each hash range, the extended windows with their smallest doc_id here."""
    b = _bits(ranges)

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(found):
            g = Group(docs["text"].tolist())
            h, c, own = _first_ids(*g.candidates(_hit_positions(g, found, ranges)), g, docs["_id"].to_numpy())
            bounds = np.searchsorted((h >> np.uint64(64 - b)).astype(np.int64), np.arange((1 << b) + 1))
            rows = [(r, int(docs["_group"].iloc[0]), pack(h[s:e]), c[s:e].tobytes(), planes(own[s:e])) for r, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if e > s]
        return pd.DataFrame(rows, columns=["range", "_group", "windows", "checks", "ids"])

    return run


WINDOWS = "range int, _group int, windows binary, checks binary, ids binary"


def first_places(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a hash range: for each group, the windows that start in a smaller doc_id of another group, with the smallest."""
    sets = [unpack(x, np.uint64) for x in pdf["windows"]]
    sizes = np.array([len(x) for x in sets])
    value, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    ids, check = np.concatenate([from_planes(x, np.int64) for x in pdf["ids"]]), np.frombuffer(b"".join(pdf["checks"]), dtype=np.uint64)
    order = np.lexsort((check, value))
    value, of, ids, check = value[order], of[order], ids[order], check[order]
    start = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (check[1:] != check[:-1])]))
    least = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.concatenate([start, [len(value)]])))
    told = least < ids
    value, of, least, check = value[told], of[told], least[told], check[told]
    rows = []
    for i in np.unique(of).tolist():
        mine = of == i
        rows.append((int(pdf["_group"].iloc[i]), pack(value[mine]), check[mine].tobytes(), planes(least[mine])))
    return pd.DataFrame(rows, columns=["_group", "windows", "checks", "ids"])


PLACES = "_group int, windows binary, checks binary, ids binary"


def covered(docs: pd.DataFrame, found: pd.DataFrame, places: pd.DataFrame, ranges: int) -> list[np.ndarray | None]:
    """Of each document of a group: which words go (None: none does)."""
    g, ids = Group(docs["text"].tolist()), docs["_id"].to_numpy()
    start, hashes, checks = g.candidates(_hit_positions(g, found, ranges))
    out: list[np.ndarray | None] = [None] * len(docs)
    if not len(start):
        return out
    h, c, least = _first_ids(start, hashes, checks, g, ids)
    if len(places):
        other = np.concatenate([unpack(x, np.uint64) for x in places["windows"]])
        theirs = np.concatenate([from_planes(x, np.int64) for x in places["ids"]])
        np.minimum.at(least, _places(h, c, other, np.frombuffer(b"".join(places["checks"]), dtype=np.uint64)), theirs)
    gone = start[least[_places(h, c, hashes, checks)] < ids[g.doc[start]]]
    marks = np.zeros(len(g.words.hash) + 1, dtype=np.int32)
    np.add.at(marks, gone, 1)
    np.add.at(marks, gone + WINDOW, -1)
    mask = np.cumsum(marks)[:-1] > 0
    for d in np.unique(g.doc[gone]).tolist():
        out[d] = mask[g.first[d] : g.first[d + 1]]
    return out


def without_repeats(docs: DataFrame, finish: Callable[[pd.DataFrame, list], pd.DataFrame], schema: str) -> DataFrame:
    """docs(doc_id, text) through the exchange of anchors and windows; finish makes rows of a block and its word masks."""
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    groups, ranges = n * GROUPS_PER_PARTITION, n
    # pandas would turn a long column with nulls into floats
    docs = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), F.col("doc_id").isNull().alias("_unknown"), "text")
    by = docs.withColumn("_group", F.pmod(F.xxhash64("_id", "text"), F.lit(groups)).cast("int")).repartition(n, "_group")
    probe = by.groupBy("_group").applyInPandas(probes(ranges), PROBES)
    found = probe.groupBy("range").applyInPandas(anchors, ANCHORS)
    window = by.groupBy("_group").cogroup(found.groupBy("_group")).applyInPandas(windows(ranges), WINDOWS)
    place = window.groupBy("range").applyInPandas(first_places, PLACES)
    told = found.select("_group", "range", F.col("hits").alias("windows"), F.lit(None).cast("binary").alias("checks"), F.lit(None).cast("binary").alias("ids"))
    told = told.unionByName(place.select("_group", F.lit(-1).alias("range"), "windows", "checks", "ids"))

    def last(part: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        part = part.assign(doc_id=part["_id"].astype("Int64").mask(part["_unknown"]))
        own = more["range"] >= 0
        return finish(part, covered(part, more[own].rename(columns={"windows": "hits"}), more[~own], ranges))

    return by.groupBy("_group").cogroup(told.groupBy("_group")).applyInPandas(last, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))

    def digest(part: pd.DataFrame, masks: list) -> pd.DataFrame:
        n, removed, sha = [], [], []
        for text, mask in zip(part["text"], masks, strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            removed.append(0 if mask is None else int(mask.sum()))
            if mask is not None:
                words = [words[i] for i in np.flatnonzero(~mask).tolist()]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pd.DataFrame({"doc_id": part["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": sha})

    return without_repeats(docs, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def brute_force(rows: list[tuple[int | None, str | None]]) -> Iterator[tuple[int | None, int, int, str]]:
    """The contract word for word, for tests."""
    key = lambda i: _LAST if i is None else i
    texts = [(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in texts:
        for p in range(len(w) - WINDOW + 1):
            x = tuple(w[p : p + WINDOW])
            first[x] = min(first.get(x, _LAST), key(i))
    for i, w in texts:
        gone: set[int] = set()
        for p in range(len(w) - WINDOW + 1):
            if first[tuple(w[p : p + WINDOW])] < key(i):
                gone.update(range(p, p + WINDOW))
        kept = [x for j, x in enumerate(w) if j not in gone]
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
