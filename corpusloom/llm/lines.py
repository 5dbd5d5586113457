"""Removal of near-equal lines.

Lines with a word are normalised (lower case, digits as 0, punctuation as space). Equal ones are copies. Different
lines are similar if their words' edit similarity is at least `SIMILARITY`. They meet on pigeonhole blocks of their
words: runs of `GRAM` words, of which an edit spoils `GRAM` at most. All runs being put in one order, each line meets
others on its first ones: on all that the similarity takes (the q-gram lemma), so no similar pair is missed, however
many edits it has. (`MEET`, where a caller sets it, stops at so many runs and misses some pairs.) The order puts runs that are frequent in a sample last. (A SimHash
of 64 bits cannot tell these pairs: see the README for its measured recall.) Of runs only keys and lines move at first; those
that one line has alone, most of them, go before lengths and sketches join. Lines that meet are a pair unless their
lengths or the parities of their words, occurrences told apart, rule the similarity out; the edit similarity of the words
is verified for pairs that connect all that met, then for all pairs that are not connected yet. Of each connected group of lines the first occurrence (by doc_id, text hash, line) stays and
the others are removed.

Defined edge cases: a null text has no lines; lines without a word stay; lines too short for an edit are alike only to
their copies; null doc_ids come last in order; rows with equal doc_id and text are one document that occurs twice and
lose the same lines; lines of any length are compared whole; a text whose lines all stay is returned as it was; other
columns pass through, but for one named `_lines_removed`, which the count replaces; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, clean_text, discarded, free_memory, id_again, known, mapped, mix, powers, shuffles_dropped, text_blocks, whole_row, window_hashes, written
from .graphs import Members, by_group, by_groups, components, local_roots

SIMILARITY, GRAM = 0.85, 3
#: Runs that a line meets others on at most; None: as many as the lemma takes, however long the line.
MEET: int | None = None
BLOCK_LINES = 1000
#: Levels by which the sketches of lines that met are finer than those that find who meets.
FINE = 2
#: Runs of words that meet in one part, on average about, and characters that have one such run.
PART_RUNS, RUN_CHARS = 500_000, 12
#: Frequent runs that the order puts last at most, and the part of the texts that is asked for them.
FREQUENT, SAMPLE = 50_000, 32
#: Bytes of text that one task normalises and hashes at a time.
_BLOCK = 400_000
#: Of each byte of a UTF-8 text: ASCII digits as 0, ASCII punctuation as space, all others themselves.
_PLAIN = bytes(48 if 48 <= c < 58 else 32 if 33 <= c < 128 and not chr(c).isalnum() else c for c in range(256))
_LINE_BASE = 0xC2B2AE3D27D4EB4F
#: Bits of a run's key, below those of the line's number in a block.
_KEY_BITS, _BLOCK_LINES = np.uint64(48), 1 << 16


def normalised(text: str) -> bytes:
    """Lower case, digits as 0, ASCII punctuation as spaces, in UTF-8; line feeds stay where they are."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def segment_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run hashes[first:last] that depends on the order."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_LINE_BASE, len(hashes))[: len(hashes)], out=sums[1:])
    back = powers(pow(_LINE_BASE, -1, 2**64), len(hashes) + 1)
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def lines_of(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the normalised texts; of each line with a word: text, number in it, first and last word."""
    w = Words([normalised(t) for t in texts])
    feeds = np.flatnonzero(np.frombuffer(w.data, dtype=np.uint8) == 10)
    row = np.searchsorted(feeds, w.start)  # the line, over all texts, that each word lies in
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:], [len(row)]]).astype(np.int64) if len(first) else first
    doc = np.searchsorted(w.text_start, w.start[first], side="right") - 1
    return w, doc, row[first] - np.searchsorted(feeds, w.text_start[doc]), first, last


def numbered(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of words, those that a row has had before told apart by how often: the same bag for words in any order."""
    both = mix(word + row.astype(np.uint64) * np.uint64(_LINE_BASE))
    order = np.argsort(both)
    both = both[order]
    at = np.arange(len(both))
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    again = np.flatnonzero(before)
    out = word.copy()
    out[order[again]] = mix(word[order[again]] + before[again].astype(np.uint64) * np.uint64(_LINE_BASE))
    return out


def parities(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, lanes: int) -> np.ndarray:
    """A row of 64 * lanes bits of each run of word hashes: whether the words of a bucket are odd in number.

    A word's first, second, ... occurrence in a line are different words, so that lines of few words, often repeated,
    fill as many buckets as others. A word put in, left out or exchanged changes one bit, one, or two at most (of a
    word it is the last occurrence that comes or goes). Of 2 * lanes lanes, lane i and lane i + lanes together give
    lane i of so many lanes.
    """
    n, bits = last - first, 64 * lanes
    row = np.repeat(np.arange(len(n)), n)
    word = numbered(row, hashes[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
    bit = (word >> np.uint64(58)) + np.uint64(64) * (word % np.uint64(lanes))
    odd = np.bincount(row * bits + bit.astype(np.int64), minlength=len(n) * bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, lanes)


def level_of(n: np.ndarray) -> np.ndarray:
    """Lines of up to 64 * 2^level words have 2^level lanes, so that random lines differ in more bits than edits allow."""
    return np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)


def sketched(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, fine: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(lanes of all lines one after the other, where each line's begin, with one more entry); 2^fine times as many as the level has."""
    level = level_of(last - first) + fine
    start = np.concatenate([[0], np.cumsum(1 << level)]).astype(np.int64)
    out = np.zeros(start[-1], dtype=np.uint64)
    for v in np.unique(level).tolist():
        at = np.flatnonzero(level == v)
        out[start[at][:, None] + np.arange(1 << v)] = parities(hashes, first[at], last[at], 1 << v)
    return out, start


def taken(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lanes lanes[start:start + size] of each entry, one after the other."""
    return lanes[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]


def edits(words: np.ndarray) -> np.ndarray:
    """Edits that lines of so many words, the longer of a pair, may have."""
    return np.floor((1 - SIMILARITY) * words).astype(np.int64)


def possible(n: np.ndarray, parity: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether lengths and parities of pairs of lines allow the similarity."""
    most, least = np.maximum(n, m), np.minimum(n, m)
    differ = np.bitwise_count(parity ^ other).sum(axis=-1, dtype=np.int64)
    return (least >= SIMILARITY * most) & (differ <= 2 * edits(most) - (most - least))


def runs_to_meet(n: np.ndarray) -> np.ndarray:
    """How many of its first runs a line of so many words meets others on; none if only its copies are similar.

    Lines of n and of N >= n words with k edits share N - GRAM + 1 - k * GRAM runs; n has n - GRAM + 1.
    """
    out = np.zeros(len(n), dtype=np.int64)
    enough = edits(n) * GRAM + 1 >= MEET if MEET is not None else np.zeros(len(n), dtype=bool)
    few = n[~enough]
    longest = int(few.max(initial=0) / SIMILARITY) + 1
    wanted = np.zeros(len(few), dtype=np.int64)
    for more in range(longest - int(few.min(initial=longest)) + 1):
        long = few + more
        can = (few >= SIMILARITY * long) & (edits(long) > 0)
        if more and not (few >= SIMILARITY * long).any():
            break
        wanted = np.where(can, np.maximum(wanted, edits(long) * GRAM - more + 1), wanted)
    out[~enough] = wanted
    if MEET is not None:
        out[enough] = MEET
        out = np.minimum(out, MEET)
    return np.minimum(out, np.maximum(n - GRAM + 1, 0))


_wanted: dict[tuple, int] = {}


def runs_wanted(n: np.ndarray) -> np.ndarray:
    """`runs_to_meet` of many lines, computed once for each length."""
    lengths, of = np.unique(n, return_inverse=True)
    names = [(MEET, x) for x in lengths.tolist()]
    if new := [x for x in names if x not in _wanted]:
        _wanted.update(zip(new, runs_to_meet(np.array([x for _, x in new])).tolist(), strict=True))
    return np.array([_wanted[x] for x in names], dtype=np.int64)[of]


class Order:
    """The order of all runs: those frequent in a sample last, the others by their hashes."""

    def __init__(self, frequent: np.ndarray):
        """frequent: hashes of runs, from the rarest on."""
        by = np.argsort(frequent)
        self.hash, self.rank = frequent[by], by.astype(np.uint64)
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def keys(self, runs: np.ndarray) -> np.ndarray:
        """A number of 48 bits for each run, in order."""
        out = runs >> np.uint64(17)
        maybe = np.flatnonzero(self.some[(runs >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hash, runs[maybe]), max(0, len(self.hash) - 1))
        hot = self.hash[place] == runs[maybe] if len(self.hash) else np.zeros(0, dtype=bool)
        at = maybe[hot]
        out[at] = np.uint64(1 << 47) | self.rank[place[hot]] << np.uint64(30) | runs[at] >> np.uint64(34)
        return out


def _runs(w: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of all runs of `GRAM` words in the lines."""
    count = np.maximum(last - first - GRAM + 1, 0)
    line = np.repeat(np.arange(len(first)), count)
    at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return line, window_hashes(w.hash, GRAM)[at] if len(line) else np.zeros(0, dtype=np.uint64)


def frequent_runs(docs: DataFrame) -> np.ndarray:
    """Hashes of the runs of words most frequent in a sample of the texts, from the rarest on: a fixed number at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch, "text", _BLOCK):
                w, _, _, first, last = lines_of(texts)
                run_hash, n = np.unique(_runs(w, first, last)[1], return_counts=True)
                yield pa.record_batch({"run": run_hash.astype(np.int64), "n": n.astype(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(SAMPLE)) == 0).select("text")
    counts = mapped(some, run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "run").limit(FREQUENT).select("run").collect()
    return np.array([r["run"] for r in found[::-1]], dtype=np.int64).astype(np.uint64)


def first_runs(w: Words, first: np.ndarray, last: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the different runs that the lines meet on."""
    lines, keys = [], []
    wanted = runs_wanted(last - first)
    some = np.flatnonzero(wanted)
    for lo in range(0, len(some), _BLOCK_LINES):
        at = some[lo : lo + _BLOCK_LINES]
        line, run = _runs(w, first[at], last[at])
        both = np.sort(line.astype(np.uint64) << _KEY_BITS | order.keys(run))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        line = (both >> _KEY_BITS).astype(np.int64)
        count = np.bincount(line, minlength=len(at))
        kept = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) < wanted[at][line]
        lines.append(at[line[kept]])
        keys.append(both[kept] & np.uint64((1 << 48) - 1))
    return (np.concatenate(lines), np.concatenate(keys)) if lines else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


#: A line's number of words beside its hash; a line on a run that it meets others on.
_LINE = np.dtype([("id", "i8"), ("n", "u4")])
_MET = np.dtype([("key", "u8"), ("id", "i8"), ("n", "u4")])
_TABLE = "_id long, _unknown boolean, text_hash long, line int, hash long, part int, one binary, two binary"
#: What the arrays `one` and `two` of a row hold, for one part of the lines: lines and sketches, lines and runs, lines and classes.
_LINES, _RUNS, _CLASSES = 0, 1, 2
_HELD = 300_000


def dealt(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places of its keys) of each part that has some."""
    part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    return [(p, order[s:e]) for p, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]


def squeezed(keys: np.ndarray) -> bytes:
    """Keys of 48 bits, all their highest bytes first: sorted ones compress well."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).astype(np.uint64)
    out = np.zeros(planes.shape[1], dtype=np.uint64)
    for p in planes:
        out = out << np.uint64(8) | p
    return out


def line_table(docs: DataFrame, parts: int) -> DataFrame:
    """Of docs(doc_id, text), a row for each line with a word (part is null) and rows with the lines that may be similar to others.

    A line: its document (_id, _unknown, text_hash), number and hash. A task sends the lines of one part, with their
    numbers of words and sketches, as two arrays, in which lines it has seen lately are not repeated.
    """
    schema = pa.schema([("_id", pa.int64()), ("_unknown", pa.bool_()), ("text_hash", pa.int64()), ("line", pa.int32()), ("hash", pa.int64()), ("part", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own, lanes = (np.concatenate(x) for x in zip(*found, strict=True))
        size = 1 << level_of(own["n"])
        start = np.cumsum(size) - size
        rows = [(p, own[at].tobytes(), taken(lanes, start[at], size[at]).tobytes()) for p, at in dealt(np.ascontiguousarray(own["id"]), parts)]
        none = [pa.nulls(len(rows), f.type) for f in list(schema)[:5]]
        return pa.record_batch([*none, pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        seen = np.zeros(0, dtype=np.int64)  # of the lines since the last arrays were sent
        for batch in batches:
            for part, texts in text_blocks(batch, "text", _BLOCK):
                w, doc, line, first, last = lines_of(texts)
                ids = segment_hashes(w.hash, first, last).astype(np.int64)
                of = pa.array(doc)
                yield pa.record_batch([part.column("_id").take(of), part.column("_unknown").take(of), part.column("text_hash").take(of), pa.array(line.astype(np.int32)), pa.array(ids), *(pa.nulls(len(ids), f.type) for f in list(schema)[5:])], schema=schema)
                fresh = np.unique(ids, return_index=True)[1]
                fresh = fresh[~np.isin(ids[fresh], seen) & (runs_wanted((last - first)[fresh]) > 0)]
                seen = np.concatenate([seen, ids[fresh]])
                own = np.zeros(len(fresh), dtype=_LINE)
                own["id"], own["n"] = ids[fresh], (last - first)[fresh]
                found.append((own, sketched(w.hash, first[fresh], last[fresh])[0]))
                held += len(own)
                if held > _HELD // 3:
                    yield packed(found)
                    found, held, seen = [], 0, seen[:0]
        if held:
            yield packed(found)

    return mapped(docs.select(*known("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, _TABLE)


def run_table(docs: DataFrame, parts: int) -> DataFrame:
    """(part, one, two): keys of the first runs of the lines of docs(text) and the lines' hashes, as arrays of one part of the keys."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_runs(docs))

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        rows = [(p, squeezed(key[at]), ids[at].tobytes()) for p, at in dealt(key, parts)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "one", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, found, held = Order(shared.value), [], 0
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, texts in text_blocks(batch, "text", _BLOCK):
                w, _, _, first, last = lines_of(texts)
                ids = segment_hashes(w.hash, first, last).astype(np.int64)
                fresh = np.unique(ids, return_index=True)[1]
                fresh = fresh[~np.isin(ids[fresh], seen)]
                seen = np.concatenate([seen, ids[fresh]])
                line, key = first_runs(w, first[fresh], last[fresh], order)
                found.append((key, ids[fresh][line]))
                held += len(key)
                if held > _HELD:
                    yield packed(found)
                    found, held, seen = [], 0, seen[:0]
        if held:
            yield packed(found)

    return mapped(docs.select("text"), run, "part int, one binary, two binary")


def shared_runs(table: DataFrame, parts: int) -> DataFrame:
    """Of `run_table`, what lines meet on: (part, kind, one, two), lines and keys that two or more lines have, by parts of the lines."""

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids = np.concatenate([unsqueezed(x) for x in pdf["one"]]), np.frombuffer(b"".join(pdf["two"]), dtype=np.int64)
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        order = some[np.lexsort((ids[some], key[some]))]
        key, ids = key[order], ids[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[new], ids[new]
        same = key[1:] == key[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, dtype=bool)
        key, ids = key[some], ids[some]
        return pd.DataFrame([(p, _RUNS, ids[at].tobytes(), squeezed(key[at])) for p, at in dealt(ids, parts)], columns=["part", "kind", "one", "two"])

    return by_group(table, ["part"], several, "part int, kind int, one binary, two binary")


def dealt_classes(classes: DataFrame, parts: int) -> DataFrame:
    """(part, kind, one, two) of classes(id, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of = (batch.column(c).to_numpy() for c in ("id", "component"))
            rows = [(p, ids[at].tobytes(), of[at].tobytes()) for p, at in dealt(ids, parts)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([_CLASSES] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "kind", "one", "two"])

    return mapped(classes.select("id", "component"), run, "part int, kind int, one binary, two binary")


def fine_lines(brought: DataFrame, parts: int) -> DataFrame:
    """(part, kind, one, two) of the lines brought(id, norm), with sketches of `FINE` levels more than `line_table` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, norms in text_blocks(batch, "norm", _BLOCK):
                w = Words(norms)
                own = np.zeros(len(norms), dtype=_LINE)
                own["id"], own["n"] = some.column("id").to_numpy(), np.diff(w.first)
                lanes, start = sketched(w.hash, w.first[:-1], w.first[1:], FINE)
                rows = [(p, own[at].tobytes(), taken(lanes, start[at], np.diff(start)[at]).tobytes()) for p, at in dealt(np.ascontiguousarray(own["id"]), parts)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([_LINES] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "kind", "one", "two"])

    return mapped(brought.select("id", "norm"), run, "part int, kind int, one binary, two binary")


def met_lines(known_of: DataFrame, parts: int, classed: bool = False) -> DataFrame:
    """(part, met, sketch, class) by parts of the keys: lines on the runs that they share, with lengths and sketches.

    known_of(part, kind, one, two), by parts of the lines. With classes, only lines that have one are taken; their
    sketches are those of `fine_lines`.
    """

    def attached(pdf: pd.DataFrame) -> pd.DataFrame | None:
        kind = pdf["kind"].to_numpy()
        rows = {k: pdf[kind == k] for k in (_LINES, _RUNS, _CLASSES)}
        if not len(rows[_RUNS]) or classed and not len(rows[_CLASSES]):
            return None
        own = np.frombuffer(b"".join(rows[_LINES]["one"]), dtype=_LINE)
        lanes = np.frombuffer(b"".join(rows[_LINES]["two"]), dtype=np.uint64)
        size = 1 << level_of(own["n"]) + FINE * classed
        start = np.cumsum(size) - size
        names, at = np.unique(own["id"], return_index=True)
        ids = np.frombuffer(b"".join(rows[_RUNS]["one"]), dtype=np.int64)
        key = np.concatenate([unsqueezed(x) for x in rows[_RUNS]["two"]])
        of = None
        if classed:
            have = np.frombuffer(b"".join(rows[_CLASSES]["one"]), dtype=np.int64)
            component = np.frombuffer(b"".join(rows[_CLASSES]["two"]), dtype=np.int64)
            order = np.argsort(have)
            have, component = have[order], component[order]
            place = np.minimum(np.searchsorted(have, ids), len(have) - 1)
            some = have[place] == ids
            ids, key, of = ids[some], key[some], component[place[some]]
        at = at[np.searchsorted(names, ids)]
        met = np.zeros(len(ids), dtype=_MET)
        met["key"], met["id"], met["n"] = key, ids, own["n"][at]
        out = [(p, met[x].tobytes(), taken(lanes, start[at[x]], size[at[x]]).tobytes(), of[x].tobytes() if of is not None else b"") for p, x in dealt(key, parts)]
        return pd.DataFrame(out, columns=["part", "met", "sketch", "class"])

    return by_group(known_of, ["part"], attached, "part int, met binary, sketch binary, class binary")


def near_lines(met: DataFrame, classed: bool = False) -> DataFrame:
    """Pairs (a, b, differ) of hashes of lines, a < b, of met(part, met, sketch, class), that share a run and are not ruled out.

    Without classes, of each part as many as connect all that such pairs connect; with classes, all pairs of two classes.
    differ: in how many bits of their sketches they do.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        of = np.frombuffer(b"".join(pdf["class"]), dtype=np.int64)
        return _meet(np.frombuffer(b"".join(pdf["met"]), dtype=_MET), np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint64), of if classed else None)

    return by_group(met, ["part"], meet, "a long, b long, differ int").distinct()


class Sketches:
    """The sketches of lines, for comparisons at any level that a line has."""

    def __init__(self, lanes: np.ndarray, start: np.ndarray, level: np.ndarray):
        self.level, self.at, self.rows = level, {}, {}
        for v in np.unique(level).tolist():
            own, longer = np.flatnonzero(level == v), np.flatnonzero(level == v + 1)
            halves = lanes[start[longer][:, None] + np.arange(2 << v)]
            self.rows[v] = np.concatenate([lanes[start[own][:, None] + np.arange(1 << v)], halves[:, : 1 << v] ^ halves[:, 1 << v :]])
            self.at[v] = np.zeros(len(level), dtype=np.int64)
            self.at[v][np.concatenate([own, longer])] = np.arange(len(own) + len(longer))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of lines i and j, whose levels differ by one at most, do."""
        low, out = np.minimum(self.level[i], self.level[j]), np.zeros(len(i), dtype=np.int64)
        for v in np.unique(low).tolist():
            some = np.flatnonzero(low == v)
            a, b = self.rows[v][self.at[v][i[some]]], self.rows[v][self.at[v][j[some]]]
            out[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of edges (i, j) of n nodes, from the best on: the places of those of the best spanning forest."""
    chosen, root, left = np.zeros(len(i), dtype=bool), np.arange(n), np.arange(len(i))
    while len(left := left[root[i[left]] != root[j[left]]]):
        best = np.full(n, len(i))
        np.minimum.at(best, root[i[left]], left)
        np.minimum.at(best, root[j[left]], left)
        chosen[best[best < len(i)]] = True
        root = local_roots(n, i[chosen], j[chosen])
    return np.flatnonzero(chosen)


def _meet(met: np.ndarray, lanes: np.ndarray, classes: np.ndarray | None = None) -> pd.DataFrame:
    """Of lines that meet on keys, the pairs of one key that are not ruled out: a spanning forest, the closest first, or all of two classes."""
    fine = FINE if classes is not None else 0
    size = 1 << level_of(met["n"]) + fine
    start = np.cumsum(size) - size
    order = np.lexsort((met["id"], met["n"], met["key"]))
    met, start = met[order], start[order]
    ids, line = np.unique(met["id"], return_inverse=True)
    of = classes[order] if classes is not None else None
    key, n = np.ascontiguousarray(met["key"]), met["n"].astype(np.int64)
    lengths = np.zeros(len(ids), dtype=np.int64)
    lengths[line] = n
    sketches = Sketches(lanes, start, level_of(n) + fine)
    root = np.arange(len(ids)) if of is None else np.unique(of, return_inverse=True)[1]  # of a line, or of an entry's class
    pairs, held = [np.zeros((3, 0), dtype=np.int64)], 0

    def fewer() -> np.ndarray:
        differ, i, j = np.concatenate(pairs, axis=1)
        both = i * len(ids) + j
        _, first = np.unique(both, return_index=True)
        differ, i, j = differ[first], i[first], j[first]
        if of is None:  # all parts take the same of equally close pairs
            tie = mix(ids[i].view(np.uint64) ^ mix(ids[j].view(np.uint64)))
            best = np.lexsort((tie, differ))
            some = best[forest(len(ids), i[best], j[best])]
            differ, i, j = differ[some], i[some], j[some]
        return np.stack([differ, i, j])

    at, step = np.arange(len(met)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (n[at] >= SIMILARITY * n[at + step])]  # sorted: further ones are longer still
        if of is None and step >= 8 and step & (step - 1) == 0:
            # lines that much closer ones connect here need no more comparisons: what fails of those is left to the classes
            differ, i, j = np.concatenate(pairs, axis=1)
            pairs = [np.stack([differ, i, j])]
            most, least = np.maximum(lengths[i], lengths[j]), np.minimum(lengths[i], lengths[j])
            sure = 4 * differ <= 3 * (2 * edits(most) - (most - least))
            root = local_roots(len(ids), i[sure], j[sure])
        of_line = root if of is not None else root[line]
        now = at[of_line[at] != of_line[at + step]]
        differ = sketches.differ(now, now + step)
        close = differ <= 2 * edits(n[now + step]) - (n[now + step] - n[now])
        i, j = line[now[close]], line[now[close] + step]
        pairs.append(np.stack([differ[close], np.minimum(i, j), np.maximum(i, j)]))
        held += len(i)
        if held > 2 * len(ids) + 1_000_000:
            pairs = [fewer()]
            held = pairs[0].shape[1] if of is None else 0
    differ, i, j = fewer()
    return pd.DataFrame({"a": ids[i], "b": ids[j], "differ": differ.astype(np.int32)})


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, column by column in the bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = place.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        add, sub = down | ~(diagonal | up) & full, diagonal & up
        if add & top:
            score += 1
        elif sub & top:
            score -= 1
        add, sub = (add << 1 | 1) & full, sub << 1 & full
        up, down = sub | ~(diagonal | add) & full, add & diagonal
    return score


def similar(a: np.ndarray | list, b: np.ndarray | list, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two lists of words, or of their hashes, is at least so much."""
    n, m = max(len(a), len(b)), min(len(a), len(b))
    if m < least * n:
        return False
    a, b = np.asarray(a), np.asarray(b)
    # what both begin and end with costs nothing
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[len(a) - m + head :][::-1] != b[len(b) - m + head :][::-1])
    rest = int(differ[0]) if len(differ) else m - head
    return edit_distance(a[head : len(a) - rest].tolist(), b[head : len(b) - rest].tolist()) <= (1 - least) * n


def verified(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Of groups of lines (a, slot), those that are similar to the line a."""
    centre, ids, group = pdf["a"].to_numpy(), pdf["id"].to_numpy(), pdf[["a", "slot"]].to_numpy()
    w = Words(pdf["norm"].tolist())
    n, parity, first = np.diff(w.first), parities(w.hash, w.first[:-1], w.first[1:], 4), w.first.tolist()
    begin = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
    one = np.repeat(np.flatnonzero(ids == centre), np.diff(np.append(begin, len(pdf))))  # each group has its centre
    may = np.flatnonzero((ids != centre) & possible(n, parity, n[one], parity[one]))
    near = [i for i, c in zip(may.tolist(), one[may].tolist(), strict=True) if similar(w.hash[first[c] : first[c + 1]], w.hash[first[i] : first[i + 1]])]
    return pd.DataFrame({"a": centre[near], "b": ids[near]}) if near else None


def similar_pairs(pairs: DataFrame, brought: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose lines brought(id, norm) are similar. A line that many others met goes to as many tasks as blocks of them."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_LINES)).cast("int").alias("slots"))
    sent = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), F.col("b").alias("id"))
    # a slot that got no line has its centre alone
    sent = sent.unionByName(slots.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("a").alias("id")))
    return by_groups(sent.join(brought, "id").select("a", "slot", "id", "norm"), ["a", "slot"], verified, "a long, b long", ["id"])


def line_classes(docs: DataFrame, lines: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """(id, component): the connected groups of similar lines.

    First only as many of the pairs that met are verified as connect them all; then all pairs of lines that are not
    connected by similar ones yet, which finer sketches rule out more of. Where these are more than the lines, the
    closest of each line come first, then four times as many each round, without those connected meanwhile. So a group
    of lines that are all alike is work linear in its lines.
    """
    own = table.filter("part is not null").select("part", F.lit(_LINES).alias("kind"), "one", "two")
    runs = written(shared_runs(run_table(docs, parts), parts), "shared-runs")
    pairs = written(near_lines(met_lines(own.unionByName(runs), parts)), "near-lines")
    wanted = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted-lines")
    brought = written(_cut_lines(docs, lines, wanted), "cut-lines")
    near = written(similar_pairs(pairs, brought), "similar-lines")
    groups = written(components(near), "line-groups")
    # every line that met a similar one may do: those without a group are one by themselves
    every = wanted.join(groups.withColumnRenamed("id", "g"), F.col("id") == F.col("g"), "left").select("id", F.coalesce("component", "id").alias("component"))
    fine = fine_lines(brought, parts)
    met = met_lines(fine.unionByName(runs).unionByName(dealt_classes(every, parts)), parts, True)
    left = written(near_lines(met, True).join(pairs, ["a", "b"], "left_anti"), "near-lines")
    classes, few, k = groups, wanted.count(), 1
    while n := left.count():
        ranked = left.withColumn("turn", F.row_number().over(Window.partitionBy("b").orderBy("differ", "a")) if n > few else F.lit(0))
        close = written(similar_pairs(ranked.filter(F.col("turn") <= k).select("a", "b"), brought), "similar-lines")
        if not close.isEmpty():
            near = near.unionByName(close)
            classes = written(components(near), "line-classes")
        if n <= few:
            break
        of = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"{side}_class"))
        rest = ranked.filter(F.col("turn") > k).join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = F.coalesce("a_class", "a") != F.coalesce("b_class", "b")
        before, left, k = left, written(rest.filter(apart).select("a", "b", "differ"), "near-lines"), 4 * k
        discarded(before)
    for t in (runs, pairs, wanted, brought, left):
        discarded(t)
    return classes


def removed_lines(docs: DataFrame) -> DataFrame:
    """(_id, _unknown, text_hash, lines): numbers of the lines that go, of each document of docs(doc_id, text) that loses some."""
    with shuffles_dropped(docs.sparkSession):
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(1, -(-chars // (RUN_CHARS * PART_RUNS)))
        table = written(line_table(docs, parts), "lines")
        lines = table.filter("part is null").drop("part", "one", "two")
        classes = line_classes(docs, lines, table, parts)
        place = F.struct("_unknown", "_id", "text_hash", "line")
        unique = lines.groupBy("hash").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
        named = unique.join(classes, F.col("hash") == F.col("id"), "left").filter("n > 1 or id is not null")
        named = written(named.select("hash", F.coalesce("component", "hash").alias("class"), "place", "n"), "copied-lines")
        first = named.groupBy("class").agg(F.min("place").alias("first"), F.sum("n").alias("all")).filter("all > 1")
        kept = named.select("hash", "class").join(first, "class").select(F.col("hash").alias("k"), "first")
        going = lines.join(kept, F.col("hash") == F.col("k")).filter(place != F.col("first"))
        gone = written(going.groupBy("_id", "_unknown", "text_hash").agg(F.collect_set("line").alias("lines")), "removed-lines")
    for t in (table, classes, named):
        discarded(t)
    return gone


def _cut_lines(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, norm): the normalised lines of wanted(id), each once.

    The lines are cut out where the texts lie: filters of bounded size tell which texts hold wanted lines and
    which of their lines these are, so only lines move, not texts.
    """
    places = lines.join(wanted, F.col("hash") == F.col("id"), "left_semi").groupBy("hash").agg(F.min(F.struct("_id", "text_hash")).alias("place"))
    texts, hashes = Members(places.select(F.xxhash64("place._id", "place.text_hash").alias("k")), "k"), Members(wanted, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = texts.have(batch.column("k").to_numpy())
            for _, some in text_blocks(batch.filter(pa.array(holds)), "text", _BLOCK):
                w, _, _, first, last = lines_of(some)
                ids = segment_hashes(w.hash, first, last).astype(np.int64)
                at = np.flatnonzero(hashes.have(ids)) if len(ids) else np.zeros(0, dtype=np.int64)
                begin, end = w.start[first[at]].tolist(), w.end[last[at] - 1].tolist()
                yield pa.record_batch({"id": pa.array(ids[at]), "norm": pa.array([w.data[b:e] for b, e in zip(begin, end, strict=True)], pa.binary())})

    keyed = docs.select("text", F.xxhash64(known("doc_id")[0], F.xxhash64("text")).alias("k"))
    found = mapped(keyed, cut, "id long, norm binary").dropDuplicates(["id"])
    return found.join(wanted, "id", "left_semi")


def without_copied_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns and rows, with the copied lines cut out of the text; `_lines_removed` counts them."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), clean_text(docs, text).alias("text"))
    gone = removed_lines(plain).select(id_again("gone_id"), F.col("text_hash").alias("gone_hash"), "lines")
    given = docs.select(whole_row(docs), F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(clean_text(docs, text)).alias("hash"))
    both = given.join(gone, (F.col("hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, some in zip(texts, gone, strict=True):
            drop = set(some) if some is not None else ()
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if drop else t)
        free_memory()
        return pd.Series(out, dtype=object)

    old, loses = F.col(f"row.`{text}`"), F.col("lines").isNotNull()
    new = F.when(loses, cut(F.when(loses, old), F.col("lines"))).otherwise(old)  # only texts that lose lines go to Python
    names = [c for c in docs.columns if c.lower() != "_lines_removed"]
    return both.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in names), F.coalesce(F.size("lines"), F.lit(0)).alias("_lines_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_copied_lines(docs.withColumn("n_lines", F.size(F.split(clean_text(docs), "\n", -1)).cast("long")))
    gone = F.col("_lines_removed").cast("long")
    return out.select("doc_id", (F.col("n_lines") - gone).alias("n_lines_kept"), gone.alias("n_lines_removed"), F.sha2(clean_text(out).cast("binary"), 256).alias("kept_sha256"))
