"""Document fingerprints by a randomised edit embedding.

All texts walk over one shared table of random bits, a bit for each step and character class: at each
step the walk emits the character it stands on and, if the bit is one, moves to the next. Two texts walk
alike while they agree, and after an edit they soon fall into step again, so texts at a small edit
distance have embeddings at a small Hamming distance. A fingerprint samples each embedding at shared
steps, one in each block of 2^d steps, where d is the least that leaves at most `SAMPLES` of them; the
steps of a coarser level are some of those of a finer one, so texts of any lengths compare, and the
samples cover a text from its first to its last character. A sample keeps four bits of a hash of the few
characters from its step's character on. The likeness of two fingerprints is the share of steps they
agree on, corrected for chance, as a mean over `WALKS` walks.

Near copies: samples at shared random steps form bands; each band orders all texts by its samples, texts next to each
other that agree on enough of them meet, and the edit distance of the whole texts decides. `near_classes` gives groups,
in work linear in the texts; `near_documents` also counts the links inside each group.

Defined edge cases: a null text is empty; an empty text has a fingerprint without samples, like only to
itself; texts of any length are walked whole; rows with equal doc_ids are ordered by a hash of the text,
null doc_ids come last in descending order; a single row is its own next one; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, discarded, id_again, known, mapped, mix, partitions, shuffles_dropped, text_blocks, window_hashes, written
from .graphs import Members, block_pairs, by_groups, components, local_roots
from .lines import edit_distance

WALKS, SAMPLES, GRAM = 2, 128, 4
_CLASSES, _PERIOD = 64, 4096
_NARROW = 48
_BLOCK = 2_000_000
#: Near copies: most edits a character of the longer text; bands of a walk at a level, samples that neighbours share at least.
EDITS, BANDS, BAND = 0.1, 16, 4
#: Bands whose neighbours are compared first; all pairs of all bands follow where texts are in different classes.
FIRST_BANDS = 4
#: Texts before it, in the order of each table of bands, that a text meets if they agree on so many of the 32 samples
#: carried along; two unrelated texts that agree on the first four do so with a probability of about 0.001.
NEIGHBOURS, AGREE = 2, 11
BLOCK_TEXTS = 128
#: Code points of the runs that align two texts.
ANCHOR = 12
#: Up to so many characters the edit distance is computed whole.
SHORT = 4_000


def _waits(seed: int) -> np.ndarray:
    """waits[class, step]: steps from here on until the walk has left a character of that class."""
    bits = np.random.default_rng(seed).integers(0, 2, (_CLASSES, _PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.empty((_CLASSES, _PERIOD), dtype=np.int64)
    out[:, -1] = 1
    for j in range(_PERIOD - 2, -1, -1):
        out[:, j] = np.where(bits[:, j] == 1, 1, out[:, j + 1] + 1)
    return out


_WAITS = [_waits(9001 + w) for w in range(WALKS)]
_FLAT = [np.ascontiguousarray(w.ravel()) for w in _WAITS]
_LISTS = [w.tolist() for w in _WAITS]


def walk(classes: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """For texts laid end to end in `classes`: the step at which walk w leaves each character, from each text's start step."""
    left = np.zeros(len(classes), dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    at, length, now = begin[order], size[order], start[order].astype(np.int64)
    alive = len(order)
    flat, p = _FLAT[w], 0
    while alive and length[0] > p:
        alive = int(np.searchsorted(-length, -p, side="left"))
        if alive < _NARROW:
            break
        stop = int(length[alive - 1])  # all that are alive last so long
        here, t = at[:alive] + p, now[:alive]
        for _ in range(p, stop):
            t = t + flat[classes[here].astype(np.int64) * _PERIOD + (t & (_PERIOD - 1))]
            left[here] = t
            here += 1
        now[:alive] = t
        p = stop
    for i in range(alive if alive < _NARROW else 0):
        if length[i] > p:
            rows, t, out = _LISTS[w], int(now[i]), []
            for c in classes[at[i] + p : at[i] + length[i]].tolist():
                t += rows[c][t & (_PERIOD - 1)]
                out.append(t)
            left[at[i] + p : at[i] + length[i]] = out
    return left


def _bit(level: int, block: np.ndarray) -> np.ndarray:
    return mix(block.astype(np.uint64) * np.uint64(64) + np.uint64(level)) & np.uint64(1)


def descend(block: np.ndarray, level: int, to: int) -> np.ndarray:
    """The block of level `to` that stands for each block of a coarser level."""
    block = block.astype(np.uint64)
    for v in range(level, to, -1):
        block = block * np.uint64(2) + _bit(v, block)
    return block


_steps: dict[int, np.ndarray] = {}


def steps(level: int) -> np.ndarray:
    """The sampled steps of the first 2 * SAMPLES blocks of a level."""
    if level not in _steps:
        _steps[level] = descend(np.arange(2 * SAMPLES + 2), level, 0).astype(np.int64)
    return _steps[level]


_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
_GRAM = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(GRAM)], dtype=np.uint64)


def sampled(codes: np.ndarray, left: np.ndarray) -> str:
    """The fingerprint of one walk: level and a hexadecimal digit for each sampled step."""
    total = int(left[-1]) if len(left) else 0
    level = 0
    while -(-total >> level) > SAMPLES:
        level += 1
    s = steps(level)
    s = s[: np.searchsorted(s, total)]
    if not len(s):
        return f"{level:x}."
    i = np.searchsorted(left, s, side="right")
    h = np.zeros(len(s), dtype=np.uint64)
    padded = np.concatenate([codes, np.zeros(GRAM, dtype=codes.dtype)])
    for j in range(GRAM):
        h += padded[i + j].astype(np.uint64) * _GRAM[j]
    return f"{level:x}." + _DIGITS[(mix(h) >> np.uint64(60)).astype(np.int64)].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Share of sampled steps on which two fingerprints agree, corrected for chance: 1 for equal ones, about 0 for unrelated texts."""
    if a == b:
        return 1.0
    total = 0.0
    for x, y in zip(a.split("-"), b.split("-"), strict=True):
        (lx, sx), (ly, sy) = x.split("."), y.split(".")
        level = max(int(lx, 16), int(ly, 16))
        px, py = (_coarse(s, int(v, 16), level) for v, s in ((lx, sx), (ly, sy)))
        n, m = max(len(px), len(py)), min(len(px), len(py))
        if n:
            agree = int((px[:m] == py[:m]).sum()) / n
            total += max(0.0, (agree - 1 / 16) / (1 - 1 / 16))
    return total / WALKS


def _coarse(samples: str, level: int, to: int) -> np.ndarray:
    have = np.frombuffer(samples.encode(), dtype=np.uint8)
    if level == to:
        return have
    i = descend(np.arange(len(have) // (1 << (to - level)) + 1), to, level).astype(np.int64)
    return have[i[i < len(have)]]


def fingerprints(texts: list[str], after: list[str] | None = None) -> tuple[list[str], list[str], list[str]]:
    """(fingerprints, edited texts, their fingerprints). Edited: the last half replaced by as much of the head of `after`.

    The edited text's walk goes on from the step at which the kept half ends.
    """
    n = np.array([len(t) for t in texts], dtype=np.int64)
    half = n // 2
    heads = [t[:h] for t, h in zip(after, half.tolist(), strict=True)] if after is not None else []
    codes, begin = _codes(texts)
    head_codes, head_begin = _codes(heads)
    classes, head_classes = _classes(codes), _classes(head_codes)
    keep, head_n = n - half, np.array([len(h) for h in heads], dtype=np.int64)
    own: list[list[str]] = [[] for _ in texts]
    edited: list[list[str]] = [[] for _ in heads]
    for w in range(WALKS):
        left = walk(classes, begin, n, np.zeros(len(n), dtype=np.int64), w)
        for i in range(len(texts)):
            own[i].append(sampled(codes[begin[i] : begin[i] + n[i]], left[begin[i] : begin[i] + n[i]]))
        if heads:
            before = np.where(keep > 0, left[np.maximum(begin + keep - 1, 0)] if len(left) else 0, 0)
            more = walk(head_classes, head_begin, head_n, before, w)
            for i in range(len(heads)):
                b, k, hb = begin[i], keep[i], head_begin[i]
                edited[i].append(sampled(np.concatenate([codes[b : b + k], head_codes[hb : hb + head_n[i]]]), np.concatenate([left[b : b + k], more[hb : hb + head_n[i]]])))
    return ["-".join(x) for x in own], [t[:k] + h for t, k, h in zip(texts, keep.tolist(), heads, strict=False)], ["-".join(x) for x in edited]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return codes, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64)


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column; no shuffle."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([f for block in _blocks(texts.tolist()) for f in fingerprints(block)[0]], dtype=object)

    return docs.withColumn(column, prints(clean_text(docs, text)))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) range-partitioned and sorted by descending doc_id, each partition closed by the row that follows it (`_ghost`).

    The bounds are quantiles of doc_id; only they and the first row's key of each part reach the driver.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []), reverse=True)

    # rows without an id come last, in as many parts as their number takes, by the tie
    rows, unknown = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    last = max(1, -(-n * unknown // max(1, rows)))
    before = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    behind = F.least(F.lit(last - 1), F.floor((F.lit(2.0**63) - F.col("_tie").cast("double")) / F.lit(2.0**64) * last).cast("int"))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + behind).otherwise(before).cast("int")

    placed = docs.withColumn("_part", part).withColumn("_ghost", F.lit(0))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")
    first = sorted(docs.select("doc_id", "_tie", part.alias("_part")).groupBy("_part").agg(F.max(key).alias("k")).collect(), key=lambda r: r["_part"])
    if not first:
        return placed
    # the row that follows a part is the first of the next one; after the last comes the first of all
    ghosts = [(a["_part"], b["k"]["doc_id"], b["k"]["_tie"]) for a, b in zip(first, first[1:] + first[:1], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(ghosts, "_part int, g_id long, g_tie long"))  # at most one row a partition
    ghost = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["g_id"]) & (docs["_tie"] == wanted["g_tie"])).select("doc_id", "text", "_tie", "_part", F.lit(1).alias("_ghost"))
    both = placed.select("doc_id", "text", "_tie", "_part", "_ghost").unionByName(ghost)
    return both.repartitionById(len(bounds) + 1 + last, F.col("_part")).sortWithinPartitions("_part", "_ghost", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of docs(doc_id, text) and its edited text, with likenesses to it and to the next document; text_hash: its xxhash64."""

    def rows(ids: list, ties: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        own, edited, edited_prints = fingerprints(texts, after)
        next_print = fingerprints(after[-1:])[0][0]
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "text_hash": pa.array(ties, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": own,
                "edited_fingerprint": edited_prints,
                "near_edited": [likeness(a, b) for a, b in zip(own, edited_prints, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own, [*own[1:], next_print], strict=True)],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        ties: list = []
        texts: list[str] = []
        size, part, closed = 0, None, False
        for batch in batches:
            for block, found in text_blocks(batch, "text", _BLOCK):
                for doc_id, tie, text, p, ghost in zip(block.column("doc_id").to_pylist(), block.column("_tie").to_pylist(), found, block.column("_part").to_pylist(), block.column("_ghost").to_pylist(), strict=True):
                    if p != part:
                        part, closed = p, False
                    if ghost:
                        if not closed and ids:
                            yield rows(ids, ties, texts, [*texts[1:], text])
                        ids, ties, texts, size, closed = [], [], [], 0, True
                        continue
                    if size > _BLOCK:
                        yield rows(ids, ties, texts, [*texts[1:], text])
                        ids, ties, texts, size = [], [], [], 0
                    ids.append(doc_id)
                    ties.append(tie)
                    texts.append(text)
                    size += len(text)

    return mapped(in_order(docs), run, "doc_id long, text_hash long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_rng = np.random.default_rng(41)
_ORDERS = [[_rng.permutation(2 * SAMPLES + 2) for _ in range(BANDS)] for _ in range(WALKS)]
_PLACE = np.uint64(1) << np.arange(60, -4, -4, dtype=np.uint64)
_DIGIT = np.zeros(256, dtype=np.uint64)
_DIGIT[_DIGITS] = np.arange(16, dtype=np.uint64)


def bands(fingerprint: str) -> np.ndarray:
    """Columns (table, key, more), one for each band of a fingerprint, at its own level and the next coarser one, which texts of near lengths share.

    key holds the first 16 samples of the band's order of steps, the first in its highest bits; more holds the next 16.
    """
    out = []
    for w, part in enumerate(fingerprint.split("-")):
        level, samples = part.split(".")
        for v in (int(level, 16), int(level, 16) + 1):
            some = _coarse(samples, int(level, 16), v)
            for b, order in enumerate(_ORDERS[w] if len(some) else []):
                digits = np.zeros(2 * len(_PLACE), dtype=np.uint64)
                taken = some[order[order < len(some)][: len(digits)]]
                digits[: len(taken)] = _DIGIT[taken]
                key, more = (digits.reshape(2, -1) * _PLACE).sum(axis=1, dtype=np.uint64)
                out.append(((v * WALKS + w) * BANDS + b, key, more))
    return np.array(out, dtype=np.uint64).reshape(-1, 3).T.view(np.int64)


_taken: dict[tuple, np.ndarray] = {}


def _band_places(w: int, n: int) -> np.ndarray:
    """Of n samples of walk w: those that each band takes, n where there are no more."""
    if (w, n) not in _taken:
        size = 2 * len(_PLACE)
        own = [order[order < n][:size] for order in _ORDERS[w]]
        _taken[w, n] = np.array([np.append(x, np.full(size - len(x), n)) for x in own], dtype=np.int64)
    return _taken[w, n]


def bands_of(prints: list[str], count: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the fingerprint, table, key, more) of the first `bands` of each walk of many fingerprints, those of one level and size at once."""
    out = [np.zeros((4, 0), dtype=np.int64)]
    for w in range(WALKS):
        alike: dict[tuple[int, int], list[int]] = {}
        parts = [x.split("-")[w].split(".") for x in prints]
        for i, (level, samples) in enumerate(parts):
            alike.setdefault((int(level, 16), len(samples)), []).append(i)
        for (level, n), rows in alike.items():
            for lo in range(0, len(rows) if n else 0, 2000):
                at = np.array(rows[lo : lo + 2000])
                own = _DIGIT[np.frombuffer("".join(parts[i][1] for i in at.tolist()).encode(), dtype=np.uint8)].reshape(len(at), n)
                coarse = descend(np.arange(n // 2 + 1), level + 1, level).astype(np.int64)
                for v, some in ((level, own), (level + 1, own[:, coarse[coarse < n]])):
                    if not some.shape[1]:
                        continue
                    digits = np.concatenate([some, np.zeros((len(at), 1), dtype=np.uint64)], axis=1)[:, _band_places(w, some.shape[1])[:count]]
                    key, more = ((digits[:, :, h] * _PLACE).sum(axis=2, dtype=np.uint64).view(np.int64) for h in (slice(0, len(_PLACE)), slice(len(_PLACE), None)))
                    table = np.broadcast_to((v * WALKS + w) * BANDS + np.arange(count), key.shape)
                    out.append(np.stack([np.repeat(at, count), table.ravel(), key.ravel(), more.ravel()]))
    return tuple(np.concatenate(out, axis=1))


def banded(prints: DataFrame, count: int = BANDS) -> DataFrame:
    """(table, key, more, id, class, n_chars) of prints(id, fingerprint, class, n_chars), by the parts of a table that share its first `BAND` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, table, key, more = bands_of(batch.column("fingerprint").to_pylist(), count)
            of = pa.array(of)
            yield pa.record_batch([pa.array(table.astype(np.int32)), pa.array(key), pa.array(more), batch.column("id").take(of), batch.column("class").take(of), batch.column("n_chars").take(of)], names=["table", "key", "more", "id", "class", "n_chars"])

    each = mapped(prints.select("id", "fingerprint", "class", F.col("n_chars").cast("long")), run, "table int, key long, more long, id long, class long, n_chars long")
    return each.repartition(max(1, partitions(prints.sparkSession)), "table", F.shiftright("key", 64 - 4 * BAND))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """On how many of their 16 samples each pair of integers agrees."""
    differ = (x ^ y).view(np.uint64)
    differ = (differ | differ >> np.uint64(1) | differ >> np.uint64(2) | differ >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return 16 - np.bitwise_count(differ).astype(np.int64)


def met_pairs(prints: DataFrame, count: int = BANDS) -> DataFrame:
    """(a, b, times): ids of prints(id, fingerprint) that lie next to each other in so many tables of bands (the first of each walk), a < b.

    A table orders all texts by the band's samples; a text meets the `NEIGHBOURS` before it, if they agree on the first
    `BAND` samples and on `AGREE` of all. So the work is linear however many texts share a band, and with more texts
    neighbours agree on more samples.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            table, key, more, ids = (np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("table", "key", "more", "id"), strict=True))
            prefix = key >> (64 - 4 * BAND)
            for back in range(1, NEIGHBOURS + 1):
                first = max(len(held[0]), back)
                now, before = slice(first, None), slice(first - back, len(ids) - back)
                same = (table[now] == table[before]) & (prefix[now] == prefix[before]) & (ids[now] != ids[before])
                same[same] = agreeing(key[now][same], key[before][same]) + agreeing(more[now][same], more[before][same]) >= AGREE
                x, y = ids[now][same], ids[before][same]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            held = [x[-NEIGHBOURS:] for x in (table, key, more, ids)]

    placed = banded(prints.select("id", "fingerprint", F.lit(0).cast("long").alias("class"), F.lit(0).alias("n_chars")), count).drop("class", "n_chars").sortWithinPartitions("table", "key", "id")
    return mapped(placed, neighbours, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def pairs_apart(prints: DataFrame) -> DataFrame:
    """(a, b, times): all ids of prints(id, fingerprint, class) of two classes that agree on a table's first samples and on `AGREE`.

    No text's partners are limited: what `met_pairs` leaves out, since nearer neighbours stood between, is here. Texts
    of one class are not compared, so a large group of near copies costs no pairs once it is connected. Where prints has
    n_chars, pairs whose lengths differ by more edits than near copies have are left out: they are not near.
    """
    if "n_chars" not in prints.columns:
        prints = prints.withColumn("n_chars", F.lit(0))

    def compared(table: np.ndarray, prefix: np.ndarray, key: np.ndarray, more: np.ndarray, ids: np.ndarray, of: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = (table[1:] != table[:-1]) | (prefix[1:] != prefix[:-1])
        ends = np.append(np.flatnonzero(new) + 1, len(ids))
        class_ends = np.append(np.flatnonzero(new | (of[1:] != of[:-1])) + 1, len(ids))
        at = np.arange(len(ids))
        stop, other = ends[np.searchsorted(ends, at, side="right")], class_ends[np.searchsorted(class_ends, at, side="right")]
        while len(at):
            some = other < stop
            at, other, stop = at[some], other[some], stop[some]
            able = np.abs(size[at] - size[other]) <= most_edits(np.maximum(size[at], size[other]))
            i, j = at[able], other[able]
            near = agreeing(key[i], key[j]) + agreeing(more[i], more[j]) >= AGREE
            if near.any():
                x, y = ids[i[near]], ids[j[near]]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            other = other + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 7
        names, size, wanted = ("table", "prefix", "key", "more", "id", "class", "n_chars"), 0, 0
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            waiting.append([batch.column(c).to_numpy().astype(np.int64) for c in names])
            size += batch.num_rows
            if size < wanted:
                continue
            held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
            waiting = []
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from compared(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            size, wanted = len(held[0]), 2 * len(held[0])
        held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
        if len(held[0]):
            yield from compared(*held)

    placed = banded(prints).withColumn("prefix", F.shiftright("key", 64 - 4 * BAND)).sortWithinPartitions("table", "prefix", "class", "id")
    return mapped(placed, run, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def grams_shared(a: np.ndarray, b: np.ndarray, most: int, q: int) -> bool:
    """Whether two texts share the q-grams that any two within `most` edits share."""
    need = max(len(a), len(b)) - q + 1 - most * q
    if need <= 0:
        return True
    (x, n), (y, m) = (np.unique(window_hashes(t.astype(np.uint64), q), return_counts=True) for t in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()) >= need


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """No less than the edit distance of two texts: the edits between the runs of `ANCHOR` code points that each has once, where these are in one order.

    Where edits lie further apart than a run, as in most near copies, this is about the distance itself.
    """
    n, m, q = len(a), len(b), ANCHOR
    if min(n, m) < q:
        return max(n, m)
    (x, i), (y, j) = (_single(window_hashes(t.astype(np.uint64), q)) for t in (a, b))
    _, u, v = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    i, j = i[u], j[v]
    order = np.argsort(i)
    i, j = i[order], j[order]
    same = (np.lib.stride_tricks.sliding_window_view(a, q)[i] == np.lib.stride_tricks.sliding_window_view(b, q)[j]).all(axis=1)
    i, j = i[same], j[same]
    if not len(i):
        return max(n, m)
    rising = (np.maximum.accumulate(j) == j) & (np.minimum.accumulate(j[::-1])[::-1] == j)
    i, j = i[rising], j[rising]
    if not len(i):
        return max(n, m)
    di, dj = np.diff(i), np.diff(j)
    shorter = np.minimum(np.minimum(di, dj), q)  # runs that overlap count up to where the next begins
    between = np.maximum(di, dj) - shorter
    return int(between.sum()) + max(int(i[0]), int(j[0])) + max(n - q - int(i[-1]), m - q - int(j[-1]))


def _single(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the hashes that occur once."""
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])
    once = new[1:] & new[:-1]
    return sorted_[once], order[once]


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two texts in code points is at most so much: how far each diagonal gets with 0, 1, ... edits.

    Time grows with the length plus the square of the distance, so near copies of any length are cheap; most others fail by
    their q-grams. Where little is left between the common head and end, the bits of one integer are faster.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not n or not m or (n == m and (a == b).all()):
        return True
    if not all(grams_shared(a, b, most, q) for q in (3, 5)):
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    end = int(differ[0]) if len(differ) else short - head
    a, b = a[head : n - end], b[head : m - end]
    n, m = len(a), len(b)
    if aligned(a, b) <= most:
        return True
    if max(n, m) <= SHORT:
        return edit_distance(a.tolist(), b.tolist()) <= most
    wide = 4096
    # code points end at 0x10FFFF: past the ends nothing is equal
    x = np.concatenate([a.astype(np.uint32), np.full(wide, 0xFFFFFFFE, dtype=np.uint32)])
    y = np.concatenate([b.astype(np.uint32), np.full(wide, 0xFFFFFFFF, dtype=np.uint32)])

    def extended(i: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        on, w = np.arange(len(i)), 4
        while len(on):
            span = np.arange(w)
            equal = x[i[on][:, None] + span] == y[(i[on] + diagonal[on])[:, None] + span]
            run = np.where(equal.all(axis=1), w, equal.argmin(axis=1))
            i[on] += run
            on = on[run == w]
            w = min(4 * w, wide, max(4, 1_000_000 // max(1, len(on))))
        return i

    low = high = 0
    reach = extended(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    for d in range(most + 1):
        if low <= m - n <= high and reach[m - n - low] >= n:
            return True
        # only diagonals from which the edits left still lead to the end
        left = most - d - 1
        to = range(max(low - 1, m - n - left), min(high + 1, m - n + left) + 1)
        if d == most or not len(to):
            return False
        diagonal = np.arange(to.start, to.stop)
        padded = np.full(high - low + 5, -1, dtype=np.int64)
        padded[2:-2] = reach
        at = diagonal - low + 2
        same, less, more = padded[at], padded[at - 1], padded[at + 1]
        i = np.maximum(np.maximum(np.where(same >= 0, same + 1, -1), less), np.where(more >= 0, more + 1, -1))
        i = np.minimum(i, np.minimum(n, m - diagonal))
        reach = np.full(len(i), -1, dtype=np.int64)
        valid = (i >= 0) & (i + diagonal >= 0)
        reach[valid] = extended(i[valid], diagonal[valid])
        low, high = to.start, to.stop - 1
    return False


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def near_classes(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of the near copies among texts(id, text), fingerprinted in prints(id, fingerprint): the smallest id of each group.

    Pairs are near within `EDITS` edits a character of the longer text. First each text is compared with the one it met
    most often among its neighbours in the tables of bands; then all pairs that agree on a band and are not connected yet,
    of each text first the pair that met most often, then four times as many each round. So groups of any size are linear work
    where their texts connect, and no pair of a band is left out where they do not.
    """
    most = F.max_by("a", F.struct("times", -F.col("a")))
    pairs = written(met_pairs(prints, FIRST_BANDS).groupBy("b").agg(most.alias("a")).select("a", "b"), "met")
    found = written(_near_pairs(pairs, _brought(pairs, texts)), "near")
    classes = written(components(found), "near-groups")
    of = prints.join(classes.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left").select("id", *(c for c in ("fingerprint", "n_chars") if c in prints.columns), F.coalesce("component", "id").alias("class"))
    left, k = written(pairs_apart(of).join(pairs, ["a", "b"], "left_anti"), "met"), 1
    brought = _brought(left, texts) if not left.isEmpty() else None
    while not left.isEmpty():
        turn = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))
        ranked = left.withColumn("turn", turn)
        close = written(_near_pairs(ranked.filter(F.col("turn") <= k).select("a", "b"), brought), "near")
        if not close.isEmpty():
            classes = _joined(classes, close)
        of = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"{side}_class"))
        rest = ranked.filter(F.col("turn") > k).drop("turn").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = F.coalesce("a_class", "a") != F.coalesce("b_class", "b")
        before, left, k = left, written(rest.filter(apart).select("a", "b", "times"), "met"), 4 * k
        discarded(before)
    if brought is not None:
        discarded(brought)
    return classes


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes(id, component) with links(a, b) more: only the classes that these connect are grouped again, not all earlier links."""
    named = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"{side}_class"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    edges = ends.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    merged = components(edges).select(F.col("id").alias("old"), F.col("component").alias("new"))
    both = classes.join(merged, F.col("component") == F.col("old"), "full")
    # a text without a class so far is its own
    moved = both.select(F.coalesce("id", "old").alias("id"), F.coalesce("new", "component").alias("component"))
    return written(moved, "near-groups")


def _brought(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of texts(id, text) that pairs(a, b) name, each once."""
    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    members = Members(met, "id")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(members.have(batch.column("id").to_numpy()), pa.bool_()))

    some = mapped(texts.select("id", "text"), wanted, "id long, text string").join(met, "id", "left_semi")
    return written(some.groupBy("id").agg(F.first("text").alias("text")), "met-texts")


def _near_pairs(pairs: DataFrame, brought: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose texts are near. A text that many others met goes to as many tasks as blocks of them."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)).cast("int").alias("slots"))
    sent = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), F.col("b").alias("id"))
    sent = sent.unionByName(slots.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("a").alias("id")))
    return by_groups(sent.join(brought, "id").select("a", "slot", "id", "text"), ["a", "slot"], _near_centre, "a long, b long", ["id"], 200)


def _near_centre(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Of groups of texts (a, slot), those that are near the text a."""
    centre, ids, group = pdf["a"].to_numpy(), pdf["id"].to_numpy(), pdf[["a", "slot"]].to_numpy()
    texts, found = pdf["text"].tolist(), []
    bounds = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1), [True]])).tolist()
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        one = text_codes(texts[s + int(np.flatnonzero(ids[s:e] == centre[s])[0])])
        for i in range(s, e):
            if ids[i] != centre[i] and near(one, text_codes(texts[i])):
                found.append((int(centre[i]), int(ids[i])))
    return pd.DataFrame(found, columns=["a", "b"]) if found else None


def most_edits(n: np.ndarray) -> np.ndarray:
    """Edits of near copies, the longer of which has n characters."""
    return np.floor(EDITS * n + 1e-9).astype(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    return within(a, b, int(most_edits(np.array(max(len(a), len(b))))))


def near_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of docs(doc_id, text): near copies, whose edit distance is at most `EDITS` of the longer text.

    class_id: the smallest doc_id of the connected group; n_links: to how many different texts the row's is near.
    A null text is empty; copies of a text are one text; an empty text is like its copies only; null doc_ids come
    last when the smallest is taken. Bands bring together texts that agree on few samples: see the tests for the recall.
    Counting all links of a group compares all its pairs; `op1_fingerprints` asks for classes only, which is linear.
    """
    rows = docs.select(*known("doc_id"), clean_text(docs).alias("text")).withColumn("id", F.xxhash64("text"))
    place = F.struct("_unknown", "_id")
    texts = rows.groupBy("id").agg(F.min(place).alias("place"), F.first("text").alias("text"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, some in text_blocks(batch, "text", _BLOCK):
                yield pa.record_batch([block.column("id"), pa.array(fingerprints(some)[0], pa.string())], names=["id", "fingerprint"])

    prints = written(mapped(texts.select("id", "text"), walked, "id long, fingerprint string"), "fingerprints")
    groups = written(components(met_pairs(prints)), "print-groups")
    brought = texts.join(groups.withColumnRenamed("id", "g"), F.col("id") == F.col("g")).select("component", "id", "text")
    links = written(by_groups(block_pairs(brought, "component", "id", BLOCK_TEXTS), ["component", "_i", "_j"], _near, "id long, root long, links long", ["id"], 200), "print-links")
    counts = links.groupBy(F.col("id").alias("l")).agg(F.sum("links").alias("n_links"))
    classes = components(links.select(F.col("root").alias("a"), F.col("id").alias("b"))).withColumnRenamed("id", "c")
    named = texts.select("id", "place").join(classes, F.col("id") == F.col("c"), "left").withColumn("class", F.coalesce("component", "id"))
    first = named.groupBy("class").agg(F.min("place").alias("first"))
    named = named.join(first, "class").join(counts, F.col("id") == F.col("l"), "left").select(F.col("id").alias("t"), "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = rows.select("_id", "_unknown", "id").join(named, F.col("id") == F.col("t"))
    return found.select(id_again(), F.when(~F.col("first._unknown"), F.col("first._id")).alias("class_id"), "n_links")


def _near(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Of the texts of some groups, each of one or two blocks: of each text its links and the smallest text they connect it to."""
    ids, side, group = pdf["id"].to_numpy(), pdf["_side"].tolist(), pdf[["component", "_i", "_j"]].to_numpy()
    codes = [text_codes(t) for t in pdf["text"]]
    bounds = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1), [True]])).tolist()
    left, right = [], []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        two = 1 in side[s:e]
        for i in range(s, e):
            for j in range(i + 1, e):
                if ids[i] != ids[j] and not (two and side[i] == side[j]) and near(codes[i], codes[j]):
                    left.append(i)
                    right.append(j)
    if not left:
        return None
    i, j = np.array(left), np.array(right)
    root, low = local_roots(len(pdf), i, j), np.full(len(pdf), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    links = np.bincount(np.concatenate([i, j]), minlength=len(pdf))
    some = links > 0
    return pd.DataFrame({"id": ids[some], "root": low[root][some], "links": links[some]})


def with_classes(docs: DataFrame) -> DataFrame:
    """`with_edited` of docs(doc_id, text), with class_id: the smallest doc_id of the row's near copies, itself among them.

    Copies of a text are in one class; a text that is near to none is alone; null doc_ids come last when the smallest is
    taken, and a class of such rows alone has none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("text").alias("id"), "text")
    with shuffles_dropped(spark):
        rows = written(with_edited(docs), "edited", "zstd")
        prints = rows.groupBy(F.col("text_hash").alias("id")).agg(F.first("fingerprint").alias("fingerprint"), F.first("n_chars").alias("n_chars"))
        classes = near_classes(written(prints, "fingerprints", "zstd"), texts).withColumnRenamed("id", "c")
        at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")
        named = rows.groupBy(F.col("text_hash").alias("t")).agg(F.min(at).alias("first")).join(classes, F.col("t") == F.col("c"), "left")
        named = named.withColumn("class", F.coalesce("component", "t"))
        first = named.groupBy("class").agg(F.min("first").alias("least"))
        of = written(named.join(first, "class").select("t", F.col("least.doc_id").alias("class_id")), "classes")
    return rows.join(of, F.col("text_hash") == F.col("t")).drop("text_hash", "t")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text")))
