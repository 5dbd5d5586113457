"""Scores of texts by an n-gram language model, learnt from a part of them, that lives in Elias-Fano tries.

Interpolated absolute discounting over words: P(w | c) = max(n(c w) - D, 0) / n(c) + D * distinct(c) / n(c) * P(w | shorter c), down to add-one
unigrams; every text begins with a start mark and ends with an end token. Probabilities sum to one over the words and one unknown word.

Texts are cut into blocks. Each block asks for its distinct words, then for its distinct n-grams, order by order: what it asks is
dealt by hash to shards, with its own training counts. A shard adds the counts up, writes them as a trie with
quantised smoothed probabilities into the shared folder, maps that file and answers every block from it. So the model
is spread over as many files as the corpus needs, no task holds more than a shard or a block, and a frequent n-gram
reaches its shard once a block. A context with a large count is dealt over several shards by its following words.

Defined edge cases: a null text counts as empty and has its end token only; a row without doc_id trains (its doc_id is the empty text to
the checksum); repeated rows train and are scored row by row; a very long text is a block of its own; further columns are ignored;
nothing to train on makes every token certain (log10 1 = 0); an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trie
from .common import Words, clean_text, discarded, free_memory, mapped, mix, scratch_dir, text_blocks, written
from .warc import _put, _store

#: Words in an n-gram; what is taken off every count. Order 3 took 6.5 times the input on disk where the check tool allows 4.
ORDER, DISCOUNT = 2, 0.75
#: Bytes of text in a block; bytes of text whose n-grams a shard holds; training count from which a context goes to two shards, and so on.
BLOCK_BYTES, SHARD_BYTES, SPLIT_COUNT = 8 << 20, 16 << 20, 1 << 20
#: A logarithm of base 10 is kept as so many steps a unit below zero; the last code says that there is none.
STEPS, NONE = 4096, 0xFFFF
#: Global ids of words: not in the training texts, before the text; others follow.
UNKNOWN, START, FIRST_ID = 0, 1, 2
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """Integers not below zero as bytes: as few bytes each as the largest needs, byte by byte, compressed."""
    top = int(a.max()) if len(a) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    planes = a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T.tobytes()
    return struct.pack("<Bq", np.dtype(kind).itemsize, len(a)) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<Bq", data)
    planes = pa.Codec("zstd").decompress(data[9:], decompressed_size=size * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, n).T).view(f"<u{size}").reshape(n).astype(np.int64)


def coded(p: np.ndarray) -> np.ndarray:
    """Probabilities (none: 0) as quantised logarithms."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log10(p) * STEPS), NONE - 1), NONE).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 10.0 ** (codes / -STEPS))


BLOCKS = "block long, ids array<long>, held array<boolean>, sizes binary, tokens binary, asks array<struct<shard:int,words:binary,counts:binary>>"


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, held_out, text) rows cut into blocks: each text's tokens as numbers of the block's distinct words, and what each shard is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in text_blocks(batch, "text", BLOCK_BYTES):
                held = part.column("held_out")
                w = Words([t.encode("utf-8", "surrogatepass").lower() for t in texts])
                sizes = np.diff(w.first) + 1
                hashes = np.insert(w.hash, w.first[1:], 0)  # the end token is the empty word
                distinct, sample, index = np.unique(hashes, return_index=True, return_inverse=True)
                source = np.insert(np.arange(len(w.hash)), w.first[1:], -1)[sample]
                shard = (mix(distinct) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                tokens = rank[index]
                train = np.repeat(~np.array(held.to_pylist(), dtype=bool), sizes)
                counts = np.bincount(tokens[train], minlength=len(order))
                names = [b"" if i < 0 else w.data[w.start[i] : w.end[i]] for i in source[order].tolist()]
                cuts = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
                asks = [{"shard": int(shard[order[a]]), "words": b"\n".join(names[a:b]), "counts": squeeze(counts[a:b])} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))]
                row = [part.column("doc_id").to_pylist(), held.to_pylist(), squeeze(sizes), squeeze(tokens), asks]
                yield pa.record_batch([pa.array([at]), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], names=["block", "ids", "held", "sizes", "tokens", "asks"])
                at += 1

    return mapped(docs, run, BLOCKS)


VOCABULARY = "block long, shard int, ids binary, counts binary, distinct long, total long"


def vocabulary(asked: DataFrame, shards: int) -> DataFrame:
    """Answers to (block, shard, words, counts): each word's global id and training count; the shard's distinct training words and tokens.

    Ids follow the counts within a shard, so that frequent words have small ones.
    """

    def answer(table: pa.Table) -> pa.Table:
        lists = [x.split(b"\n") for x in table.column("words").to_pylist()]
        counts = [unsqueeze(x) for x in table.column("counts").to_pylist()]
        words = pa.chunked_array([pa.array(x, pa.binary()) for x in lists]).combine_chunks().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(index, np.concatenate(counts), minlength=len(words.dictionary)).astype(np.int64)
        order = pc.sort_indices(pa.table({"n": total, "w": words.dictionary}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        ids = np.empty(len(total), dtype=np.int64)
        ids[order] = np.arange(len(total)) * shards + table.column("shard")[0].as_py() + FIRST_ID
        ids[total == 0] = UNKNOWN
        ends = np.cumsum([len(x) for x in lists])[:-1]
        out = [[squeeze(a) for a in np.split(x[index], ends)] for x in (ids, total)]
        n = len(lists)
        return pa.table([table.column("block"), table.column("shard"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array([int((total > 0).sum())] * n), pa.array([int(total.sum())] * n)], names=["block", "shard", "ids", "counts", "distinct", "total"])

    return asked.groupBy("shard").applyInArrow(answer, VOCABULARY)


class Grams:
    """A block's n-grams, order by order, with the shards' answers to those of lower orders.

    The stream has a start mark before every text. Of order k, `index` has for every place of the stream its n-gram among the block's
    distinct ones in the order of their ids, or -1 where the n-gram would leave the text or its context was never trained on.
    """

    def __init__(self, row: dict, shards: int):
        self.shards = shards
        self.held = np.array(row["held"], dtype=bool)
        self.sizes = unsqueeze(row["sizes"])
        given = sorted(row["vocabulary"], key=lambda x: x["shard"])
        ids, counts = (np.concatenate([unsqueeze(x[c]) for x in given]) for c in ("ids", "counts"))
        tokens = unsqueeze(row["tokens"])
        self.known = counts[tokens]
        starts = np.cumsum(self.sizes) - self.sizes
        self.stream = np.insert(ids[tokens], starts, START)
        self.place = np.ones(len(self.stream), dtype=bool)  # places of tokens, not of marks
        self.place[starts + np.arange(len(starts))] = False
        self.distinct, self.rank = np.unique(self.stream, return_inverse=True)
        self.train = np.repeat(~self.held, self.sizes + 1)
        self.index, self.contexts = self.rank, self.distinct[:, None]
        self.totals = np.zeros(len(self.distinct), dtype=np.int64)
        np.maximum.at(self.totals, self.rank[self.place], self.known)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def started(self, texts: int) -> Grams:
        """With the number of training texts, which is the count of the start mark."""
        self.totals[self.distinct == START] = texts
        return self

    def step(self) -> None:
        """From the contexts of one order to the n-grams of the next."""
        usable = np.append(self.totals > 0, False)[self.index]  # no n-gram (-1): the last
        at = np.flatnonzero(usable[:-1] & self.place[1:]) + 1
        key = self.index[at - 1] * len(self.distinct) + self.rank[at]
        self.keys, found = np.unique(key, return_inverse=True)
        self.index_next = np.full(len(self.stream), -1, dtype=np.int64)
        self.index_next[at] = found
        self.counts = np.bincount(found[self.train[at]], minlength=len(self.keys))
        self.context, self.word = self.keys // len(self.distinct), self.distinct[self.keys % len(self.distinct)]
        used = np.unique(self.context)
        # a context of a large count has several shards, and each n-gram of it one of them
        salts = 1 + self.totals[used] // SPLIT_COUNT
        pair_context = np.repeat(used, salts)
        pair_salt = np.arange(len(pair_context)) - np.repeat(np.cumsum(salts) - salts, salts)
        h = np.zeros(len(pair_context), dtype=np.uint64)
        for c in range(self.contexts.shape[1]):
            h = mix(h + self.contexts[pair_context, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        shard = (mix(h + pair_salt.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        first = np.zeros(len(self.totals) + 1, dtype=np.int64)
        first[used] = np.cumsum(salts) - salts
        own = first[self.context] + self.word % (1 + self.totals[self.context] // SPLIT_COUNT)
        self.pair_order = np.argsort(shard, kind="stable")
        pair_rank = np.empty(len(shard), dtype=np.int64)
        pair_rank[self.pair_order] = np.arange(len(shard))
        self.entry_order = np.argsort(pair_rank[own], kind="stable")
        self.pair_context, self.pair_shard = pair_context, shard
        self.children = np.bincount(pair_rank[own], minlength=len(shard))  # by pair, in the order of the shards

    def asks(self) -> list[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(shard, contexts, totals, children, words, counts) for each shard with anything to ask."""
        shard, context = self.pair_shard[self.pair_order], self.pair_context[self.pair_order]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
        ends = np.concatenate([[0], np.cumsum(self.children)])
        word, counts = self.word[self.entry_order], self.counts[self.entry_order]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = slice(ends[a], ends[b])
            out.append((int(shard[a]), squeeze(self.contexts[context[a:b]].T.ravel()), squeeze(self.totals[context[a:b]]), squeeze(self.children[a:b]), squeeze(word[e]), squeeze(counts[e])))
        return out

    def answered(self, given: list[dict]) -> None:
        """Take the shards' answers: each n-gram's discounted probability, each context's mass for others, each n-gram's total; the next order's contexts are this one's n-grams."""
        given = sorted(given or [], key=lambda x: x["shard"])
        part = lambda c: np.concatenate([np.zeros(0, dtype=np.int64), *(unsqueeze(x[c]) for x in given)])
        alpha, totals = np.zeros(len(self.keys)), np.zeros(len(self.keys), dtype=np.int64)
        alpha[self.entry_order] = decoded(part("probabilities"))
        if len(known := part("totals")):  # not of the last order
            totals[self.entry_order] = known
        rest = np.bincount(self.pair_context[self.pair_order], decoded(part("rests")), minlength=len(self.totals))
        self.levels.append((self.index_next, alpha, rest[self.context]))
        self.contexts = np.concatenate([self.contexts[self.context], self.word[:, None]], axis=1)
        self.index, self.totals = self.index_next, totals

    def scores(self, distinct: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, unigram score and score of each text."""
        base = (self.known + 1) / (total + distinct + 1)
        p = np.ones(len(self.stream))
        p[self.place] = base
        for index, alpha, rest in self.levels:
            at = np.flatnonzero(index >= 0)
            at = at[rest[index[at]] > 0]  # a context that was never followed leaves the shorter one's probability
            p[at] = np.minimum(alpha[index[at]] + rest[index[at]] * p[at], 1.0)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        summed = lambda x: np.bincount(doc, x, minlength=len(self.sizes))
        return summed(self.known > 0).astype(np.int64), summed(np.log10(base)), summed(np.log10(p[self.place]))


ASKS = "block long, shard int, contexts binary, totals binary, children binary, words binary, counts binary"
ANSWERS = "block long, shard int, probabilities binary, rests binary, totals binary"


def _state(row: dict, shards: int, texts: int, order: int) -> Grams:
    """A block with all answers up to the given order."""
    grams = Grams(row, shards).started(texts)
    for k in range(2, order + 1):
        grams.step()
        grams.answered(row[f"order{k}"])
    return grams


def asked(state: DataFrame, order: int, shards: int, texts: int) -> DataFrame:
    """What the blocks ask for n-grams of an order, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _state(row, shards, texts, order - 1)
                grams.step()
                out = grams.asks()
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.record_batch([pa.array([row["block"]] * len(out), pa.int64()), *(pa.array([x[j] for x in out], k) for j, k in enumerate(kinds))], names=["block", "shard", "contexts", "totals", "children", "words", "counts"])

    return mapped(state, run, ASKS)


def _opened(store, path: str) -> trie.Trie:
    """A trie's file: mapped where the shared folder is a file system of this machine, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return trie.Trie(np.memmap(path, dtype=np.uint8, mode="r"))
    with store.open_input_stream(path, compression=None) as f:
        return trie.Trie(np.frombuffer(f.read(), dtype=np.uint8))


def answers(asks: DataFrame, order: int, last: bool, folder: str) -> DataFrame:
    """Each shard: add up the blocks' counts, write the trie, open it, answer the blocks."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        for r in rows:
            r |= {c: unsqueeze(r[c]) for c in ("contexts", "totals", "children", "words", "counts")}
            r["contexts"] = r["contexts"].reshape(order - 1, len(r["children"]))
        trained = [r["counts"] > 0 for r in rows]
        columns = [np.concatenate([np.repeat(r["contexts"][c], r["children"])[t] for r, t in zip(rows, trained, strict=True)]) for c in range(order - 1)]
        columns.append(np.concatenate([r["words"][t] for r, t in zip(rows, trained, strict=True)]))
        totals = np.concatenate([np.repeat(r["totals"], r["children"])[t] for r, t in zip(rows, trained, strict=True)])
        fields, of, context, counts = trie.build(columns, np.concatenate([r["counts"][t] for r, t in zip(rows, trained, strict=True)]))
        # the total of a context came along with each of its n-grams
        total = np.ones(int(context.max()) + 1 if len(context) else 0, dtype=np.int64)
        total[of] = totals
        fields["probabilities"] = coded((counts - DISCOUNT) / total[context])
        fields["rests"] = coded(DISCOUNT * np.bincount(context, minlength=len(total)) / total)
        if not last:
            fields["totals"] = counts
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/order{order}-{rows[0]['shard']:06d}.trie"

        def fill(f) -> None:
            for data in trie.to_bytes(fields):
                f.write(data)

        _put(store, path, fill)
        opened = _opened(store, path)
        out = [_looked_up(opened, r, order) for r in rows]
        del opened
        free_memory()
        return pa.table([table.column("block"), table.column("shard"), *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))], names=["block", "shard", "probabilities", "rests", "totals"])

    return asks.groupBy("shard").applyInArrow(answer, ANSWERS)


def _looked_up(opened: trie.Trie, r: dict, order: int) -> tuple[bytes, bytes, bytes]:
    """The answers to one block's asks: codes of its n-grams and contexts, totals of its n-grams (0: none)."""
    node = np.zeros(r["contexts"].shape[1], dtype=np.int64)
    for level in range(order - 1):
        node = opened.child(level, node, r["contexts"][level])
    end = opened.child(order - 1, np.repeat(node, r["children"]), r["words"])

    def at(name: str, i: np.ndarray, none: int) -> bytes:
        if name not in opened.fields:
            return squeeze(i[:0])
        values = np.full(len(i), none, dtype=np.int64)
        values[i >= 0] = opened.fields[name][i[i >= 0]]
        return squeeze(values)

    return at("probabilities", end, NONE), at("rests", node, NONE), at("totals", end, 0)


def _gathered(table: DataFrame, name: str, *columns: str) -> DataFrame:
    """A block's answers from all shards as one array."""
    return table.groupBy(F.col("block").alias(f"_{name}")).agg(F.collect_list(F.struct("shard", *columns)).alias(name))


def scored(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Learn from the rows of (doc_id, text) that are not held out and score all of them; the model's files stay in the shared folder."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", held_out.alias("held_out"), clean_text(docs).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    cut = written(blocks(rows, shards), "blocks")
    texts = cut.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    words = written(vocabulary(cut.select("block", F.explode("asks").alias("a")).select("block", "a.*"), shards), "vocabulary")
    totals = words.groupBy("shard").agg(F.max("distinct").alias("d"), F.max("total").alias("t")).agg(F.sum("d"), F.sum("t")).first()
    distinct, total = (int(x or 0) for x in totals)
    state = cut.drop("asks").join(_gathered(words, "vocabulary", "ids", "counts"), F.col("block") == F.col("_vocabulary")).drop("_vocabulary")
    done = []
    for k in range(2, order + 1):
        given = written(answers(asked(state, k, shards, texts), k, k == order, folder), f"order{k}")
        done.append(given)
        state = state.join(_gathered(given, f"order{k}", "probabilities", "rests", "totals"), F.col("block") == F.col(f"_order{k}"), "left").drop(f"_order{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _state(row, shards, texts, order)
                known, base, score = grams.scores(distinct, total)
                values = [row["ids"], row["held"], grams.sizes, known, np.full(len(known), total), base, score]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return mapped(state, run, SCORES)


def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
