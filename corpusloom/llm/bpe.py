"""Byte-pair encoding and decoding by a traversal of the trie of distinct words.

Texts are cut into words by the tokenizer's own pattern. The distinct words of a block of texts that
have no encoding yet are laid out as a trie (sorted order is its depth-first order) and visited once:
each prefix holds one state, the last token of its encoding, so what two words share is encoded once.
The last token of a prefix is the vocabulary entry that ends it and that merging leaves next to the
last token of what stands before it; a word's ids are read off by walking the states back.

Defined edge cases: null is encoded as the empty text (no ids); words of any length are encoded whole;
special tokens of the vocabulary that occur in a text become their own id; equal rows give equal rows;
columns of the input other than the text pass through `encode`, but for one named as the output.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, mapped, unused

#: Fixed value: the word pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a generation and token pairs remembered per Python worker; beyond them a new generation begins, and pairs start afresh.
REMEMBERED, PAIRS = 250_000, 500_000
BLOCK_CHARACTERS = 1_000_000
assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are kept as native unsigned 32-bit integers"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or 256 onwards for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words with a byte-level vocabulary and ranked merges."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        import regex

        spec = json.loads(vocabulary)
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(map(to_byte.__getitem__, s))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.specials}
        self.bytes_of: dict[int, bytes] = {v: k for k, v in self.id_of.items()} | {v: k.encode() for k, v in self.specials.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            self.parts.setdefault(a + b, (i, a, b))
        # the longest token that ends with each pair of bytes
        self.longest = [1] * 65536
        for token in self.id_of:
            if len(token) > 1:
                at = token[-2] << 8 | token[-1]
                self.longest[at] = max(self.longest[at], len(token))
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.edges: dict[tuple[bytes, int], list[tuple[int, bytes]]] = {}
        self.adjacent: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # the generation before: what is still in use moves on, the rest goes with the next change
        self.old_known: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def edge(self, token: bytes, right: int) -> list[tuple[int, bytes]]:
        """What stands at one end of a token while it is merged: (rank of the merge that consumes it, symbol), first to last."""
        found = self.edges.get((token, right))
        if found is None:
            found, symbol = [(len(self.rank), token)], token
            while symbol in self.parts:
                until, *sides = self.parts[symbol]
                symbol = sides[right]
                found.append((until, symbol))
            found.reverse()
            self.edges[token, right] = found
        return found

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of a and b ends in exactly these two tokens.

        It does unless, while the right end of a and the left end of b grow, the two symbols that meet
        form a merge of lower rank than the one next to come to either (at equal rank the left one is first).
        """
        left, right, rank = self.edge(a, 1), self.edge(b, 0), self.rank
        i = j = 0
        while i < len(left) and j < len(right):
            (until_a, x), (until_b, y) = left[i], right[j]
            across = rank.get((x, y))
            if across is not None and across < until_a and across <= until_b:
                return False
            if until_a <= until_b:
                i += 1
            else:
                j += 1
        return True

    def learn(self, words: list[str]) -> None:
        """Visit the trie of these distinct words depth first and remember every word's ids."""
        id_of, longest, adjacent = self.id_of, self.longest, self.adjacent
        if len(adjacent) > PAIRS:
            adjacent.clear()
        path, last = b"", [b""]  # the current trie path and the state of each of its prefixes
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                reach = longest[data[end - 2] << 8 | data[end - 1]] if end > 1 else 1
                for begin in range(end - reach if end > reach else 0, end):
                    token = data[begin:end]
                    if token in id_of:
                        if not begin:
                            last.append(token)
                            break
                        pair = last[begin], token
                        fits = adjacent.get(pair)
                        if fits is None:
                            fits = adjacent[pair] = self.stay_apart(*pair)
                        if fits:
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no encoding of {data[:end]!r}")
            path, end, ids = data, len(data), []
            while end:
                token = last[end]
                ids.append(id_of[token])
                end -= len(token)
            ids.reverse()
            self.known[word] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARACTERS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[str]) -> Iterator[bytes]:
        """A text falls apart before every single space that a non-space follows; the parts recur, so their ids are kept."""
        if len(self.chunks) > self.remembered:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.known) > self.remembered:
            self.old_known, self.known = self.known, {}
        cut = [text.split(" ") for text in block]
        chunks, known, old = self.chunks, self.known, self.old_chunks
        new = {c for c in set().union(*cut) if c not in chunks}
        kept = new & old.keys()
        chunks.update((c, old[c]) for c in kept)
        new -= kept
        if self._special(" ".join(new)):
            new = {c for c in new if not self._special(c)}
        # a part of letters only is one word
        words = {c: [" " + c] if c.isalpha() else self.words.findall(" " + c) for c in new if c and not c[0].isspace()}
        self._look_up({w for found in words.values() for w in found if w not in known})
        for c, found in words.items():
            chunks[c] = known[found[0]] if len(found) == 1 else b"".join([known[w] for w in found])
        for text, parts in zip(block, cut, strict=True):
            try:
                rest = b"".join(map(chunks.__getitem__, parts[1:]))
                yield self._whole(parts[0]) + rest
            except KeyError:
                yield self._whole(text)

    def _look_up(self, missing: set[str]) -> None:
        """Make the ids of words known, from the generation before or anew."""
        kept = missing & self.old_known.keys()
        self.known.update((w, self.old_known[w]) for w in kept)
        if missing := missing - kept:
            self.learn([*missing])

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _whole(self, text: str) -> bytes:
        """A text's ids word by word."""
        out = []
        for part in self.split.split(text) if self._special(text) else [text]:
            if part in self.specials:
                out.append(array("I", [self.specials[part]]).tobytes())
                continue
            found = self.words.findall(part)
            self._look_up({w for w in found if w not in self.known})
            out += map(self.known.__getitem__, found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, remembered: int = REMEMBERED) -> TrieEncoder:
    """One encoder per vocabulary and Python worker."""
    return TrieEncoder(vocabulary, remembered)


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file's content (about 1.5 MB); by default the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the text replaced by its ids (binary, little-endian unsigned 32-bit)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    given = unused(docs, "_text")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in rest)).schema), f"`{ids}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            new = pa.array(list(e.encode(batch.column(len(rest)).to_pylist())), pa.binary())
            yield pa.record_batch([*batch.columns[: len(rest)], new], names=[*rest, ids])

    return mapped(docs.select(*(f"`{c}`" for c in rest), clean_text(docs, text).alias(given)), run, fields)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the ids replaced by the decoded text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in encoded.columns if c.lower() not in (text.lower(), ids.lower())]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*(f"`{c}`" for c in rest)).schema), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            new = pa.array([e.decode(x or b"") for x in batch.column(len(rest)).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns[: len(rest)], new], names=[*rest, text])

    return mapped(encoded.select(*(f"`{c}`" for c in [*rest, ids])), run, fields)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    hexed = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value, 2 * REMEMBERED)  # nothing else runs in these workers
        for batch in batches:
            n, ids, decoded = [], [], []
            for x in e.encode(batch.column("text").to_pylist()):
                n.append(len(x) // 4)
                ids.append(hexed(x))
                decoded.append(hexed(e.decode(x).encode("utf-8")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
