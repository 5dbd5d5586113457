"""Elias-Fano sequences and n-gram tries over them, built and queried with NumPy, kept in one file that can be memory-mapped.

A level of the trie holds the children of all nodes above, node by node. Child w of node i is the number i * width + w, so a level is
one ascending sequence; a second one has the pointers, where each node's children begin. A child is found by a successor
search among the numbers from i * width on, between the node's two pointers.
"""

from __future__ import annotations

import json

import numpy as np

#: For every byte the places of its ones (8: none), counted from the lowest bit.
_SELECT = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    _ones = [_i for _i in range(8) if _b >> _i & 1]
    _SELECT[_b, : len(_ones)] = _ones


class Sequence:
    """n ascending numbers below `universe`: the lower bits packed, the upper parts as a bit vector of ones among zeros."""

    def __init__(self, fields: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in fields[f"{name}.head"])
        self.low, self.high, self.ranks = (fields[f"{name}.{x}"] for x in ("low", "high", "ranks"))

    @staticmethod
    def fields(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        upper = (values >> bits) + np.arange(n)
        flags = np.zeros(-(-(n + (universe >> bits) + 2) // 64) * 64, dtype=np.uint8)
        flags[upper] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ranks = np.zeros(len(high) + 1, dtype=np.uint32 if n < 1 << 32 else np.uint64)
        np.cumsum(np.bitwise_count(high), out=ranks[1:])
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = (values & ((1 << bits) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] = np.bitwise_or.reduceat(part << off, starts)
            over = np.flatnonzero(off + np.uint64(bits) > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - off[over])
        return {f"{name}.head": np.array([n, bits], dtype=np.int64), f"{name}.low": low, f"{name}.high": high, f"{name}.ranks": ranks}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> off | over) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the bit vector."""
        ranks = self.ranks if ones else np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
        word = np.searchsorted(ranks, k, side="right") - 1
        rest, bits = k - ranks[word].astype(np.int64), self.high[word]
        if not ones:
            bits = ~bits
        place, found = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=bool)
        for j in range(8):
            byte = (bits >> np.uint64(8 * j) & np.uint64(255)).astype(np.uint8)
            many = np.bitwise_count(byte).astype(np.int64)
            here = ~found & (rest < many)
            place[here] = 8 * j + _SELECT[byte[here], rest[here]]
            found |= here
            rest = np.where(found, rest, rest - many)
        return word * 64 + place

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number not below x among those from lo to before hi, whether it is x); hi if there is none with x's upper part."""
        head = x >> self.low_bits
        begin = np.where(head > 0, self._select(np.maximum(head - 1, 0), False) - (head - 1), 0)
        end = np.minimum(self._select(head, False) - head, hi)
        at, stop, low = np.maximum(begin, lo), np.maximum(begin, end), x & ((1 << self.low_bits) - 1)
        stop = np.maximum(at, stop)
        last = stop.copy()
        while (open_ := np.flatnonzero(at < stop)).size:
            middle = (at[open_] + stop[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_] = np.where(less, middle + 1, at[open_])
            stop[open_] = np.where(less, stop[open_], middle)
        found = at < last
        found[found] = self._low(at[found]) == low[found]
        return at, found


def build(columns: list[np.ndarray], counts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The fields of a trie of n-grams (a column per word, repeated ones add up), the context node of every n-gram given and of every leaf, and each leaf's count."""
    width = max([1, *(int(c.max()) + 1 for c in columns if len(c))])
    fields = {"width": np.array([width], dtype=np.int64)}
    node, above = np.zeros(len(counts), dtype=np.int64), 1
    for level, column in enumerate(columns):
        given = node
        values, node = np.unique(given * width + column, return_inverse=True)
        pointers = np.searchsorted(values, np.arange(above + 1, dtype=np.int64) * width)
        fields |= Sequence.fields(values, above * width, f"words{level}") | Sequence.fields(pointers, len(values) + 1, f"pointers{level}")
        above = len(values)
    return fields, given, values // width, np.bincount(node, counts, minlength=above).astype(np.int64)


def to_bytes(fields: dict[str, np.ndarray]) -> list[bytes]:
    """A trie's file: the size of the directory, the directory, and the arrays, each from a multiple of 8 bytes on."""
    where, at, out = {}, 0, []
    for k, a in fields.items():
        where[k] = (a.dtype.str, len(a), at)
        data = a.tobytes()
        data += bytes(-len(data) % 8)
        out.append(data)
        at += len(data)
    directory = json.dumps(where).encode()
    directory += b" " * (-len(directory) % 8)
    return [len(directory).to_bytes(8, "little"), directory, *out]


class Trie:
    """A trie's file, opened over a memory map or bytes; nothing is copied."""

    def __init__(self, data: np.ndarray):
        size = int.from_bytes(data[:8].tobytes(), "little")
        where = json.loads(data[8 : 8 + size].tobytes())
        base = data[8 + size :]
        self.fields = {k: base[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in where.items()}
        self.width = int(self.fields["width"][0])
        self.levels = []
        while (name := f"words{len(self.levels)}") + ".head" in self.fields:
            self.levels.append((Sequence(self.fields, name), Sequence(self.fields, name.replace("words", "pointers"))))

    def child(self, level: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child of each node (-1: no node) by its word, on the given level; -1 if there is none."""
        words, pointers = self.levels[level]
        out = np.full(len(node), -1, dtype=np.int64)
        asked = np.flatnonzero((node >= 0) & (word < self.width))
        if words.n and asked.size:
            i = node[asked]
            at, found = words.successor(i * self.width + word[asked], pointers.access(i), pointers.access(i + 1))
            out[asked[found]] = at[found]
        return out
