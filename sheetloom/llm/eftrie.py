"""n-gram trie with Elias-Fano pointers and quantised probabilities.

Level k holds all kept k-grams of symbols, ordered by their first k - 1 symbols and then
by the last.  Where the children of a node begin is a monotone sequence, kept in
Elias-Fano form.  A last symbol is not stored itself but as its rank among the successors
of the context that is one symbol shorter, which has all of them; so a query goes from
short contexts to long ones and searches each node for the rank it has just found.
Smoothed probabilities and back-off weights are 16-bit logarithms.  All levels lie in
one buffer and are read in place, from a broadcast or from a memory-mapped file.
"""
from __future__ import annotations

import json
import mmap

import numpy as np

DISCOUNT = 0.75
_SCALE = 65535 / 16.0    # logarithms to base 10 down to -16
_SAMPLE = 32


def left_over(totals: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The share that contexts leave to shorter ones, from their counts and the discounted counts of their kept successors."""
    return np.maximum(1.0 - taken / np.maximum(totals, 1), 1e-9)


class EliasFano:
    """A monotone sequence: low bytes, high parts in unary, and the place of every 32nd one."""

    def __init__(self, lows: np.ndarray, bits: np.ndarray, samples: np.ndarray):
        self.lows, self.bits, self.samples = lows, bits, samples

    @staticmethod
    def build(values: np.ndarray) -> "EliasFano":
        values = values.astype(np.int64)
        at = (values >> 8) + np.arange(len(values))
        size = int(at[-1]) + 65 if len(at) else 65
        flags = np.zeros((size + 63) // 64 * 64, np.uint8)
        flags[at] = 1
        bits = np.packbits(flags, bitorder="little").view("<u8")
        return EliasFano((values & 255).astype(np.uint8), bits, at[::_SAMPLE].astype("<u4"))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        place = self.samples[i // _SAMPLE].astype(np.int64)
        left = i % _SAMPLE
        word = place >> 6
        held = self.bits[word] >> (place & 63).astype(np.uint64) << (place & 63).astype(np.uint64)
        count = np.bitwise_count(held).astype(np.int64)
        more = np.flatnonzero(left >= count)
        while len(more):                       # the one that is wanted lies in a later word
            left[more] -= count[more]
            word[more] += 1
            held[more] = self.bits[word[more]]
            count[more] = np.bitwise_count(held[more])
            more = more[left[more] >= count[more]]
        base = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):     # select inside the word
            low = held & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            up = left >= ones
            left -= ones * up
            base += width * up
            held = np.where(up, held >> np.uint64(width), low)
        return ((word * 64 + base - i) << 8) | self.lows[i]


class Trie:
    """Levels of (ranks, probabilities, back-off weights, pointers)."""

    def __init__(self, levels: list[dict]):
        self.levels = levels
        # every query starts at a single symbol: those few pointers are unpacked once
        self.first = levels[1]["starts"].get(np.arange(len(levels[0]["p"]) + 1)) if len(levels) > 1 else None

    @staticmethod
    def build(single: np.ndarray, seen: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> "Trie":
        """From the probability and the count of every symbol, and (packed k-grams, ascending, and counts) for k = 2, 3 ...

        A k-gram is packed in base ``len(single)``.  Every gram's first and last k - 1 symbols
        are among the grams below it.  Absolute discounting: of every kept count some is taken
        away, and what a context has left over, for pruned grams too, goes to the shorter one.
        """
        symbols = len(single)
        before, totals, links, weights = np.arange(symbols), seen, [], []
        for k, (packed, counts) in enumerate(grams, 2):
            parent = np.searchsorted(before, packed // symbols)
            shorter = np.searchsorted(before, packed % symbols ** (k - 1))     # the gram without its first symbol
            links.append((parent, shorter, counts))
            taken = np.bincount(parent, np.maximum(counts - DISCOUNT, 0), len(before))
            weights.append(left_over(totals, taken))
            before, totals = packed, counts
        return Trie.of_parts(single, seen, links, weights)

    @staticmethod
    def of_parts(single: np.ndarray, seen: np.ndarray, links: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: list[np.ndarray]) -> "Trie":
        """From the same, with k-grams as (place of the first k - 1 symbols, place of the last k - 1 symbols, counts).

        k-grams are in order of the first place, then of the last symbol.  ``weights`` are what the contexts of
        each order leave to shorter ones; so a part of a larger trie scores as the whole does.
        """
        symbols = len(single)
        levels = [{"rank": np.arange(symbols), "p": single, "parent": np.zeros(symbols, np.int64), "starts": np.array([0, symbols]),
                   "weight": np.ones(1)}]
        totals = seen
        for (parent, shorter, counts), weight in zip(links, weights):
            below = levels[-1]
            rank = shorter - below["starts"][below["parent"][shorter]]
            p = np.maximum(counts - DISCOUNT, 0) / np.maximum(totals[parent], 1) + weight[parent] * below["p"][shorter]
            levels.append({"rank": rank, "p": p, "parent": parent, "weight": weight,
                           "starts": np.searchsorted(parent, np.arange(len(totals) + 1))})
            totals = counts
        quantise = lambda x: np.clip(np.round(-np.log10(np.maximum(x, 1e-16)) * _SCALE), 0, 65535).astype("<u2")
        return Trie([{"rank": v["rank"].astype("<u4"), "p": quantise(v["p"]), "weight": quantise(v["weight"]),
                      "starts": EliasFano.build(v["starts"])} for v in levels])

    def to_bytes(self) -> bytes:
        parts, head, at = [], [], 0
        for v in self.levels:
            entry = {}
            for name, a in (("rank", v["rank"]), ("p", v["p"]), ("weight", v["weight"]), ("lows", v["starts"].lows),
                            ("bits", v["starts"].bits), ("samples", v["starts"].samples)):
                data = a.tobytes()
                data += b"\0" * (-len(data) % 8)
                entry[name] = [at, len(a), a.dtype.str]
                parts.append(data)
                at += len(data)
            head.append(entry)
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return b"SLEF1\0\0\0" + len(text).to_bytes(8, "little") + text + b"".join(parts)

    @staticmethod
    def from_buffer(buffer) -> "Trie":
        if bytes(buffer[:5]) != b"SLEF1":
            raise ValueError("not a trie")
        size = int.from_bytes(buffer[8:16], "little")
        levels = []
        for entry in json.loads(bytes(buffer[16:16 + size])):
            a = {n: np.frombuffer(buffer, np.dtype(kind), count, 16 + size + at) for n, (at, count, kind) in entry.items()}
            levels.append({"rank": a["rank"], "p": a["p"], "weight": a["weight"], "starts": EliasFano(a["lows"], a["bits"], a["samples"])})
        return Trie(levels)

    @staticmethod
    def open(path: str) -> "Trie":
        """A trie that was saved as ``to_bytes``, memory-mapped."""
        with open(path, "rb") as f:
            return Trie.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def score(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after those before it.

        ``first`` marks symbols that begin a text; they have no context and are not scored.
        """
        n = len(symbols)
        out = self.levels[0]["p"][symbols] / -_SCALE
        rank = symbols.astype(np.int64)
        context = np.where(first, -1, np.append(-1, symbols[:-1]))        # node of the context one symbol long
        alive = np.flatnonzero(context >= 0)
        for v in self.levels[1:]:
            node = context[alive]
            if v is self.levels[1]:
                a, b = self.first[node], self.first[node + 1]
            else:
                a, b = v["starts"].get(node), v["starts"].get(node + 1)
            low, high, wanted = a.copy(), b.copy(), rank[alive]
            wide = np.flatnonzero(low < high)
            while len(wide):
                mid = (low[wide] + high[wide]) >> 1
                less = v["rank"][mid] < wanted[wide]
                low[wide] = np.where(less, mid + 1, low[wide])
                high[wide] = np.where(less, high[wide], mid)
                wide = wide[low[wide] < high[wide]]
            found = low < b
            found[found] = v["rank"][low[found]] == wanted[found]
            hit = alive[found]
            out[hit] = v["p"][low[found]] / -_SCALE
            miss = alive[~found]
            out[miss] += v["weight"][node[~found]] / -_SCALE
            # the next longer context of a symbol is the gram found at the symbol before it
            grams = np.full(n, -1, np.int64)
            grams[hit] = low[found]
            rank[hit] = low[found] - a[found]
            known = np.zeros(n, bool)
            known[hit] = True
            context = np.where(first, -1, np.append(-1, grams[:-1]))
            # without the gram below there is none above, but its context still passes a weight on
            lost = np.flatnonzero((context >= 0) & ~known)
            if v is not self.levels[-1]:
                above = self.levels[self._index(v) + 1]
                out[lost] += above["weight"][context[lost]] / -_SCALE
            alive = np.flatnonzero((context >= 0) & known)
        out[first] = 0.0
        return out

    def _index(self, level: dict) -> int:
        return next(i for i, v in enumerate(self.levels) if v is level)
