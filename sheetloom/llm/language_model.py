"""Scores of texts under a smoothed word n-gram model in an Elias-Fano trie.

A token is a word, or the end of a text; all words that training lacks are one more
token.  Every known word is a symbol of its own.  Texts are sequences of symbols under an
interpolated n-gram model of order 3 with absolute discounting; the unknown word gets the
share of training tokens that occur once.  So the probabilities of all tokens sum to one,
up to 16-bit rounding in the trie.

Counts of all orders cover the whole corpus and stay distributed; no number of words or
n-grams is bounded.  A block of rows hands over its distinct n-grams by hash (64 bits) with
the counts that are learned from; shards of the hashes add them up over the corpus and tell
every block which of its own n-grams are kept, their counts, and what they leave to shorter
ones.  Orders go one after the other, the longest first: what n-grams take from their contexts
is known when the contexts' counts are told.  An order is counted in shares of its shards
(``PARTS``), and the shuffle of a share is gone before the next.  Texts become symbols once.
From these a block builds its shard of the trie: the whole corpus' model of all n-grams
that its texts hold, which scores them as a trie of everything would.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import eftrie
from .common import fold, in_slices, partitions, stage, whole
from .ngram_join import mix, word_hashes

LEAST = 2                  # n-grams that occur once in the whole corpus say no more than their parts
BLOCK_CHARS = 8_000_000    # characters of a block on average
SHARD_CHARS = 8_000_000    # characters whose n-grams one shard of the hashes adds up, on average
PARTS = {1: 1, 2: 2, 3: 2} # shares of the shards that an order's n-grams are counted in, one after the other
_ROWS = 500                # rows that are scored at once

# no word holds a space
FRONT, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" front", b" end"))
_ASKED = "_shard long, _block long, _k binary, _c binary, _n binary"
_SETTLED = "_shard long, _level int, _block long, _k binary, _n binary, _taken binary, _tokens long, _kinds long, _once long"
_TAKEN = -1                # in place of a block: contexts of kept n-grams and what those take from them
_SUMS = -2                 # sums of a shard's words


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an n-gram ``a`` with one more symbol."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _press(x: np.ndarray) -> bytes:
    """Planes of bytes, compressed; ascending hashes as differences."""
    if x.dtype == np.uint64:
        x = np.append(x[:1], np.diff(x))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _open(z: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if x.dtype == np.uint64 else x


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts in a row, each with its front and end, and their number in each text."""
    parts, sizes = [], []
    for t in texts:
        words = word_hashes(t)
        parts += [[FRONT], words, [END]]
        sizes.append(len(words) + 2)
    return np.concatenate(parts).astype(np.uint64, copy=False), np.array(sizes, np.int64)


def _grams(s: np.ndarray, longest: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: places of the last symbols, hashes, and hashes of the contexts."""
    out = [(np.arange(len(s)), s, s)]
    if longest > 1:
        two = np.flatnonzero(s != FRONT)
        pair = np.zeros(len(s), np.uint64)
        pair[two] = _join(s[two - 1], s[two])
        out.append((two, pair[two], s[two - 1]))
    if longest > 2:
        three = two[s[two - 1] != FRONT]
        out.append((three, _join(pair[three - 1], s[three]), pair[three - 1]))
    return out


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _slices(keys: np.ndarray, shards: int):
    """Shard, begin and end of ascending hashes."""
    if len(keys):
        of = _shard_of(keys, shards)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])


def _distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes the distinct ones, and where each begins."""
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[starts], starts


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among ascending keys, and where those are."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, at[found]


def _in_blocks(batches):
    """One row per block of rows that follow one another: ids, and the texts as places among the block's words."""
    names = ["_block", "_ids", "_learn", "_sizes", "_words", "_symbols"]

    def packed(block, held):
        ids, learn, s, sizes = zip(*held)
        ids, sizes = pa.concat_arrays(ids), np.concatenate(sizes)
        words, symbols = np.unique(np.concatenate(s), return_inverse=True)
        row = (np.concatenate(learn).astype(np.uint8), sizes, words, symbols.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                           *[pa.array([_press(x)], pa.binary()) for x in row]], names=names)

    current, held = None, []
    for batch in in_slices(batches):
        of = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(starts, starts[1:]):
            if of[a] != current and held:
                yield packed(current, held)
                held = []
            current, part = int(of[a]), batch.slice(a, b - a)
            held.append((part.column(1), part.column(2).to_numpy(zero_copy_only=False), *_tokens(part.column(3).to_pylist())))
    if held:
        yield packed(current, held)


def _ask(shards: int, level: int, part: int, parts: int):
    """Distinct n-grams of one order of each block with the counts learned from them, in slices by shard; of a share of the shards."""
    def asked(block: int, learn: np.ndarray, sizes: np.ndarray, s: np.ndarray):
        at, keys, contexts = _grams(s, level)[level - 1]
        own = _shard_of(keys, shards) % np.uint64(parts) == part
        at, keys, contexts = at[own], keys[own], contexts[own]
        order = np.argsort(keys)
        k, starts = _distinct(keys[order])
        c = contexts[order[starts]].view(np.int64)
        learned = np.repeat(learn.astype(np.uint32), sizes)
        n = np.add.reduceat(learned[at[order]], starts).astype(np.uint32) if len(starts) else np.empty(0, np.uint32)
        rows = [(i, block, _press(k[a:b]), _press(c[a:b]) if level > 1 else b"", _press(n[a:b])) for i, a, b in _slices(k, shards)]
        for begin in range(0, len(rows), 1_000):
            cols = list(zip(*rows[begin:begin + 1_000]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["_shard", "_block", "_k", "_c", "_n"])

    def run(batches):
        for batch in in_slices(batches, 1):
            block, learn, sizes, words, symbols = (batch.column(i)[0].as_py() for i in range(5))
            yield from asked(block, _open(learn, np.uint8), _open(sizes, np.int64), _open(words, np.uint64)[_open(symbols, np.uint32)])

    return run


def _settle(shards: int, level: int):
    """Counts over the corpus of what each block holds, and what kept n-grams take from their contexts.

    A block's answer says by a bit for each of its n-grams, in ascending order, whether it is kept;
    counts, and what longer n-grams take from them, follow for the kept ones alone.
    """
    def run(group: pa.Table, given: pa.Table | None) -> pa.Table:
        out: list[tuple] = []
        blocks = group.column("_block").to_pylist()
        keys = [_open(z, np.uint64) for z in group.column("_k").to_pylist()]
        if blocks:
            shard = group.column("_shard")[0].as_py()
            every = np.concatenate(keys)
            order = np.argsort(every)
            k, starts = _distinct(every[order])
            total = np.add.reduceat(np.concatenate([_open(z, np.uint32) for z in group.column("_n").to_pylist()])[order].astype(np.int64), starts)
            kept = total >= (LEAST if level > 1 else 1)
            if level == 1:
                words = total[(k != FRONT) & (k != END)]
                out.append((shard, 1, _SUMS, None, None, None, int(words.sum()), int((words > 0).sum()), int((words == 1).sum())))
            else:
                contexts = np.concatenate([_open(z, np.int64) for z in group.column("_c").to_pylist()])[order[starts[kept]]].view(np.uint64)
                c, to = np.unique(contexts, return_inverse=True)
                taken = np.bincount(to, total[kept] - eftrie.DISCOUNT, len(c))
                out += [(i, level - 1, _TAKEN, _press(c[a:b]), None, taken[a:b].tobytes(), None, None, None) for i, a, b in _slices(c, shards)]
            sums = _taken_from(k, given) if given is not None else None
            for block, own in zip(blocks, keys):
                at = np.searchsorted(k, own)
                bits = kept[at]
                at = at[bits]
                if len(at):
                    out.append((shard, level, block, _press(np.packbits(bits)), _press(total[at]), None if sums is None else _press(sums[at]),
                                None, None, None))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["_shard", "_level", "_block", "_k", "_n", "_taken", "_tokens", "_kinds", "_once"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    return run


def _taken_from(k: np.ndarray, given: pa.Table) -> np.ndarray:
    """What longer n-grams take from those in ``k``."""
    sums = np.zeros(len(k))
    if given.num_rows:
        every = np.concatenate([_open(z, np.uint64) for z in given.column("_k").to_pylist()])
        taken = np.concatenate([np.frombuffer(x, float) for x in given.column("_taken").to_pylist()])
        c, to = np.unique(every, return_inverse=True)
        found, at = _places(c, k)
        sums[found] = np.bincount(to, taken, len(c))[at]
    return sums


def _answers(given: pa.Table, level: int, own: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ascending hashes, 0 for those that are not kept, and what is taken from them as contexts."""
    n, taken = np.zeros(len(own), np.int64), np.zeros(len(own))
    rows = given.filter(pa.array(given.column("_level").to_numpy() == level))
    ends = {i: (a, b) for i, a, b in _slices(own, shards)}
    for shard, bits, counts, sums in zip(*(rows.column(c).to_pylist() for c in ("_shard", "_k", "_n", "_taken"))):
        a, b = ends[shard]
        at = a + np.flatnonzero(np.unpackbits(_open(bits, np.uint8), count=b - a))
        n[at] = _open(counts, np.int64)
        if sums is not None:
            taken[at] = _open(sums, float)
    return n, taken


def _trie(s: np.ndarray, words: np.ndarray, symbol: np.ndarray, single: np.ndarray, seen: np.ndarray, taken: np.ndarray, given: pa.Table,
          shards: int) -> eftrie.Trie:
    """The shard of the trie with all n-grams of ``s`` that the corpus' model has."""
    (_, (two, pair, _), (three, triple, _)) = _grams(s)

    def held(keys, level):
        """Places in ``keys`` of one of each n-gram that is kept, its count, and what is taken from it."""
        order = np.argsort(keys)
        own, first = _distinct(keys[order])
        n, sums = _answers(given, level, own, shards)
        first = order[first]
        kept = n > 0
        return first[kept], n[kept], sums[kept]

    m = len(words)
    at, n2, sums2 = held(pair, 2)
    packed = symbol[two[at] - 1] * m + symbol[two[at]]
    order = np.argsort(packed)
    packed, n2, sums2 = packed[order], n2[order], sums2[order]
    at, n3, _ = held(triple, 3)
    last = three[at]
    left, context = _places(packed, symbol[last - 2] * m + symbol[last - 1])
    right, shorter = _places(packed, symbol[last - 1] * m + symbol[last])
    both = left & right                  # always so, as both parts occur as often at least
    context, shorter, n3, last = context[both[left]], shorter[both[right]], n3[both], last[both]
    order = np.lexsort((symbol[last], context))
    return eftrie.Trie.of_parts(single, seen, [(packed // m, packed % m, n2), (context[order], shorter[order], n3[order])],
                                [eftrie.left_over(seen, taken), eftrie.left_over(n2, sums2)])


def score_documents(df: DataFrame, learn=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learn`` tells which rows the model learns from; by default those whose crc32 of the id
    modulo 5 is not 1.  ``score`` is log10 of the text's probability, ``base_score`` that of single
    tokens with half a count added.  Null and empty texts are the end alone; without training
    rows both scores fall back to what no counts give.  Repeated rows stay and count as often;
    other columns are not read.  The input is read twice and should come from files.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    learn = fold(doc_id, 5) != 1 if learn is None else learn
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                     F.coalesce(learn, F.lit(False)).alias("_learn"), whole(text).alias("_text"))
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_learn").cast("long")).alias("ends"), F.sum(F.length("_text")).alias("chars")).head()
    ends, chars = int(size["ends"] or 0), int(size["chars"] or 0)
    length = max(1, math.ceil(size["rows"] / max(1, math.ceil(chars / BLOCK_CHARS))))     # rows of a block that follow one another
    shards = max(partitions(df), math.ceil(chars / SHARD_CHARS))
    dealt = docs.select(F.floor(F.col("_row") / F.lit(length)).alias("_block"), "_learn", "_text", "_id")

    blocks = stage(dealt.select("_block", "_id", "_learn", "_text").mapInArrow(
        _in_blocks, f"_block long, _ids array<{id_type}>, _learn binary, _sizes binary, _words binary, _symbols binary"))

    settled: dict[int, DataFrame] = {}
    for level in (3, 2, 1):
        parts = []
        for part in range(PARTS[level]):
            asked = blocks.drop("_ids").mapInArrow(_ask(shards, level, part, PARTS[level]), _ASKED).groupBy("_shard")
            if level < 3:
                taken = settled[level + 1].filter((F.col("_block") == _TAKEN) & (F.col("_shard") % PARTS[level] == part)).select("_shard", "_k", "_taken")
                parts.append(stage(asked.cogroup(taken.groupBy("_shard")).applyInArrow(_settle(shards, level), _SETTLED)))
            else:
                parts.append(stage(asked.applyInArrow(lambda group: _settle(shards, 3)(group, None), _SETTLED)))
        settled[level] = reduce(DataFrame.union, parts)
    sums = settled[1].filter(F.col("_block") == _SUMS).agg(F.sum("_tokens").alias("n"), F.sum("_kinds").alias("v"), F.sum("_once").alias("n1")).head()
    total, kinds = int(sums["n"] or 0) + ends, int(sums["v"] or 0)
    vocabulary = kinds + (1 if ends else 0)
    new = min(0.5, max(sums["n1"] or 0, 0.5) / max(total, 1)) if total else 0.5

    told = reduce(DataFrame.union, settled.values()).filter("_block >= 0").select(F.col("_block").alias("_of"), "_shard", "_level", "_k", "_n", "_taken")
    base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))

    def score(own: pa.Table, given: pa.Table) -> pa.Table:
        learned, sizes, words, symbol = (_open(own.column(c)[0].as_py(), t) for c, t in (
            ("_learn", np.uint8), ("_sizes", np.int64), ("_words", np.uint64), ("_symbols", np.uint32)))
        symbol = symbol.astype(np.int64)
        s = words[symbol]
        c, gone = _answers(given, 1, words, shards)
        front, end = words == FRONT, words == END
        single = np.where(c > 0, c / max(total, 1) * (1 - new), new)      # unknown words are one token
        single[front] = 0.0
        if not total:
            single[end] = 0.0
        trie = _trie(s, words, symbol, single, c.astype(float), gone, given, shards)
        base, known = np.where(front, 0.0, base_of(c)), (c > 0) & ~front
        starts = np.cumsum(sizes) - sizes
        scores = []
        for i in range(0, len(sizes), _ROWS):
            a, b = starts[i], starts[min(i + _ROWS, len(sizes)) - 1] + sizes[min(i + _ROWS, len(sizes)) - 1]
            part = symbol[a:b]
            scores.append(np.add.reduceat(trie.score(part, s[a:b] == FRONT), starts[i:i + _ROWS] - a))
        return pa.Table.from_arrays([
            pa.concat_arrays([x.flatten() for x in own.column("_ids").chunks]), pa.array(learned == 0), pa.array(sizes - 1),
            pa.array(np.add.reduceat(known[symbol].astype(np.int64), starts)), pa.array(np.full(len(sizes), total)),
            pa.array(np.add.reduceat(base[symbol], starts)), pa.array(np.concatenate(scores))],
            names=[doc_id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("_block").cogroup(told.groupBy("_of")).applyInArrow(
        score, f"`{doc_id}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
