"""Removal of repeated passages, found with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 10 words.  A window
of 20 words that occurs twice holds a whole reference block of the other place, so
probing the index of blocks with every rolling 10-word window meets each repeat at
least once.  The index is a pair of bit tables of fixed size, one of all blocks and
one of blocks that occur more than once (a block must not meet itself); they only
say where to look and never decide.  A hit is extended to all 20-word windows around
it; these are compared by hash over all documents, and runs of windows that start
earlier elsewhere make up the maximal repeats, which are removed.  Rows are hashed and
probed many at a time, and a window that starts earlier in its own row is known there.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, partitions, stage, whole
from .ngram_join import mix, rolling, rolling_at, word_hashes

WINDOW = 20
BLOCK = 10               # a window of 2 * BLOCK - 1 words or more holds a whole reference block
SLICE_BITS = 12          # the bit tables are built in 4,096 slices by the top bits of the hash
WIDE, NARROW = 16, 13    # bits of a slice: 32 MB for all blocks, 4 MB for repeated ones, whatever the input
_PROBES = 3
STRETCH_WORDS = 200_000  # words that are probed at once (and the last text's)


def _bits(h: np.ndarray, width: int, probe: int) -> np.ndarray:
    """Place in the whole table of one probe."""
    low = (h >> np.uint64(16 * probe + 16 - width)) & np.uint64((1 << width) - 1)
    return ((h >> np.uint64(64 - SLICE_BITS)) << np.uint64(width)) | low


def _set(table: np.ndarray, h: np.ndarray, width: int) -> None:
    for p in range(_PROBES):
        place = _bits(h, width, p) & np.uint64((1 << width) - 1)
        np.bitwise_or.at(table, (place >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))


def _test(table: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    alive = np.arange(len(h))
    for p in range(_PROBES):
        place = _bits(h[alive], width, p)
        alive = alive[(table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
    out = np.zeros(len(h), bool)
    out[alive] = True
    return out


_HALF = BLOCK // 2
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _halves(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rolling blocks and of all windows; each is made of two halves in a row."""
    h = rolling(words, _HALF)
    blocks = mix(h[:-_HALF] * _TURN + h[_HALF:]) if len(h) > _HALF else h[:0]
    return blocks, mix(blocks[:-BLOCK] * _TURN + blocks[BLOCK:]) if len(blocks) > BLOCK else blocks[:0]


def _own_blocks(words: np.ndarray) -> np.ndarray:
    """Hashes of the reference blocks alone, the same as ``_halves`` gives at their places."""
    count = len(words) // BLOCK
    h = rolling_at(words[:count * BLOCK], _HALF)
    return mix(h[::2] * _TURN + h[1::2])


def _again(rows: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Marks windows that also stand earlier, in the same row, in arrays that ascend by row and place."""
    order = np.lexsort((windows, rows))
    out = np.zeros(len(rows), bool)
    a, b = order[1:], order[:-1]
    out[a] = (rows[a] == rows[b]) & (windows[a] == windows[b])
    return out


def _reference_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 5_000):
        words = [word_hashes(t, False) for t in batch.column(0).to_pylist()]
        # whole blocks alone, so that the next text begins at one; a block that many documents share leaves a batch once, marked as repeated
        h, counts = np.unique(_own_blocks(np.concatenate([w[:len(w) // BLOCK * BLOCK] for w in words])), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - SLICE_BITS)).astype(np.int32)), pa.array(h.view(np.int64)),
                                          pa.array(counts > 1)], names=["_slice", "_h", "_twice"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two bit tables of each slice, from hashes sorted by (slice, hash); holds one slice."""
    current, one, two, last = None, None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([one.tobytes()], pa.binary()),
                                           pa.array([two.tobytes()], pa.binary())], names=["_slice", "_all", "_repeated"])

    for batch in batches:
        slices, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        twice = batch.column(2).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])) if len(slices) else []
        for a, b in zip(starts, [*starts[1:], len(slices)]):
            if current != int(slices[a]):
                if current is not None:
                    yield done()
                current, last = int(slices[a]), None
                one, two = np.zeros(1 << (WIDE - 3), np.uint8), np.zeros(1 << (NARROW - 3), np.uint8)
            h = hashes[a:b]
            again = h == np.append(h[:1] if last is None else [last], h[:-1])
            if last is None:
                again[0] = False
            last = h[-1]
            _set(one, h[~again].view(np.uint64), WIDE)
            _set(two, h[again | twice[a:b]].view(np.uint64), NARROW)
    if current is not None:
        yield done()


def _probe(batches: Iterator[pa.RecordBatch], blocks_of: np.ndarray, repeated: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows around hits, of (row, order, text); one that starts earlier in its row has the start -1 - start, and a hash of its place."""
    rows, orders, texts, size = [], [], [], 0

    def done() -> pa.RecordBatch | None:
        words = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        blocks, windows = _halves(words)
        if not len(windows):
            return None
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place             # words from here to the end of the text
        whole_block = (left >= BLOCK)[:len(blocks)] & (sizes[row[:len(blocks)]] >= WINDOW)
        own = place[:len(blocks)] % BLOCK == 0
        hits = np.zeros(len(blocks), bool)
        for which, table, width in ((whole_block & ~own, blocks_of, WIDE), (whole_block & own, repeated, NARROW)):
            at = np.flatnonzero(which)
            hits[at] = _test(table, blocks[at], width)
        seen = np.concatenate([[0], np.cumsum(hits)])
        found = np.flatnonzero((seen[BLOCK + 1:] > seen[:-BLOCK - 1]) & (left >= WINDOW)[:len(windows)])
        if not len(found):
            return None
        h, start, of = windows[found], place[found], np.array(rows, np.int64)[row[found]]
        again = _again(row[found], h)
        h[again] = mix(of[again].view(np.uint64) * _TURN + start[again].astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(orders, np.int64)[row[found]]), pa.array(of),
                                           pa.array(np.where(again, -1 - start, start).astype(np.int32))], names=["_h", "_order", "_row", "_start"])

    for batch in in_slices(batches):
        for row, order, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append(row)
            orders.append(order)
            texts.append(word_hashes(t, False))
            size += len(texts[-1])
            if size > STRETCH_WORDS:
                out = done()
                if out is not None:
                    yield out
                rows, orders, texts, size = [], [], [], 0
    if rows:
        out = done()
        if out is not None:
            yield out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: id, the columns to ``carry``, ``text`` (kept words, one space between), ``spans`` (removed word ranges), ``n_words``,
    ``n_removed``, ``kept_sha256``.

    A word goes if a window of 20 words covers it whose words also start earlier: in a row
    with a smaller id, or earlier in the same row.  A null id is smaller than any; rows with
    equal ids are not earlier than one another.  Null and empty texts have no words, and
    texts of fewer than 20 words lose none.  Further columns are not read.  The input is
    read three times and should come from files.
    """
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(doc_id, *carry).alias("_id"), whole(text).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    order = F.coalesce(F.col("_id")[doc_id].cast("long"), F.lit(-2**63).cast("long"))
    slices = (docs.select("_text").mapInArrow(_reference_blocks, "_slice int, _h long, _twice boolean").repartition(partitions(df), "_slice")
              .sortWithinPartitions("_slice", "_h").mapInArrow(_tables, "_slice int, _all binary, _repeated binary"))
    every = np.zeros((1 << SLICE_BITS, 1 << (WIDE - 3)), np.uint8)
    repeated = np.zeros((1 << SLICE_BITS, 1 << (NARROW - 3)), np.uint8)
    for r in slices.collect():               # at most 4,096 rows of 9 KB
        every[r["_slice"]] = np.frombuffer(r["_all"], np.uint8)
        repeated[r["_slice"]] = np.frombuffer(r["_repeated"], np.uint8)
    index = df.sparkSession.sparkContext.broadcast((every.reshape(-1), repeated.reshape(-1)))

    def probe(batches):
        return _probe(batches, *index.value)

    windows = docs.select("_row", order.alias("_order"), "_text").mapInArrow(probe, "_h long, _order long, _row long, _start int")
    firsts = stage(windows.filter("_start >= 0").groupBy("_h").agg(F.min("_order").alias("_first"), F.max("_order").alias("_last"))
                   .filter("_first < _last").select("_h", "_first"))
    later = windows.join(firsts, "_h", "left").filter("_start < 0 or _order > _first").select(
        "_row", F.when(F.col("_start") < 0, -1 - F.col("_start")).otherwise(F.col("_start")).cast("int").alias("_start"), F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("binary").alias("_z"))

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1] * len(z), pa.int32()), batch.column(1), pa.array(z, pa.binary())],
                                             names=["_row", "_start", "_id", "_z"])

    texts = docs.mapInArrow(squeeze, f"_row long, _start int, _id {id_type}, _z binary")
    shape = (f"_id {id_type}, text string, spans array<struct<first:int,last:int>>, n_words long, n_removed long, kept_sha256 string")
    return (texts.union(later).repartition(partitions(df), "_row").sortWithinPartitions("_row", "_start")
            .mapInArrow(_cut, shape).select("_id.*", "text", "spans", "n_words", "n_removed", "kept_sha256"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join of texts with their repeated windows, from rows sorted by (row, start), the text first."""
    unzip = zstandard.ZstdDecompressor()
    held: list = []            # the open document: id, text, arrays of starts

    def finish(docs: list, kind: pa.DataType) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("id", "text", "spans", "n", "removed", "sha")}
        for own, z, starts in docs:
            words = unzip.decompress(z).split()
            gone = np.zeros(len(words) + 1, np.int32)
            at = np.concatenate(starts).astype(np.int64)          # each once
            gone[at] += 1
            gone[at + WINDOW] -= 1
            out = np.cumsum(gone[:-1]) > 0
            spans = _runs(out)
            kept = b" ".join(w for w, x in zip(words, out.tolist()) if not x) if spans else b" ".join(words)
            cols["id"].append(own)
            cols["text"].append(kept.decode())
            cols["spans"].append([{"first": a, "last": b} for a, b in spans])
            cols["n"].append(len(words))
            cols["removed"].append(int(out.sum()))
            cols["sha"].append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([
            pa.array(cols["id"], kind), pa.array(cols["text"], pa.string()),
            pa.array(cols["spans"], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            pa.array(cols["n"], pa.int64()), pa.array(cols["removed"], pa.int64()), pa.array(cols["sha"], pa.string())],
            names=["_id", "text", "spans", "n_words", "n_removed", "kept_sha256"])

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(2).type
        start = batch.column(1).to_numpy()
        heads = np.flatnonzero(start == -1)
        if held:
            held[-1][2].append(start[:heads[0]] if len(heads) else start)
        owns, packed = batch.column(2).take(pa.array(heads)).to_pylist(), batch.column(3).take(pa.array(heads)).to_pylist()
        ready = []
        for i, a in enumerate(heads):
            ready += held
            b = heads[i + 1] if i + 1 < len(heads) else len(start)
            held = [(owns[i], packed[i], [start[a + 1:b]])]
        for i in range(0, len(ready), 1000):
            yield finish(ready[i:i + 1000], kind)
    if held:
        yield finish(held, kind)
