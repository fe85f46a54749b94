"""Removal of repeated byte strings, found through a difference-cover sample of suffixes.

A difference cover D of Z_v (v = ``CYCLE``) has, for any two places i and j, an offset
k < v with (i + k) mod v and (j + k) mod v both in D. Only suffixes that start at a
place of D (mod v) are sampled, each ranked by a fingerprint of its first
``SAMPLE`` = 400 - v + 1 bytes: if the 400 bytes at i equal those at j, the sampled
suffixes at i + k and j + k have equal ranks. Suffixes of equal ranks make a bucket; a
bucket with two or more suffixes makes every window that begins less than v bytes before
one of them a candidate. Candidates are compared by the fingerprint of their whole 400
bytes, and windows that occur twice are removed.

Texts lie in blocks of bounded size. A block hands over its distinct ranks, sorted and
compressed, in slices by shard of the ranks; a shard adds a bucket up over the corpus and
answers every block with a bit for each of its ranks. For ranks 48 bits of the fingerprint
travel: a chance match makes candidates more, which the windows settle. Windows go the same
way with all 128 bits, in shares (``PARTS``), and the shuffle of a share is gone before the next.

Texts that occur several times are handled once: all their bytes go when they hold a
window at all. Matches never cross documents.

Nulls: a null text is empty. Texts under 400 bytes keep every byte. An empty table
gives no rows. Repeated rows are copies of each other. Texts are never cut. Result
columns replace input columns of the same names; other input columns are kept.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import _fingerprints
from .common import in_slices, partitions, split_hot_join, stage
from .language_model import _distinct, _open, _press, _slices
from .ngram_join import mix

# fixed value of the contract: the length of a repeat
WINDOW = 400
#: Period of the difference cover; sampled suffixes are ranked by WINDOW - CYCLE + 1 bytes.
CYCLE = 256
SLICE_ROWS = 64
BLOCK_BYTES = 4_000_000    # of texts in a block, and the last text's
SHARD_BYTES = 16_000_000   # of texts whose ranks or windows one shard adds up, on average
PARTS = 2                  # shares that windows are compared in, one after the other
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def difference_cover(v: int) -> list[int]:
    """{0 .. r-1} and the multiples of r, mod v, r = floor(sqrt(v)): every difference a r - b is covered."""
    r = max(1, math.isqrt(v))
    return sorted(set(range(min(r, v))) | {(a * r) % v for a in range(1, -(-v // r) + 1)})


COVER = difference_cover(CYCLE)
SAMPLE = WINDOW - CYCLE + 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = np.random.default_rng(400).integers(1, 2**63, size=(2, 256), dtype=np.int64).view(np.uint64)
_IN_COVER = np.zeros(CYCLE, bool)
_IN_COVER[COVER] = True


def _prefix(data: np.ndarray, many: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_fingerprints(_TABLES[t][data], _BASES[t]) for t in range(many)]


def _at(prefix, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple((pw[start + length] * (q[start + length] - q[start])).view(np.int64) for pw, q in prefix)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_heads (hashes and number of copies of each text), _sizes, _bytes: texts that follow one another, compressed."""
    held, total = [], 0

    def packed():
        sizes = np.array([len(x[-1]) for x in held], np.int64)
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(x[-1] for x in held))
        return pa.RecordBatch.from_pydict({"_heads": pa.array([np.array([x[:-1] for x in held], np.int64).tobytes()], pa.binary()),
                                           "_sizes": pa.array([sizes.tobytes()], pa.binary()), "_bytes": pa.array([data], pa.binary())})

    for batch in in_slices(batches, SLICE_ROWS):
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held.append(row)
            total += len(row[-1])
            if total >= BLOCK_BYTES:
                yield packed()
                held, total = [], 0
    if held:
        yield packed()


def _texts(sizes: bytes, data: bytes) -> list[np.ndarray]:
    every = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    ends = np.cumsum(np.frombuffer(sizes, np.int64))
    return [every[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _ranks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sampled suffix that can begin a window's bucket: its text, start and rank."""
    rows, starts, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row, data in enumerate(texts):
        if len(data) < WINDOW:
            continue
        s = np.arange(len(data) - SAMPLE + 1)
        s = s[_IN_COVER[s % CYCLE]]
        rows.append(np.full(len(s), row))
        starts.append(s)
        ranks.append(_at(_prefix(data, 1), s, SAMPLE)[0])
    rank = mix(np.concatenate(ranks).view(np.uint64)) & ~np.uint64(0xFFFF)
    return np.concatenate(rows), np.concatenate(starts), rank


def _windows(texts: list[np.ndarray], given: pa.Table, shards: int) -> tuple[np.ndarray, ...]:
    """Of windows with a repeated sampled suffix less than CYCLE bytes after their start: text, start, fingerprint."""
    rows, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    w1, w2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if given.num_rows:
        row, start, rank = _ranks(texts)
        order = np.argsort(rank)
        k, first = _distinct(rank[order])
        hit = np.zeros(len(rank), bool)
        hit[order] = np.repeat(_marked(given, k, shards), np.diff(np.append(first, len(rank))))
        row, start = row[hit], start[hit]
        for r in np.unique(row).tolist():
            data = texts[r]
            last = len(data) - WINDOW
            s = start[slice(*np.searchsorted(row, [r, r + 1]))]
            marks = np.zeros(last + 2, np.int64)
            np.add.at(marks, np.clip(s - CYCLE + 1, 0, last + 1), 1)
            np.add.at(marks, np.clip(s + 1, 0, last + 1), -1)
            i = np.nonzero(np.cumsum(marks)[: last + 1] > 0)[0]
            a, b = _at(_prefix(data), i, WINDOW)
            rows.append(np.full(len(i), r))
            starts.append(i)
            w1.append(a)
            w2.append(b)
    return np.concatenate(rows), np.concatenate(starts), mix(np.concatenate(w1).view(np.uint64)), np.concatenate(w2).view(np.uint64)


def _marked(given: pa.Table, k: np.ndarray, shards: int) -> np.ndarray:
    """Which of a block's ascending keys occur twice, from the answers of the shards."""
    out = np.zeros(len(k), bool)
    ends = {i: (a, b) for i, a, b in _slices(k, shards)}
    for shard, bits in zip(given.column("_shard").to_pylist(), given.column("_bits").to_pylist()):
        a, b = ends[shard]
        out[a:b] = np.unpackbits(_open(bits, np.uint8), count=b - a)
    return out


def _asked(block: int, k1: np.ndarray, k2: np.ndarray | None, many: np.ndarray, shards: int) -> pa.Table:
    """_shard, _block, _k1, _k2, _many: a block's distinct keys, and whether it holds them twice itself."""
    cut = [(i, block, _press(k1[a:b]), None if k2 is None else k2[a:b].tobytes(), _press(np.packbits(many[a:b]))) for i, a, b in _slices(k1, shards)]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in cut], t) for i, (n, t) in enumerate(zip(("_shard", "_block", "_k1", "_k2", "_many"), kinds))})


def _ask_ranks(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in in_slices(batches, 1):
            block, sizes, data = (batch.column(c)[0].as_py() for c in ("_block", "_sizes", "_bytes"))
            k, counts = np.unique(_ranks(_texts(sizes, data))[2], return_counts=True)
            yield from _asked(block, k, None, counts > 1, shards).to_batches()

    return run


def _sorted_windows(w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by fingerprint, where each distinct one begins, and how often it occurs."""
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(a)))


def _ask_windows(shards: int, part: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        texts = _texts(block.column("_sizes")[0].as_py(), block.column("_bytes")[0].as_py())
        _, _, w1, w2 = _windows(texts, given, shards)
        own = w1 % np.uint64(parts) == part
        w1, w2 = w1[own], w2[own]
        order, starts, counts = _sorted_windows(w1, w2)
        order = order[starts]
        return _asked(block.column("_block")[0].as_py(), w1[order], w2[order], counts > 1, shards)

    return run


def _settle(group: pa.Table) -> pa.Table:
    """_shard, _block, _bits: for the blocks that hold a key which occurs twice in the corpus, a bit for each of their keys."""
    blocks = group.column("_block").to_pylist()
    keys = [_open(z, np.uint64) for z in group.column("_k1").to_pylist()]
    many = [np.unpackbits(_open(z, np.uint8), count=len(k)) for z, k in zip(group.column("_many").to_pylist(), keys)]
    k1 = np.concatenate(keys)
    if group.column("_k2").null_count:
        order = np.argsort(k1)
        _, starts = _distinct(k1[order])
        counts = np.diff(np.append(starts, len(k1)))
    else:
        order, starts, counts = _sorted_windows(k1, np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("_k2").to_pylist()]))
    twice = np.empty(len(k1), bool)
    twice[order] = np.repeat((counts > 1) | np.logical_or.reduceat(np.concatenate(many).astype(bool)[order], starts), counts)
    out, at = [], 0
    for block, own in zip(blocks, keys):
        bits = twice[at:at + len(own)]
        at += len(own)
        if bits.any():
            out.append((block, _press(np.packbits(bits))))
    return pa.table({"_shard": pa.array([group.column("_shard")[0].as_py()] * len(out), pa.int64()),
                     "_block": pa.array([x[0] for x in out], pa.int64()), "_bits": pa.array([x[1] for x in out], pa.binary())})


def _cut(shards: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Result columns of a block's texts, from the answers on its ranks (``_part`` -1) and its windows."""
    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        texts = _texts(block.column("_sizes")[0].as_py(), block.column("_bytes")[0].as_py())
        heads = np.frombuffer(block.column("_heads")[0].as_py(), np.int64).reshape(-1, 3)
        asked = given.column("_part").to_numpy()
        rows, starts, w1, w2 = _windows(texts, given.filter(pa.array(asked == -1)), shards)
        gone = np.zeros(len(rows), bool)
        for part in range(parts):
            own = np.flatnonzero(w1 % np.uint64(parts) == part)
            order, first, counts = _sorted_windows(w1[own], w2[own])
            gone[own[order]] = np.repeat(_marked(given.filter(pa.array(asked == part)), w1[own][order][first], shards), counts)
        rows, starts = rows[gone], starts[gone]
        ends = np.searchsorted(rows, np.arange(len(texts) + 1))
        out = [_spans(data, int(many), starts[a:b]) for data, many, a, b in zip(texts, heads[:, 2], ends, ends[1:])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({"_h1": heads[:, 0], "_h2": heads[:, 1], "mult": heads[:, 2],
                         **{c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(RESULT, kinds))}})

    return run


def _spans(data: np.ndarray, many: int, starts: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256 from the starts of repeated windows."""
    gone = np.zeros(len(data) + 1, np.int64)
    if len(data) >= WINDOW and many > 1:
        gone[0], gone[len(data)] = 1, -1
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + WINDOW, -1)
    mask = np.cumsum(gone)[: len(data)] > 0
    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (1 if len(mask) and mask[0] else 0))
    return len(data), int(mask.sum()), spans, hashlib.sha256(data[~mask].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input rows with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    A byte goes when a 400-byte string that covers it also starts anywhere else, in the
    same document or another; strings are judged on the input.
    """
    raw = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    keep = [c for c in docs.columns if c not in RESULT]
    # the input row travels as one struct, so that its column names never meet the ones used here
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), raw.alias("_bytes"), F.monotonically_increasing_id().alias("_row"))
    d = d.select("*", F.xxhash64("_bytes").alias("_h1"), F.xxhash64("_bytes", F.lit("second")).alias("_h2"))
    copies = d.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("mult"), F.min("_row").alias("_row"))
    unique = d.select("_row", "_h1", "_h2", "_bytes").join(copies.select("_row", "mult"), "_row").select("_h1", "_h2", "mult", "_bytes")
    blocks = stage(unique.mapInArrow(_in_blocks, "_heads binary, _sizes binary, _bytes binary").withColumn("_block", F.monotonically_increasing_id()))
    size = d.agg(F.sum(F.length("_bytes"))).first()[0] or 0
    shards = max(partitions(docs), math.ceil(size / SHARD_BYTES))

    asked = "_shard long, _block long, _k1 binary, _k2 binary, _many binary"
    settled = "_shard long, _block long, _bits binary"
    texts = blocks.select("_block", "_sizes", "_bytes").groupBy("_block")
    ranks = stage(blocks.select("_block", "_sizes", "_bytes").mapInArrow(_ask_ranks(shards), asked).groupBy("_shard").applyInArrow(_settle, settled))
    answers = [ranks.withColumn("_part", F.lit(-1))]
    for part in range(PARTS):
        windows = texts.cogroup(ranks.groupBy("_block")).applyInArrow(_ask_windows(shards, part, PARTS), asked)
        answers.append(stage(windows.groupBy("_shard").applyInArrow(_settle, settled)).withColumn("_part", F.lit(part)))
    result = stage(blocks.groupBy("_block").cogroup(reduce(DataFrame.union, answers).groupBy("_block")).applyInArrow(
        _cut(shards, PARTS), "_h1 long, _h2 long, mult long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    joined = split_hot_join(d.select("_doc", "_h1", "_h2", "_row"), result, ["_h1", "_h2"], "mult", ["_row"])
    return joined.select(*[F.col("_doc").getField(c).alias(c) for c in keep], *RESULT)
