"""Exact Jaccard join of word n-gram sets with a prefix tree.

All n-grams are put in one global order, rare ones first; how rare is judged by a
sketch of fixed size over all documents, which only orders and never decides.  Two
sets that link have a common n-gram among the first few of both (their prefixes),
so sets meet in blocks by n-gram of their prefixes.  Blocks with the same members are
merged into one, with the best place of each member.  Blocks do not expand into pairs:
in every round each block compares its members with some of them (``PIVOTS``), drawn by a hash, and
links merge members into components; a block whose members are all in one component
is done.  After these rounds the pairs that are still in different components
and can still link by size and position are compared, so no link between components is lost.

A pair is judged by bitmaps of its sets first (a bit or two a member): a bit that only one of
them has stands for members that the other lacks, which bounds the overlap from above.
Only sets of pairs that can still link travel.

Sets that meet a pivot are stored in a prefix tree (as sorted sets and the lengths of
their common prefixes).  The tree is walked once for the pivot; overlaps of shared
prefixes are counted once, and a subtree is left as soon as what remains of the set and
of the pivot cannot bring the overlap to what is needed.

Equal sets are one class from the start: a 64-bit hash of the ordered set.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hand_back, handing_back, in_slices, partitions, stage, whole
from .components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4      # similarity of 0.75 or more
SKETCH_BITS = 19                   # counters of the sketch: 2 MB, whatever the input
FILTER_BITS = 24                   # bits of the filter of candidate rows: 2 MB, whatever the input
PIVOTS = (16, 128)                 # of a block, in each round; later ones are for the few that are still apart
MERGED_ROWS = 100_000              # longer blocks are not compared with others
BROADCAST_PAIRS = 400_000          # so many pairs of keys are sent to where the sets are; more are joined
GROUP_SETS = 1_000                 # sets that meet a pivot in one task
_BLOCK = 1 << 10
_KEPT_WORDS = 200_000
_STEP = 64                         # members of a set between two tests of the remaining-length bound

_FACTORS = np.random.default_rng(9).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words, kept by the worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased on request."""
    data = text.encode("utf-8", "surrogatepass")
    words = (data.lower() if lower else data).split()     # of bytes, both mean ASCII alone
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words."""
    count = len(words) - n + 1
    if count < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h += words[k:k + count] * _factor(k)
    return mix(h)


def rolling_at(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-th window of ``n`` words, those that do not overlap."""
    rows = words[:len(words) // n * n].reshape(-1, n)
    h = np.zeros(len(rows), np.uint64)
    for k in range(n):
        h += rows[:, k] * _factor(k)
    return mix(h)


def _factor(k: int) -> np.uint64:
    return np.uint64(int(_FACTORS[k % 16]) * (2 * (k // 16) + 1) & (2**64 - 1))


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text; of fewer words the whole sequence as one; none without words."""
    words = word_hashes(text)
    if 0 < len(words) < n:
        return mix(np.array([int.from_bytes(xxhash.xxh3_64_digest(words.tobytes() + bytes([len(words)])), "little")], np.uint64))
    return np.unique(rolling(words, n))


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of a task the blocks of its sketch."""
    names = ["_row", "_id", "_key", "_n", "_block", "_counts"]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    kind = None
    for batch in in_slices(batches):
        kind = batch.column(1).type
        sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
        keys, sizes = [_key(s) for s in sets], [len(s) for s in sets]
        at = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        sketch += np.bincount(at, minlength=len(sketch)).astype(np.uint32)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()),
                                          pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    blocks = sketch.reshape(-1, _BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    if kind is not None and len(used):
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                                          pa.array(used, pa.int32()), pa.array([blocks[i].astype("<u4").tobytes() for i in used], pa.binary())],
                                         names=names)


def _sum_blocks(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in group.column("_counts").to_pylist())
    return pa.table({"_block": group.column("_block")[:1].cast(pa.int32()),
                     "_counts": pa.array([np.minimum(total, 2**24 - 1).astype("<u4").tobytes()], pa.binary())})


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def needed(a: np.ndarray | int, b: np.ndarray | int):
    """Smallest overlap at which sets of these sizes link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def member_bits(s: np.ndarray) -> bytes:
    """A bit for the leading bits of every member; two to four bits a member, at least 64."""
    size = max(6, int(2 * len(s) - 1).bit_length())
    flags = np.zeros(1 << size, np.uint8)
    flags[(s >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def can_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Whether sets of these sizes and bitmaps can overlap enough."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) != len(y):             # of several sizes, the finer one is folded
        x, y = (z if len(z) <= min(len(x), len(y)) else _folded(z, min(len(x), len(y))) for z in (x, y))
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(n - only_a, m - only_b) >= needed(n, m)


def _folded(z: np.ndarray, words: int) -> np.ndarray:
    flags = np.unpackbits(z.view(np.uint8), bitorder="little").reshape(words * 64, -1).any(axis=1)
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for the overlap."""
    for batch in handing_back(batches):
        keep = [can_link(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of the blocks that have two classes or more, from rows sorted by (token, key).

    A block is named by a hash of its members, so that equal ones get one name; one of
    more than ``MERGED_ROWS`` rows keeps its token as name and streams through.
    """
    held: list[np.ndarray] | None = None       # rows of the unfinished block
    long = False                               # it streams; of its rows only the last is held

    def out(t, k, n, p):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (t, k, n, p)], names=["_token", "_key", "_n", "_at"])

    def named(t, k, n, p):
        """Finished blocks under the names of their members."""
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        lengths = np.diff(np.append(starts, len(t)))
        names = np.add.reduceat(mix(k.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)), starts) ^ mix(lengths.astype(np.uint64))
        rows = np.repeat(lengths > 1, lengths)
        return out(np.repeat(names, lengths)[rows].view(np.int64), k[rows], n[rows], p[rows])

    for batch in handing_back(batches):
        t, k, n, p = (batch.column(i).to_numpy() for i in range(4))
        if not len(t):
            continue
        if held is not None:
            t, k, n, p = (np.concatenate([h, x]) for h, x in zip(held, (t, k, n, p)))
        keep = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        t, k, n, p = t[keep], k[keep], n[keep], p[keep]
        if long:
            end = int(np.searchsorted(t != t[0], True))       # rows of the block that streams; its first was sent
            if end > 1:
                yield out(t[1:end], k[1:end], n[1:end], p[1:end])
            if end == len(t):
                held = [x[-1:] for x in (t, k, n, p)]
                continue
            t, k, n, p, long = t[end:], k[end:], n[end:], p[end:], False
        last = int(np.flatnonzero(np.append(True, t[1:] != t[:-1]))[-1])
        if last:
            yield named(t[:last], k[:last], n[:last], p[:last])
        held = [x[last:] for x in (t, k, n, p)]
        if len(held[0]) > MERGED_ROWS:
            yield out(*held)
            held, long = [x[-1:] for x in held], True
    if held is not None and not long:
        yield named(*held)


def walk(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Places of the sets that link with ``query``, by one walk of their prefix tree."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    out: list[int] = []
    before, hits, left_at = None, np.zeros(1, np.int64), None   # hits[d]: overlap of the first d members
    for i in order:
        s = sets[i]
        shared = 0
        if before is not None:
            m = min(len(before), len(s))
            differ = np.flatnonzero(before[:m] != s[:m])
            shared = int(differ[0]) if len(differ) else m
        shared = min(shared, len(hits) - 1)
        need = int(needed(len(query), len(s)))
        counts, depth, found = [hits[:shared + 1]], shared, int(hits[shared])
        behind = int(np.searchsorted(query, s[depth - 1], "right")) if depth else 0
        while depth < len(s) and found + min(len(s) - depth, len(query) - behind) >= need:
            part = s[depth:depth + _STEP]
            places = np.searchsorted(query, part)
            same = query[np.minimum(places, len(query) - 1)] == part
            counts.append(found + np.cumsum(same))
            found, depth, behind = int(counts[-1][-1]), depth + len(part), int(places[-1])
        hits, before = np.concatenate(counts), s[:depth]
        if depth == len(s) and found >= need:
            out.append(i)
    return out


def join_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id it is linked with, directly or not).

    Null and empty texts, and texts without words, have no n-grams and stay alone, as does
    a row with a null id that equals no other.  Repeated rows and equal texts share a class.
    Other columns are not read.  The input is read three times and should come from files.
    """
    out = joined_rows(df, doc_id, text)
    return out.select(F.col("_id").alias(doc_id), "n_shingles", F.coalesce("_first._id", "_id").alias("component_id"))


def surplus_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places ``_row`` (as ``monotonically_increasing_id`` numbers the input) of rows that another row stands for.

    Of rows that link, directly or not, the one with the smallest id stays, of equal ids the
    one that comes first; null ids come after all others.  Rows that repeat its id and its
    n-grams are the same document, and stay with it.
    """
    same = F.coalesce((F.col("_id") == F.col("_first._id")) & (F.col("_key") == F.col("_first._key")), F.lit(False))
    return joined_rows(df, doc_id, text).filter((F.col("_row") != F.col("_first._row")) & ~same).select("_row")


def joined_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_row, _id, _key, n_shingles, _first)``: of each row its class, and the first row that it is linked with, null without n-grams."""
    id_type = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    described = stage(docs.mapInArrow(
        _describe, f"_row long, _id {id_type}, _key long, _n int, _block int, _counts binary"))
    classes = described.filter("_block is null").select("_row", "_id", "_key", "_n")
    sums = described.filter("_block is not null").select("_block", "_counts").groupBy("_block").applyInArrow(
        _sum_blocks, "_block int, _counts binary").collect()          # at most 2 MB by SKETCH_BITS
    counts = np.zeros((1 << SKETCH_BITS) // _BLOCK * _BLOCK, np.uint32).reshape(-1, _BLOCK)
    for r in sums:
        counts[r["_block"]] = np.frombuffer(r["_counts"], "<u4")
    spark = df.sparkSession
    rarity = spark.sparkContext.broadcast(counts.reshape(-1))

    def postings(batches):
        common = rarity.value
        for batch in in_slices(batches):
            tokens, keys, sizes, places = [], [], [], []
            for t in batch.column(0).to_pylist():
                s = shingle_set(t)
                if not len(s):
                    continue
                p = prefix_length(len(s))
                rank = (common[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
                first = np.argsort(rank, kind="stable")[:p]
                tokens.append(s[first].view(np.int64))
                keys.append(np.full(p, _key(s)))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes, places)],
                                                 names=["_token", "_key", "_n", "_at"])

    shape = "_token long, _key long, _n int, _at int"
    blocks = stage(docs.select("_text").mapInArrow(postings, shape).repartition(partitions(df), "_token")
                   .sortWithinPartitions("_token", "_key").mapInArrow(_live, shape)
                   .groupBy("_token", "_key").agg(F.max("_n").alias("_n"), F.min("_at").alias("_at")))

    # sets of the classes that stand in a block, of one document each
    firsts = classes.groupBy("_key").agg(F.min("_row").alias("_row"))
    wanted = stage(blocks.select("_key").distinct().join(firsts, "_key").select("_key", "_row"))
    bits = wanted.select((F.pmod(F.xxhash64("_row"), F.lit(1 << FILTER_BITS))).alias("b")).distinct().select(
        F.shiftright("b", 13).alias("_block"), F.col("b").bitwiseAND(F.lit(8191).cast("long")).alias("b"))
    bitmap = np.zeros(1 << FILTER_BITS, bool).reshape(-1, 8192)
    for r in bits.groupBy("_block").agg(F.collect_list(F.col("b").cast("short")).alias("b")).toLocalIterator():  # bounded by FILTER_BITS
        bitmap[r["_block"], r["b"]] = True
    maybe = spark.sparkContext.broadcast(np.packbits(bitmap.reshape(-1)))

    def sets(batches):
        held = maybe.value
        for batch in in_slices(batches):
            bit = batch.column(0).to_numpy()
            passed = (held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
            found = [shingle_set(t) for t in batch.column(1).filter(pa.array(passed)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()),
                                              pa.array([member_bits(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                                             names=["_key", "_n", "_bits", "_set"])

    # a bit may let a row more pass, which does no harm: its set is one that is here or that no pair names
    store = stage(docs.select(F.pmod(F.xxhash64("_row"), F.lit(1 << FILTER_BITS)).alias("_bit"), "_text")
                  .mapInArrow(sets, "_key long, _n int, _bits binary, _set binary"))

    roots = None          # (node, root) of classes that are linked so far
    links = None
    for turn in range(len(PIVOTS) + 1):
        pairs = stage(_possible(_pairs(blocks, roots, None if turn == len(PIVOTS) else turn), store))
        if not pairs.take(1):       # pairs without a pivot are still to come
            continue
        new = stage(_compare(pairs, store))
        links = new if links is None else links.union(new)
        if not new.take(1):
            continue
        roots = stage(components(links))

    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row", "_key")).alias("_first")
    named = classes.filter("_n > 0").groupBy("_key").agg(first)
    if roots is not None:
        least = (named.join(roots.select(F.col("node").alias("_key"), "root"), "_key", "left")
                 .select("_key", F.coalesce("root", "_key").alias("root"), "_first"))
        smallest = least.groupBy("root").agg(F.min("_first").alias("_first"))
        named = stage(least.select("_key", "root").join(smallest, "root").select("_key", "_first"))
    return classes.join(named, "_key", "left").select("_row", "_id", "_key", F.col("_n").cast("long").alias("n_shingles"), "_first")


def _pairs(blocks: DataFrame, roots: DataFrame | None, turn: int | None) -> DataFrame:
    """Distinct pairs ``(_pivot, _key)`` to compare: with the pivots of their block, or without a turn all that are left."""
    if roots is not None:
        blocks = blocks.join(roots.select(F.col("node").alias("_key"), "root"), "_key", "left")
        blocks = blocks.withColumn("_part", F.coalesce("root", "_key")).drop("root")
    else:
        blocks = blocks.withColumn("_part", F.col("_key"))
    size = F.col("_n") - F.col("_at")
    need = F.ceil(F.lit(float(NUMERATOR)) * (F.col("_n") + F.col("_pn")) / F.lit(float(NUMERATOR + DENOMINATOR)))
    able = (F.col("_part") != F.col("_ppart")) & (F.least(size, F.col("_pn") - F.col("_pat")) >= need)
    if roots is not None:
        open_blocks = blocks.groupBy("_token").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).filter("a <> b").select("_token")
        blocks = blocks.join(open_blocks, "_token")
    blocks = blocks.withColumn("_rank", F.xxhash64("_key", F.lit(turn)))
    pivots = blocks
    if turn is not None:
        pivots = blocks.withColumn("_place", F.row_number().over(Window.partitionBy("_token").orderBy("_rank", "_key"))).filter(F.col("_place") <= PIVOTS[turn])
    # of two pivots one asks the other
    able = able & (F.struct("_rank", "_key") > F.struct("_prank", "_pivot"))
    pivots = pivots.select("_token", F.col("_key").alias("_pivot"), F.col("_n").alias("_pn"), F.col("_at").alias("_pat"),
                           F.col("_part").alias("_ppart"), F.col("_rank").alias("_prank"))
    return blocks.join(pivots, "_token").filter(able).select("_pivot", "_key").distinct()


def _possible(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs that can link by the bitmaps of their sets."""
    bits = store.select("_key", "_n", "_bits")
    both = (pairs.join(bits.toDF("_pivot", "_pn", "_pbits"), "_pivot").join(bits, "_key")
            .select("_pivot", "_key", "_pn", "_n", "_pbits", "_bits"))
    return both.mapInArrow(_able, "_pivot long, _key long")


def _compare(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among the pairs; the sets that meet one pivot are spread over groups of bounded size."""
    sent = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda df: df
    shares = pairs.groupBy("_pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_SETS)).alias("_shares"))
    wanted = shares.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)))
    queries = (store.select(F.col("_key").alias("_pivot"), "_set").join(sent(wanted), "_pivot")
               .select("_pivot", "_share", "_set").toDF("_query", "_part", "_set"))
    dealt = pairs.join(shares, "_pivot").select("_pivot", "_key", F.pmod(F.xxhash64("_key"), F.col("_shares")).alias("_share"))
    members = store.join(sent(dealt), "_key").select("_pivot", "_share", "_key", "_set")

    def meet(one: pa.Table, many: pa.Table) -> pa.Table:
        if not one.num_rows or not many.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        query = np.frombuffer(one.column("_set")[0].as_py(), np.uint64)
        keys = many.column("_key").to_pylist()
        found = walk(query, [np.frombuffer(x, np.uint64) for x in many.column("_set").to_pylist()])
        pivot = one.column("_query")[0].as_py()
        if len(keys) * 10 > GROUP_SETS:
            del many
            hand_back()
        return pa.table({"a": pa.array([pivot] * len(found), pa.int64()), "b": pa.array([keys[i] for i in found], pa.int64())})

    return queries.groupBy("_query", "_part").cogroup(members.groupBy("_pivot", "_share")).applyInArrow(meet, "a long, b long")
