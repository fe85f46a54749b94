"""First-fit-decreasing packing with a tournament tree, in randomised groups of documents.

A group is a few hundred documents that a hash puts together; it is encoded,
packed and described in one task, and groups are independent, so that the work
spreads over any number of tasks and a lost one is simply done again.

Inside a group documents are cut into full sequences and one rest each.  Rests go,
longest first, into the first bin that has room, found by descending a tournament
tree of bin capacities.  Gaps that remain are filled by cutting pieces of the
emptiest bins, and the last bin is split into sequences of power-of-two lengths,
which need no padding.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole
from .tokens import encoder, four_bytes

GROUP_DOCS = 512         # expected documents in a group
_GROUP_SEQUENCES = 32    # bits for the sequences of one group


class Tournament:
    """Bin capacities as leaves; every inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)
        for i in range(bins, self.leaves):
            self.best[self.leaves + i] = 0
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def place(self, size: int) -> int:
        """Index of the first bin with room for ``size``, whose capacity shrinks by it."""
        i = 1
        while i < self.leaves:
            i = 2 * i if self.best[2 * i] >= size else 2 * i + 1
        found = i - self.leaves
        self.best[i] -= size
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])
        return found


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover every document."""
    full, rests = [], []
    for doc, n in enumerate(lengths):
        whole_part = n - n % size
        full += [[(doc, s, size)] for s in range(0, whole_part, size)]
        if n > whole_part:
            rests.append((n - whole_part, doc, whole_part))
    rests.sort(key=lambda r: (-r[0], r[1]))
    if not rests:
        return full
    tree, bins = Tournament(len(rests), size), {}
    for n, doc, start in rests:
        bins.setdefault(tree.place(n), []).append((doc, start, n))
    open_bins = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    done, front, back = [], 0, len(open_bins) - 1
    while front < back:                      # the emptiest bin gives, the fullest takes
        room = size - sum(p[2] for p in open_bins[front])
        while room and front < back:
            doc, start, n = open_bins[back].pop()
            take = min(n, room)
            open_bins[front].append((doc, start, take))
            room -= take
            if take < n:
                open_bins[back].append((doc, start + take, n - take))
            if not open_bins[back]:
                back -= 1
        done.append(open_bins[front])
        front += 1
    if front == back:
        done += _powers(open_bins[front], size)
    return full + done


def _powers(pieces: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of one bin as sequences whose lengths are powers of two (or ``size``)."""
    left, out = sum(p[2] for p in pieces), []
    pieces = list(reversed(pieces))
    while left:
        goal = size if left >= size else 1 << (left.bit_length() - 1)
        room, sequence = goal, []
        while room:
            doc, start, n = pieces.pop()
            take = min(n, room)
            sequence.append((doc, start, take))
            room -= take
            if take < n:
                pieces.append((doc, start + take, n - take))
        out.append(sequence)
        left -= goal
    return out


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, doc_id: str = "doc_id",
                   text: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    One row per piece: the id, ``start``, ``length``, ``ids_crc32`` (of 32-bit ids),
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.  A null or empty text is the end id
    alone.  Groups are dealt by a hash of id and text; rows equal in both are told
    apart by their place.  Other columns are not read.  An empty table gives no row.
    """
    groups = max(1, math.ceil(df.count() / group_docs))
    id_type = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    docs = docs.select(F.pmod(F.xxhash64("_id", "_row"), F.lit(groups)).alias("_group"), "_id", "_row", "_text")

    def packed(group: pa.Table) -> pa.Table:
        enc = encoder(tokenizer)
        group = group.sort_by("_row")
        number = group.column("_group")[0].as_py()
        ids = [np.append(enc.array(x), np.array([end_id], enc.dtype)) for x in enc.in_slices(group.column("_text").to_pylist())]
        rows, cols = [], {k: [] for k in ("start", "length", "crc", "total", "sequence", "offset", "ids")}
        for s, sequence in enumerate(pack([len(x) for x in ids], size)):
            offset = 0
            for doc, start, n in sequence:
                piece = ids[doc][start:start + n]
                rows.append(doc)
                for k, v in (("start", start), ("length", n), ("crc", zlib.crc32(four_bytes(piece))), ("total", len(ids[doc])),
                             ("sequence", (number << _GROUP_SEQUENCES) + s), ("offset", offset), ("ids", piece.tobytes())):
                    cols[k].append(v)
                offset += n
        long = [pa.array(cols[k], pa.int64()) for k in ("start", "length", "crc", "total", "sequence", "offset")]
        own = group.column("_id").combine_chunks().take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([own, *long, pa.array(cols["ids"], pa.binary())], names=[
            doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return docs.groupBy("_group").applyInArrow(
        packed, f"`{doc_id}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
