"""BPE encoding and decoding with content-defined chunk reuse.

Documents are cut into chunks where a rolling hash of the last 32 bytes says so,
so that passages shared by documents yield the same chunks wherever they stand.
Chunks that occur in more than one document are encoded once, in the task of the
document that owns them, and their ids travel to the other documents.  A chunk's
first and last few bytes depend on its neighbours: only the ids between its first
and its last border are kept, and the join between two chunks is re-encoded from
the last border on its left to the first one on its right, growing over chunks
that have none, until both sides agree with the encoding of the whole text.  A
border is a space after a visible ASCII character, where every byte-level
pre-token ends; there the agreement is exact.

Rows move twice: compressed texts by row number, and the ids of shared chunks.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, whole
from .tokens import encoder, four_bytes

CUT_BITS = 10            # a cut every 1,024 bytes on average
MIN_CHUNK = 256
_BORDER = re.compile(rb"(?<=[!-~]) ")
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``; the last one is its length."""
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            shifted = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += shifted
    found = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, last = [], 0
    for e in found.tolist():
        if e - last >= MIN_CHUNK and e < len(b) and (data[e] & 0xC0) != 0x80:
            ends.append(e)
            last = e
    if last < len(b):
        ends.append(len(b))
    return ends


def body(chunk: bytes) -> tuple[int, int] | None:
    """First and last border of a chunk, None if it has fewer than two."""
    m = _BORDER.search(chunk)
    if m is None:
        return None
    last = chunk.rfind(b" ")
    while last > m.start() and not 33 <= chunk[last - 1] <= 126:
        last = chunk.rfind(b" ", 0, last)
    return (m.start(), last) if last > m.start() else None


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed, ends, hashes = [], [], []
        for text in batch.column(2).to_pylist():
            data = text.encode()
            cuts = chunk_ends(data)
            packed.append(squeeze.compress(data))
            ends.append(cuts)
            starts = [0, *cuts[:-1]]
            hashes.append([xxhash.xxh3_64_intdigest(data[a:b]) - 2**63 for a, b in zip(starts, cuts)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()),
                                          pa.array(ends, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                                         names=["_row", "_id", "_z", "_ends", "_hashes"])


def encode_decode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (little-endian, see ``Encoder.dtype``), ``ids_sha256``
    (of 32-bit ids) and ``decoded_sha256``.

    A null text counts as the empty one: no ids, the hash of nothing.  Rows are told
    apart by their place, so null or repeated ids stay as they are.  Other columns
    are not read, whatever their names.  An empty table gives an empty result.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    chunked = docs.mapInArrow(_chunked, f"_row long, _id {id_type}, _z binary, _ends array<int>, _hashes array<long>")

    uses = stage(chunked.select("_row", F.explode(F.array_distinct("_hashes")).alias("_hash")))
    shared = uses.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row")).filter("_n > 1")
    owned = shared.groupBy("_row").agg(F.collect_list("_hash").alias("_own"))

    def encode_owned(batches):
        enc, unzip = encoder(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            cols = batch.to_pydict()
            names, texts = [], []
            for z, ends, hashes, own in zip(cols["_z"], cols["_ends"], cols["_hashes"], cols["_own"]):
                if not own:
                    continue
                data, wanted = unzip.decompress(z), set(own)
                for a, b, h in zip([0, *ends[:-1]], ends, hashes):
                    if h in wanted:
                        wanted.discard(h)
                        span = body(data[a:b])
                        if span:
                            names.append(h)
                            texts.append(data[a + span[0]:a + span[1]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(list(enc.in_slices(texts)), pa.binary())],
                                             names=["_hash", "_ids"])

    # a left join, as below: both then read one and the same exchange of the texts
    bodies = chunked.join(owned, "_row", "left").select(
        "_row", "_id", "_z", "_ends", "_hashes", "_own").mapInArrow(encode_owned, "_hash long, _ids binary")
    given = (uses.join(bodies, "_hash").groupBy("_row")
             .agg(F.collect_list(F.struct("_hash", "_ids")).alias("_given")))

    def finish(batches):
        enc, unzip = encoder(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            cols = batch.to_pydict()
            out = {"ids": [], "n": [], "sha": [], "text_sha": []}
            for z, ends, hashes, given in zip(cols["_z"], cols["_ends"], cols["_hashes"], cols["_given"]):
                data, known = unzip.decompress(z), {g["_hash"]: g["_ids"] for g in given or ()}
                at, loose, parts = 0, [], []      # loose: texts between shared bodies, encoded here
                for a, b, h in zip([0, *ends[:-1]], ends, hashes):
                    if h in known:
                        first, last = body(data[a:b])
                        loose.append(data[at:a + first].decode())
                        parts.append(known[h])
                        at = a + last
                loose.append(data[at:].decode())
                joined = enc.encode(loose)
                ids = b"".join(x for pair in zip(joined, parts) for x in pair) + joined[-1]
                array = enc.array(ids)
                out["ids"].append(ids)
                out["n"].append(len(array))
                out["sha"].append(hashlib.sha256(four_bytes(array)).hexdigest())
                out["text_sha"].append(hashlib.sha256(enc.decode(array).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), pa.array(out["n"], pa.int64()),
                                              pa.array(out["ids"], pa.binary()), pa.array(out["sha"], pa.string()),
                                              pa.array(out["text_sha"], pa.string())],
                                             names=[doc_id, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return (chunked.join(given, "_row", "left").select("_row", "_id", "_z", "_ends", "_hashes", "_given")
            .mapInArrow(finish, f"`{doc_id}` {id_type}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"))
