"""Binary shards of token ids: one zstandard frame per document, one shared dictionary.

A shard is one self-contained block of bytes of bounded size:

    magic "SLID1" | id width (1 byte) | dictionary hash (16 bytes) | number of documents (u32)
    | id counts (u32 each) | frame ends (u32 each) | frames

A shard lists which ids it holds in its row, so readers of single documents skip
other shards by the statistics of the files and then one frame by its offset.
Shards are rows of a Parquet table, so any store that Spark writes to will do.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole
from .tokens import encoder, four_bytes

MAGIC = b"SLID1"
SHARD_BYTES = 4_000_000       # ids of a shard before compression; a longer document has a shard of its own
SAMPLE_DOCS = 1_000           # documents the dictionary is trained on, about so many, chosen by a hash
SAMPLE_BYTES = 2_000          # of each of them
DICTIONARY_BYTES = 64_000
_SHARD_BITS = 24


def train_dictionary(docs: DataFrame, tokenizer: str, text: str = "text") -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample; empty where there is too little to learn."""
    share = max(1, docs.count() // SAMPLE_DOCS)
    rows = (docs.select(whole(text).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(share)) == 0)
            .select(F.left("t", F.lit(SAMPLE_BYTES)).alias("t")).distinct().limit(2 * SAMPLE_DOCS).collect())
    rows.sort(key=lambda r: r.t)
    enc = encoder(tokenizer)
    samples = [x[:SAMPLE_BYTES] for x in enc.in_slices([r.t for r in rows]) if x]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:    # equal or tiny samples hold nothing to share
        return b""


def dictionary_hash(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:16]


def build_shard(ids: Sequence[bytes], width: int, payload: bytes) -> bytes:
    shared = zstandard.ZstdCompressionDict(payload) if payload else None
    press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    frames = [press.compress(x) for x in ids]
    counts = np.array([len(x) // width for x in ids], "<u4").tobytes()
    ends = np.cumsum([len(f) for f in frames], dtype=np.int64).astype("<u4").tobytes()
    return b"".join([MAGIC, bytes([width]), dictionary_hash(payload), len(ids).to_bytes(4, "little"), counts, ends, *frames])


class Shard:
    """Reads a shard; single documents by position, without touching the others."""

    def __init__(self, blob: bytes, payload: bytes):
        if blob[:5] != MAGIC or blob[6:22] != dictionary_hash(payload):
            raise ValueError("not a shard of this dictionary")
        self.blob, self.dtype = blob, np.dtype(f"<u{blob[5]}")
        n = int.from_bytes(blob[22:26], "little")
        self.counts = np.frombuffer(blob, "<u4", n, 26)
        self.ends = np.frombuffer(blob, "<u4", n, 26 + 4 * n)
        self.at = 26 + 8 * n
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(payload) if payload else None)

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        return np.frombuffer(self.unzip.decompress(self.blob[self.at + a:self.at + b]), self.dtype)


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, doc_id: str = "doc_id",
                 text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode, and write shards in ascending order of the id under ``path``.

    Tables: ``shards`` (shard_id, ids of its documents, n_docs, n_tokens, blob) and
    ``dictionary`` (payload).  Shards ascend with the id; a null id comes first and
    a null text is the end id alone; rows of one id follow one another by text.
    """
    docs = df.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    payload = train_dictionary(docs, tokenizer, "_text")
    spark = df.sparkSession
    spark.createDataFrame([(bytearray(payload),)], "payload binary").coalesce(1).write.parquet(f"{path}/dictionary")
    id_type = df.schema[doc_id].dataType.simpleString()

    def build(batches):
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), TaskContext.get().partitionId() << _SHARD_BITS
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        held: list[bytes] = []
        owners: list = []
        kind = None

        def shard():
            nonlocal held, owners, number
            blob = build_shard(held, enc.dtype.itemsize, payload)
            row = pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([owners], pa.list_(kind)), pa.array([owners[0]], kind), pa.array([owners[-1]], kind),
                pa.array([sum(map(len, held)) // enc.dtype.itemsize], pa.int64()), pa.array([blob], pa.binary())],
                names=["shard_id", "ids", "first_id", "last_id", "n_tokens", "blob"])
            held, owners, number = [], [], number + 1
            return row

        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for own, ids in zip(batch.column(0).to_pylist(), enc.in_slices(batch.column(1).to_pylist())):
                if held and size + len(ids) + len(tail) > shard_bytes:
                    yield shard()
                    size = 0
                held.append(ids + tail)
                owners.append(own)
                size += len(held[-1])
        if held:
            yield shard()

    (docs.repartitionByRange(F.col("_id"), F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
     .mapInArrow(build, f"shard_id long, ids array<{id_type}>, first_id {id_type}, last_id {id_type}, n_tokens long, blob binary")
     .write.parquet(f"{path}/shards"))


def read_shards(spark: SparkSession, path: str, ids: Sequence | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Documents of written shards: id, ``start``, ``n_tokens``, ``ids_crc32``, ``ids``; only those of ``ids``, if given.

    ``start`` counts the ids of all documents before it; shard totals are summed per
    writing task and then over tasks, so no task sees more than one row per shard.
    """
    shards = spark.read.parquet(f"{path}/shards")
    payload = bytes(spark.read.parquet(f"{path}/dictionary").head().payload)
    part = F.shiftright("shard_id", _SHARD_BITS)
    sizes = shards.select("shard_id", part.alias("_part"), "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row per writing task, as many as the range partitioning had partitions
    parts = sizes.groupBy("_part").agg(F.sum("n_tokens").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    starts = sizes.join(parts, "_part").select("shard_id", (F.col("_base") + F.coalesce(
        F.sum("n_tokens").over(before(Window.partitionBy("_part").orderBy("shard_id"))), F.lit(0))).alias("_start"))
    wanted = None if ids is None else set(ids)
    if wanted is not None:
        bounds = [i for i in wanted if i is not None]
        near = F.lit(False) if not bounds else (F.col("last_id") >= min(bounds)) & (F.col("first_id") <= max(bounds))
        shards = shards.filter(near | F.col("first_id").isNull() if None in wanted else near)
    kind = shards.schema["first_id"].dataType.simpleString()

    def unpack(batches):
        for batch in batches:
            id_kind = batch.column(1).type.value_type
            for own, start, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shard = Shard(blob, payload)
                places = np.cumsum(shard.counts, dtype=np.int64) - shard.counts + start
                take = [i for i in range(len(shard)) if wanted is None or own[i] in wanted]
                found = [shard[i] for i in take]
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[i] for i in take], id_kind), pa.array(places[take], pa.int64()),
                    pa.array(shard.counts[take], pa.int64()), pa.array([zlib.crc32(four_bytes(x)) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary())],
                    names=[doc_id, "start", "n_tokens", "ids_crc32", "ids"])

    return shards.join(starts, "shard_id").select("shard_id", "ids", "_start", "blob").mapInArrow(
        unpack, f"`{doc_id}` {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
