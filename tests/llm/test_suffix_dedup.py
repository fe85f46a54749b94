import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from brute import edge_rows

from sheetloom.llm import suffix_dedup
from sheetloom.llm.queries import QUERIES


def brute(rows, w=400):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), every window against every other place."""
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(hashlib.blake2b(b[i:i + w], digest_size=16).digest() for _, b in data for i in range(len(b) - w + 1))
    out = {}
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[hashlib.blake2b(b[i:i + w], digest_size=16).digest()] > 1:
                gone[i:i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_cover_meets_every_difference():
    for v in (7, 64, 256, 300):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_op12_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_suffix_dedup"](spark, sf_dir)) == brute(rows)


def test_op12_edges(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh éß") for _ in range(700))
    rows = edge_rows() + [(30, "x" * 399), (31, "x" * 399), (32, "y" * 400), (33, "q" + passage[:450] + "r"), (34, passage[200:] + "tail"),
                          (35, passage[:399] + "Z" + passage[:399]), (36, passage[:401] * 2)]
    frame = spark.createDataFrame([(k, t, 1, "a", 2) for k, t in rows], "doc_id long, text string, _row long, _bytes string, n_bytes int")
    result = suffix_dedup.remove_repeats(frame)
    assert set(result.columns) >= {"doc_id", "text", "_row", "_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    assert got(result) == brute(rows)
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_op12_shards_settle_ranks_and_windows():
    w = np.array([5, 5, 9, 2**63], np.uint64)
    blocks = {0: (w, np.array([1, 2, 1, 1], np.uint64), [0, 0, 0, 1]), 1: (w[:3], np.array([1, 3, 2], np.uint64), [0, 0, 0])}
    asked = pa.concat_tables([suffix_dedup._asked(k, a, b, np.array(many, bool), 1) for k, (a, b, many) in blocks.items()])
    told = suffix_dedup._settle(asked)
    marked = {k: suffix_dedup._marked(told.filter(pa.array(told.column("_block").to_numpy() == k)), a, 1).tolist() for k, (a, _, _) in blocks.items()}
    assert marked == {0: [True, False, False, True], 1: [True, False, False]}      # all 128 bits count, and repeats inside a block
    ranks = pa.concat_tables([suffix_dedup._asked(k, a, None, np.zeros(len(a), bool), 1) for k, a in ((0, w[1:]), (1, w[1:2]))])
    assert suffix_dedup._marked(suffix_dedup._settle(ranks), w[1:], 1).tolist() == [True, False, False]


def test_op12_sends_few_bytes_a_rank():
    rng = np.random.default_rng(2)
    texts = [(i, 0, 1, rng.integers(32, 127, 40_000, dtype=np.uint8).tobytes()) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts)], names=["_h1", "_h2", "mult", "_bytes"])
    (block,) = suffix_dedup._in_blocks([batch])
    sent = pa.Table.from_batches(suffix_dedup._ask_ranks(4)([block.append_column("_block", pa.array([7], pa.int64()))]))
    ranks = len(suffix_dedup._ranks(suffix_dedup._texts(block.column("_sizes")[0].as_py(), block.column("_bytes")[0].as_py()))[2])
    assert ranks > 90_000 and sum(map(len, sent.column("_k1").to_pylist())) < 5 * ranks
