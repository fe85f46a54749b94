import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from brute import edge_rows, edge_table, u4
from tokenizers import Tokenizer

from sheetloom.llm import bpe, packing, shards
from sheetloom.llm.queries import QUERIES
from sheetloom.llm.tokens import encoder

BYTES, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("path", [BYTES, WORD])
def test_encoder_equals_library(path):
    odd = ["", " ", "  ", "a  b", "a \nb", "\n\na", "don't DON'T we'll", "x<|endoftext|>y", "<|STARTOFTEXT|> <|startoftext|>", "中 文", "é é İ Σ",
           "a\x00b", "a\x1fb \x1cc", "1234 5 6.7", "tab\tx \t y", "a b c", "ends ", " starts", "😀 😀", "ab.,!? cd"]
    texts = odd + [t or "" for _, t in edge_rows()]
    enc = encoder(path)
    assert [enc.array(x).tolist() for x in enc.in_slices(texts, 1000)] == plain(path, texts)


def check_encoding(rows, texts):
    for k, ids in zip(texts, plain(BYTES, texts.values())):
        decoded = Tokenizer.from_file(BYTES).decode(ids, skip_special_tokens=False) if len(texts) < 30 else texts[k]
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(u4(ids)).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op1_equals_library(spark, sf_dir):
    check_encoding({r.doc_id: r for r in QUERIES["op1_bpe_chunks"](spark, sf_dir).collect()}, documents(spark, sf_dir))


def test_op1_edges(spark):
    rows = {r.doc_id: r for r in bpe.encode_decode(edge_table(spark), BYTES).collect()}
    check_encoding(rows, {k: t or "" for k, t in edge_rows()})
    repeated = bpe.encode_decode(edge_table(spark, [(None, "a b"), (None, "a b"), (1, "c")]), BYTES).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in repeated) == [(0, 2), (0, 2), (1, 1)]
    assert bpe.encode_decode(edge_table(spark, []), BYTES).count() == 0


def test_chunks_are_content_defined():
    data = " ".join(f"word{i * i % 997}" for i in range(4000)).encode()
    ends = bpe.chunk_ends(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and len(ends) > 5
    shifted = bpe.chunk_ends(b"something in front " + data)
    own = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"something in front " + data
    assert len(own & {moved[a:b] for a, b in zip([0, *shifted], shifted)}) >= len(own) - 3


def check_shards(rows, texts):
    start = 0
    for k, ids in zip(sorted(texts), plain(WORD, [texts[k] for k in sorted(texts)])):
        ids = [*ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(u4(ids)))
        start += len(ids)


def test_op2_equals_library(spark, sf_dir):
    check_shards({r.doc_id: r for r in QUERIES["op2_id_shards"](spark, sf_dir).collect()}, documents(spark, sf_dir))


def test_op2_edges(spark, tmp_path):
    shards.write_shards(edge_table(spark), f"{tmp_path}/a", WORD, shard_bytes=500)
    check_shards({r.doc_id: r for r in shards.read_shards(spark, f"{tmp_path}/a").collect()}, {k: t or "" for k, t in edge_rows()})
    some = shards.read_shards(spark, f"{tmp_path}/a", ids=[3, 9]).collect()
    assert sorted(r.doc_id for r in some) == [3, 9]
    shards.write_shards(edge_table(spark, [(None, None), (5, "a"), (5, "b")]), f"{tmp_path}/b", WORD)
    assert [(r.doc_id, r.n_tokens) for r in sorted(shards.read_shards(spark, f"{tmp_path}/b").collect(), key=lambda r: r.start)] == [(None, 1), (5, 2), (5, 2)]
    shards.write_shards(edge_table(spark, []), f"{tmp_path}/c", WORD)
    assert shards.read_shards(spark, f"{tmp_path}/c").count() == 0


def test_shard_reads_one_document():
    import numpy as np

    ids = [np.arange(n, dtype="<u2").tobytes() for n in (0, 3, 1000)]
    shard = shards.Shard(shards.build_shard(ids, 2, b""), b"")
    assert len(shard) == 3 and shard[1].tolist() == [0, 1, 2] and len(shard[0]) == 0 and len(shard[2]) == 1000
    with pytest.raises(ValueError):
        shards.Shard(shards.build_shard(ids, 2, b""), b"other")


def check_packing(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, ids in zip(texts, plain(BYTES, texts.values())):
        ids, at = [*ids, 0], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(u4(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_op10_equals_library(spark, sf_dir):
    assert check_packing(QUERIES["op10_packing"](spark, sf_dir).collect(), documents(spark, sf_dir)) == 0


def test_op10_edges(spark):
    assert check_packing(packing.pack_documents(edge_table(spark), BYTES, group_docs=4).collect(), {k: t or "" for k, t in edge_rows()}) == 0
    assert packing.pack_documents(edge_table(spark, []), BYTES).count() == 0
    repeated = packing.pack_documents(edge_table(spark, [(None, None), (None, None), (2, "a")]), BYTES).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in repeated) == [(0, 1), (0, 1), (2, 2)]


def test_tournament_is_first_fit():
    import random

    rng = random.Random(5)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 1023) for _ in range(rng.randint(1, 200))), reverse=True)
        tree, room = packing.Tournament(len(sizes), 1024), [1024] * len(sizes)
        for s in sizes:
            want = next(i for i, r in enumerate(room) if r >= s)
            assert tree.place(s) == want
            room[want] -= s
