import hashlib
import random
import statistics

import numpy as np
import pyarrow as pa
from brute import components, edge_rows, edge_table, shingles, without_repeats, words

from sheetloom.llm import common, fingerprint, ngram_join, substring
from sheetloom.llm import components as cc
from sheetloom.llm.queries import QUERIES


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def near_copies(n=60):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(n // 6):
        text = [rng.choice(vocabulary) for _ in range(120)] if g % 2 else passage + [rng.choice(vocabulary) for _ in range(30)]
        for j in range(6):
            copy = list(text)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: len(copy) - 3 * (j % 3)])))
    return rows


def test_op9_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_ngram_join"](spark, sf_dir).collect()}
    assert got == components(documents(spark, sf_dir))


def test_op9_edges_and_chains(spark):
    for rows in (edge_rows(), near_copies()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_sets(edge_table(spark, rows)).collect()}
        assert got == components(rows)
    assert ngram_join.join_sets(edge_table(spark, [])).count() == 0
    twice = ngram_join.join_sets(edge_table(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in twice) == [(0, 0, 0), (0, 1, 4), (4, 1, 4), (4, 1, 4)]


def test_op9_compares_without_pivots_when_no_pivot_can_link(spark):
    # three short texts hold a shingle each of two longer ones, and the pivots of both rounds are short
    from pyspark.sql import functions as F

    def texts(seed):
        w = [f"w{seed}x{i}" for i in range(8)]
        return [" ".join(w[i:i + 5]) for i in range(3)] + [" ".join(w[:7]), " ".join(w)]

    keys = [(seed, i, ngram_join._key(ngram_join.shingle_set(t))) for seed in range(200) for i, t in enumerate(texts(seed))]
    ranks = {}
    for r in spark.createDataFrame(keys, "seed long, i int, k long").select("seed", "i", *(F.xxhash64("k", F.lit(t)).alias(f"r{t}") for t in range(2))).collect():
        ranks[r.seed, r.i] = (r.r0, r.r1)
    seed = next(s for s in range(200) if all(max(ranks[s, i][t] for i in range(3)) < min(ranks[s, i][t] for i in (3, 4)) for t in range(2)))
    rows = list(enumerate(texts(seed)))
    got = {r.doc_id: r.component_id for r in ngram_join.join_sets(edge_table(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3} == {k: c for k, (_, c) in components(rows).items()}


def test_walk_finds_exactly_the_links():
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 200), replace=False), rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]))
                for _ in range(40)]
        query = np.unique(base)
        want = [i for i, s in enumerate(sets) if 4 * len(np.intersect1d(query, s)) >= 3 * len(np.union1d(query, s))]
        assert sorted(ngram_join.walk(query, sets)) == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_op5_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
    assert got == without_repeats(documents(spark, sf_dir))


def test_op5_edges(spark):
    for rows in (edge_rows(), near_copies()):
        made = substring.remove_repeats(edge_table(spark, rows), carry=["lang", "_row"]).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == without_repeats(rows)
        assert all(r["_row"] == 5 and r.lang is None for r in made)
        text_of = dict(rows)
        for r in made:
            w, gone = words(text_of[r.doc_id]), {i for s in r.spans for i in range(s.first, s.last)}
            assert r.text.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert substring.remove_repeats(edge_table(spark, [])).count() == 0
    same = " ".join(f"x{i}" for i in range(30))
    ties = substring.remove_repeats(edge_table(spark, [(5, same), (5, same), (None, same), (9, same)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in ties) == [(0, 0), (5, 30), (5, 30), (9, 30)]


def check_fingerprints(got, rows):
    rows = sorted((k, t or "") for k, t in rows)
    errors = []
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * fingerprint.BINS
        for estimate, other in ((r.near_edited, edited), (r.near_next, nxt)):
            a, b = ({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for w in (words(t), words(other)))
            assert 0 <= estimate <= 1
            errors.append(estimate - len(a & b) / len(a | b))
    return errors


def test_op6_estimates_jaccard(spark, sf_dir):
    errors = check_fingerprints({r.doc_id: r for r in QUERIES["op6_minhash"](spark, sf_dir).collect()}, documents(spark, sf_dir))
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.05


def test_op6_edges(spark):
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(edge_table(spark)).collect()}
    errors = check_fingerprints(got, edge_rows())
    assert max(map(abs, errors)) < 0.25
    assert got[1].fingerprint == got[2].fingerprint and got[6].fingerprint == got[7].fingerprint
    assert fingerprint.fingerprint_documents(edge_table(spark, [])).count() == 0
    one = fingerprint.fingerprint_documents(edge_table(spark, [(None, "a b c d e f g h")])).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 15


def test_op6_plan_is_native(spark, sf_dir):
    plan = QUERIES["op6_minhash"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shingle_sets_hash_distinct_sequences():
    for _, t in edge_rows():
        assert len(ngram_join.shingle_set(t or "")) == len(shingles(t))


def test_op5_marks_repeats_inside_a_row_where_it_is_hashed(monkeypatch):
    # the last step gets all starts, and hashes no text again; rows in one stretch do not run into each other
    import pyarrow as pa
    import zstandard

    passage = [f"w{i}" for i in range(25)]
    texts = [" ".join(passage + ["x"] + passage), "", " ".join(passage[:19]), " ".join(passage[19:] + passage)]
    full = np.full(1 << (substring.SLICE_BITS + substring.WIDE - 3), 255, np.uint8)
    batch = pa.RecordBatch.from_pydict({"_row": [7, 8, 9, 10], "_order": [1, 2, 3, 4], "_text": texts})
    found = [r for b in substring._probe(iter([batch]), full, full) for r in b.to_pylist()]
    assert sorted((r["_row"], r["_start"]) for r in found) == sorted(
        [(7, i) for i in range(26)] + [(7, -1 - i) for i in range(26, 32)] + [(10, i) for i in range(12)])
    monkeypatch.setattr(substring, "word_hashes", None)
    press = zstandard.ZstdCompressor().compress
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 7), pa.array([-1, *range(26, 32)], pa.int32()), pa.array([{"doc_id": 1}] + [None] * 6),
                                       pa.array([press(texts[0].encode())] + [None] * 6, pa.binary())], names=["_row", "_start", "_id", "_z"])
    cut = [r for b in substring._cut(iter([rows])) for r in b.to_pylist()]
    assert [(r["text"], r["n_words"], r["n_removed"]) for r in cut] == [(" ".join(passage + ["x"]), 51, 25)]


def test_op9_bitmaps_drop_no_pair_that_links():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 31, 32, 33, 40, 500, 513, 3000):
        for m in {n, max(1, n * 3 // 4), max(1, n * 4 // 5), n + n // 4}:
            for common in range(int(ngram_join.needed(n, m)), min(n, m) + 1, max(1, n // 50)):
                a, b, c = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (n - common, m - common, common))
                x, y = np.sort(np.append(a, c)), np.sort(np.append(b, c))
                assert ngram_join.can_link(n, m, ngram_join.member_bits(x), ngram_join.member_bits(y))
    x, y = (np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(2))
    assert not ngram_join.can_link(500, 500, ngram_join.member_bits(x), ngram_join.member_bits(y))       # their sets stay where they are


def test_op9_first_round_compares_small_blocks_whole_and_large_ones_with_pivots(spark):
    # one pivot a block before: members of a block were mostly left to the last round, whose pairs grow with the square of its size
    def pairs(members):
        blocks = spark.createDataFrame([(7, k, 100, 0) for k in range(members)], "_token long, _key long, _n int, _at int")
        return ngram_join._pairs(blocks, None, 0).count()

    first = ngram_join.PIVOTS[0]
    assert pairs(10) == 45
    assert pairs(60) == first * (first - 1) // 2 + first * (60 - first)


def test_op9_workers_give_free_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "hand_back", lambda: given.append(True))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (2_500, 10, 0)]
    assert [b.num_rows for b in common.in_slices(iter(batches))] == [1_000, 1_000, 500, 10]
    assert len(given) >= 4
    given.clear()
    rows = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([k, k + 1, k]), pa.array([9, 9, 9], pa.int32()), pa.array([0, 0, 0], pa.int32())],
                                       names=["_token", "_key", "_n", "_at"]) for k in (1, 1, 1)]
    assert sum(b.num_rows for b in ngram_join._live(iter(rows[:1]))) == 2 and len(given) == 1
