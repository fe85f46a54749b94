import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from brute import edge_rows, edge_table, words

from sheetloom.llm import eftrie, language_model, neighbours, quality, toxicity
from sheetloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def labels(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_op7_held_out_accuracy(spark):
    rows, toxic = QUERIES["op7_toxicity"](spark, SF).collect(), labels(spark, "toxic")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    c = Counter((r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic)
    assert c[1, 0] <= 0.015 * (c[0, 0] + c[1, 0]) and c[0, 1] <= 0.15 * (c[0, 1] + c[1, 1])


def test_op7_counterfactual_term_lowers_identity_weight():
    # feature 0 an insult, 1 and 2 two groups; the insult comes with group 1 only
    rows = [([0, 1], [0, 2], 1)] * 20 + [([1], [2], 1)] * 3 + [([], None, 0)] * 60
    paired, _ = toxicity.fit_weights(rows, 3)
    plain, _ = toxicity.fit_weights([(f, None, y) for f, _, y in rows], 3)
    assert abs(paired[1] - paired[2]) < 0.2 * abs(plain[1] - plain[2])
    assert toxicity.swapped([b"the", b"women,", b"x"]) == [b"the", b"men", b"x"] and toxicity.swapped([b"x"]) is None


def test_op7_edges(spark):
    docs = edge_table(spark, [*edge_rows(), (None, "idiot idiot"), (20, "idiot you")])
    few = spark.createDataFrame([(1, 0, "x"), (1, 0, "x"), (None, 1, "x"), (3, None, "x"), (20, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_labels(docs, few)
    assert toxicity.score(docs, model).count() == len(edge_rows()) + 2
    none = toxicity.fit_labels(docs, few.limit(0))
    assert toxicity.score(edge_table(spark, []), none).count() == 0
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1


def test_op3_agrees_with_labels_it_never_saw(spark):
    rows, good = QUERIES["op3_quality"](spark, SF).collect(), labels(spark, "quality")
    c = Counter((r.keep, good[r.doc_id]) for r in rows if r.doc_id in good)
    assert c[False, 1] <= 0.005 * (c[False, 1] + c[True, 1]) and c[True, 0] <= 0.05 * (c[True, 0] + c[False, 0])


def test_op3_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    good, bad = [0.999] * 5 + [0.9] * 5, [0.3] * 5 + [0.7] * 5
    cast = np.stack([np.where(truth, rng.random(len(truth)) < g, ~(rng.random(len(truth)) < b)) for g, b in zip(good, bad)], axis=1).astype(int)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    post, table, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(table[quality.GOOD, 5:, quality.GOOD] - 0.9).max() < 0.03


def test_op3_estimates_a_sharp_labeller_that_a_clean_source_trips():
    rng = np.random.default_rng(3)
    source, n = rng.random(20_000), 20_000
    clean, table = source < 0.85, source < 0.3          # the first 0.3 are clean and trip the third labeller
    cast = np.where(clean[:, None], rng.random((n, 10)) < 0.99, rng.random((n, 10)) < 0.4).astype(int)
    cast[table, 2] = quality.BAD
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    post, rates, share = quality.expectation_maximisation(patterns, counts.astype(float), false_alarm=None)
    only = patterns.sum(axis=1) == 9
    assert abs(share - 0.85) < 0.03 and abs(rates[quality.GOOD, 2, quality.BAD] - 0.36) < 0.05
    assert post[only & (patterns[:, 2] == quality.BAD)].min() > 0.9


def test_op3_edges(spark):
    docs = edge_table(spark)
    assert quality.score(docs, quality.fit(docs)).count() == len(edge_rows())
    empty = edge_table(spark, [])
    assert quality.score(empty, quality.fit(empty)).count() == 0
    assert quality.votes("") == [quality.NONE] * len(quality.LABELLERS)


def test_op3_samples_of_the_distinct_texts(spark):
    docs = edge_table(spark, [(i, "one and the same text of many copies") for i in range(50)])
    model = quality.fit(docs, rows=1)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 50 and all(r.keep for r in rows) and np.abs(model.weights).max() > 0


def exact(rows, every, k):
    """rows: (id, vector) that take part."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = found[:k]
    return out


def test_op4_recall(spark):
    data = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = exact(data, 100, 10), {}
    for r in QUERIES["op4_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors, hits = dict(data), 0
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())) < 1e-12 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(got)


def test_op4_edges(spark):
    rng = np.random.default_rng(2)
    points = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    copies = [(i, points[0][1]) for i in range(300, 340)]
    bad = [(400, None), (500, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (700, [None] + [1.0] * 7), (800, [float("inf")] * 8), (900, [1.0]), (None, [1.0] * 8)]
    rows = points + copies
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, _v string, rank int")
    old = neighbours.CELL_ROWS
    neighbours.CELL_ROWS = 40
    try:
        found = neighbours.nearest(df, every=50, k=5).collect()
    finally:
        neighbours.CELL_ROWS = old
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = exact(rows, 50, 5)
    assert set(got) == set(want)
    assert [i for _, i in sorted(got[0])] == [300, 301, 302, 303, 304]      # ties go to smaller ids
    assert [i for _, i in sorted(got[300])] == [0, 301, 302, 303, 304]
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), every=50).count() == 0


def test_op4_ties_go_to_smaller_ids_in_a_leaf():
    # 20 points at the same distance; the smallest ids stand last in their leaf
    v = np.eye(20)
    ids = [[100 - i] for i in range(20)]
    tree = neighbours.Tree(v, v @ neighbours.projection(20))
    found = tree.search(np.zeros(20), np.zeros(20) @ neighbours.projection(20), -1, ids, 5, 1e9)
    assert [i for _, i in found] == [81, 82, 83, 84, 85]


def test_op8_base_and_gain(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op8_eftrie_lm"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    learn = [k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in learn for w in words(texts[k], True))
    total, kinds = sum(c.values()) + len(learn), len(c) + 1
    base = lambda n: math.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))
    gain = 0.0
    for k, t in texts.items():
        w, r = words(t, True), rows[k]
        want = sum(base(c[x]) for x in w) + base(len(learn))
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(x in c for x in w) + 1, total, k not in learn)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_op8_edges(spark):
    docs = edge_table(spark, [*edge_rows(), (None, "w1 w2"), (1, "w1 w2")])
    rows = language_model.score_documents(docs).collect()
    assert len(rows) == len(edge_rows()) + 2 and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert language_model.score_documents(edge_table(spark, [])).count() == 0
    from pyspark.sql import functions as F
    untaught = language_model.score_documents(edge_table(spark, [(1, "a b")]), learn=F.lit(False)).collect()
    assert untaught[0].train_tokens == 0 and untaught[0].n_known == 0 and math.isfinite(untaught[0].score)


def test_trie_equals_brute_force(tmp_path):
    import random

    rng, size, front = random.Random(4), 12, 11
    texts = [[front, *(min(9, int(rng.expovariate(0.4))) for _ in range(rng.randint(0, 9))), 10] for _ in range(400)]
    counts = [Counter(tuple(t[i - k + 1:i + 1]) for t in texts for i in range(k - 1, len(t))) for k in (1, 2, 3)]
    two = {g: n for g, n in counts[1].items() if n >= 2}
    three = {g: n for g, n in counts[2].items() if n >= 3 and g[:2] in two and g[1:] in two}
    seen = np.array([counts[0][(i,)] for i in range(size)], float)
    single = np.where(np.arange(size) == front, 0, seen + 0.1)
    single /= single.sum()
    pack = lambda grams: tuple(map(np.array, zip(*sorted((sum(x * size ** (len(g) - 1 - i) for i, x in enumerate(g)), n) for g, n in grams.items()))))
    (tmp_path / "trie").write_bytes(eftrie.Trie.build(single, seen, [pack(two), pack(three)]).to_bytes())
    trie = eftrie.Trie.open(str(tmp_path / "trie"))

    def p(symbol, before):
        out = single[symbol]
        for k, grams in ((1, two), (2, three)):
            context = tuple(before[-k:])
            total = seen[context[0]] if k == 1 else two.get(context)
            if len(before) < k or total is None:
                break
            kept = {g: n for g, n in grams.items() if g[:-1] == context}
            out = max(kept.get((*context, symbol), 0) - 0.75, 0) / total + (1 - sum(n - 0.75 for n in kept.values()) / total) * out
        return out

    probe = [[front, *(rng.randint(0, 9) for _ in range(8)), 10] for _ in range(100)] + texts[:50]
    s = np.array([x for t in probe for x in t])
    want = [math.log10(p(t[i], t[:i])) if i else 0 for t in probe for i in range(len(t))]
    assert np.abs(trie.score(s, s == front) - want).max() < 0.002
    assert abs(sum(p(x, [3, 4]) for x in range(size)) - 1) < 1e-9


def test_elias_fano_gives_back_its_values():
    rng = np.random.default_rng(6)
    for values in (np.sort(rng.integers(0, 10**6, 3000)), np.zeros(100, int), np.array([0, 5, 5, 10**7]), np.arange(1000) * 300):
        assert (eftrie.EliasFano.build(values).get(np.arange(len(values))) == values).all()


def test_op8_takes_every_word_and_ngram(spark):
    # brute-force model over all words and n-grams; no two words may share a symbol
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    ends = [["x" * 70, "then"], ["y" * 70, "else"], []]
    texts = [" ".join([*(f"w{int(x)}" for x in rng.zipf(1.3, 30) % 200), *ends[i % 3]]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = language_model.BLOCK_CHARS, language_model.SHARD_CHARS
    language_model.BLOCK_CHARS, language_model.SHARD_CHARS = 3_000, 1_000
    try:
        got = {r.doc_id: r.score for r in language_model.score_documents(docs, learn=F.col("doc_id") % 4 != 1).collect()}
    finally:
        language_model.BLOCK_CHARS, language_model.SHARD_CHARS = old
    tokens = {i: ["<s>", *t.split(), "</s>"] for i, t in enumerate(texts)}
    taught = [t for i, t in tokens.items() if i % 4 != 1]
    one = Counter(w for t in taught for w in t)
    two = {g: n for g, n in Counter((*t[i - 1:i + 1],) for t in taught for i in range(1, len(t))).items() if n >= 2}
    three = {g: n for g, n in Counter((*t[i - 2:i + 1],) for t in taught for i in range(2, len(t))).items() if n >= 2}
    total = sum(one.values()) - one["<s>"]
    new = min(0.5, max(sum(n == 1 for n in one.values()), 0.5) / total)

    def p(t, i):
        out = one[t[i]] / total * (1 - new) if one[t[i]] else new
        for k, grams, context in ((1, two, one), (2, three, two)):
            before = tuple(t[i - k:i])
            n = context.get(before[0] if k == 1 else before) if i >= k else None
            if not n:
                break
            out = max(grams.get((*before, t[i]), 0) - 0.75, 0) / n + (1 - sum(c - 0.75 for g, c in grams.items() if g[:-1] == before) / n) * out
        return out

    for i, t in tokens.items():
        want = sum(math.log10(p(t, j)) for j in range(1, len(t)))
        assert abs(got[i] - want) < 0.0005 * len(t), (i, got[i], want)


def test_op8_counts_an_order_in_shares_and_answers_with_bits():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 200)) for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"_block": pa.array([0] * 10 + [1] * 10), "_id": pa.array(range(20)), "_learn": pa.array([True] * 20), "_text": pa.array(texts)})
    blocks = list(language_model._in_blocks([batch]))
    assert [len(b.column("_ids")[0]) for b in blocks] == [10, 10]
    bare = [b.drop_columns(["_ids"]) for b in blocks]
    shards = 6
    shares = [pa.Table.from_batches(language_model._ask(shards, 2, part, 2)(iter(bare))) for part in range(2)]
    assert [set(x.column("_shard").to_pylist()) for x in shares] == [{0, 2, 4}, {1, 3, 5}]
    asked = pa.concat_tables(shares)
    told = pa.concat_tables([language_model._settle(shards, 2)(asked.filter(pa.array(asked.column("_shard").to_numpy() == i)), None) for i in range(shards)])
    s, _ = language_model._tokens(texts)
    every, counts = np.unique(language_model._grams(s, 2)[1][1], return_counts=True)
    for block in (0, 1):
        s, _ = language_model._tokens(texts[10 * block:10 * block + 10])
        own = np.unique(language_model._grams(s, 2)[1][1])
        n, _ = language_model._answers(told.filter(pa.array(told.column("_block").to_numpy() == block)), 2, own, shards)
        total = counts[np.searchsorted(every, own)]
        assert (n == np.where(total >= language_model.LEAST, total, 0)).all()


def test_classifiers_read_a_slice_at_a_time():
    texts = pa.array([f"word{i} and more words" for i in range(2_500)])
    votes = list(quality._vote(iter([pa.RecordBatch.from_arrays([texts], names=["_text"])])))
    assert [b.num_rows for b in votes] == [1_000, 1_000, 500]
    labelled = pa.RecordBatch.from_arrays([texts, pa.array([i % 2 for i in range(2_500)], pa.int32())], names=["_text", "_y"])
    counted = list(toxicity._count(iter([labelled])))
    assert len(counted) == 1 and [r for r in counted[0].to_pylist() if r["_bucket"] == -1] == [{"_bucket": -1, "_toxic": 1_250, "_clean": 1_250}]
