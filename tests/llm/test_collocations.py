import re
from collections import Counter, defaultdict

from brute import edge_rows

from sheetloom.llm import collocations
from sheetloom.llm.queries import QUERIES, SQL

PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
WORDS = re.compile(r"[\x20\x09]+")


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def mine(rows, least=10, top=2000):
    """lang -> list of (phrase, a, l, r, n, score) in rank order, by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECES.split(lower(text or "")):
            w = [x for x in WORDS.split(piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if a >= least and len(p.split(" ")) >= 2}
        rows_ = []
        for p, a in cands.items():
            w = p.split(" ")
            if len(w) == 2 and any(100 * b >= 50 * a for q, b in cands.items() if len(q.split(" ")) == 3 and (q.split(" ")[:2] == w or q.split(" ")[1:] == w)):
                continue
            best = min(((a * a * 10**6 // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))))
            k = best[1]
            rows_.append((p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n[lang], best[0]))
        rows_.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if rows_:
            out[lang] = rows_[:top]
    return out


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r.rank)):
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(out)


def test_op11_equals_brute_force_and_sql(spark, sf_dir, con):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    result = got(QUERIES["op11_collocations"](spark, sf_dir))
    assert result == mine(rows)
    duck = defaultdict(list)
    for lang, rank, phrase, a, l, r, n, score in sorted(con.sql(SQL["op11_collocations"]).fetchall(), key=lambda x: (x[0], x[1])):
        duck[lang].append((phrase, a, l, r, n, score))
    assert result == dict(duck)


def test_op11_edges(spark):
    texts = [t for _, t in edge_rows()]
    rows = [(t, [None, "en", "", "de"][i % 4]) for i, t in enumerate(texts * 3)]
    rows += [("New York is big. new  york\tcity; NEW YORK CITY hall!", "en")] * 12 + [("ab ab ab ab ab ab ab ab ab ab ab ab", None)] * 2
    frame = spark.createDataFrame([(t, lg, 1, "x", 2, 3) for t, lg in rows], "text string, lang string, _row long, _text string, n int, f long")
    assert got(collocations.collocations(frame)) == mine(rows)
    assert got(collocations.collocations(frame, least=3, top=5)) == mine(rows, 3, 5)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_fingerprints_of_a_collision_are_counted_again(spark):
    # with both bases 1 a fingerprint is the sum of word hashes: "a b" and "b a" collide, the texts tell them apart
    rows = [("a b. b a. a b c", "x")] * 10 + [("c b a", "x")] * 5
    frame = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.frequent_phrases(frame, bases=(1, 1)).where("n = 2").collect()
    assert {(r.phrase, r.f) for r in found} == {("a b", 20), ("b a", 15), ("b c", 10)}
    assert got(collocations.collocations(frame, bases=(1, 1))) == mine(rows)


def test_op11_without_broadcast_sets(spark, monkeypatch):
    # beyond the bound nothing is pruned and every phrase is counted by text: the same rows
    rows = [(t, "en") for _, t in edge_rows()] + [("New York is big. new york city; NEW YORK CITY hall!", "en")] * 12
    frame = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "BROADCAST_KEYS", 0)
    assert got(collocations.collocations(frame)) == mine(rows)


def test_phrases_of_a_slice_are_counted_before_they_are_sent(spark, monkeypatch):
    # words and phrases leave a slice once with their count, whatever the number of texts (256 before); pieces stay apart
    import pyarrow as pa
    from pyspark.sql import functions as F

    texts = ["Ab c. c\tÄb\x0bab  c"] * 600 + ["", "."]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * len(texts), "_text": texts})
    words = collocations._word_counts(iter([batch]))
    assert [{r["phrase"]: r["count"] for r in b.to_pylist()} for b in words] == [{"ab": 1200, "c": 1800, "Äb": 600}]
    phrases = [r for b in collocations._phrases(iter([batch]), None, None, collocations.BASES) for r in b.to_pylist()]
    assert sorted((r["n"], r["phrase"], r["count"]) for r in phrases) == [(2, "ab c", 1200), (2, "c Äb", 600)]
    # numbers start again and slices end after few words: the same counts
    monkeypatch.setattr(collocations, "HELD_WORDS", 1)
    monkeypatch.setattr(collocations, "SLICE_WORDS", 2)
    short = [r for b in collocations._phrases(iter([batch]), None, None, collocations.BASES) for r in b.to_pylist()]
    total = Counter()
    for r in short:
        total[r["n"], r["phrase"]] += r["count"]
    assert total == {(2, "ab c"): 1200, (2, "c Äb"): 600}
    # the words that Spark's hash tells as frequent are those of the tasks' hash
    samples = ["a", "abcd", "abcdefgh", "äöü ß", "x" * 31, "x" * 32, "long " * 30, ""]
    rows = spark.createDataFrame([(t,) for t in samples], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    vocabulary = collocations._Vocabulary()
    assert all(vocabulary.hashes[vocabulary[r.t.encode()]] == r.h % 2**64 for r in rows)


def test_fingerprints_go_to_the_shuffle_as_slices_count_them(spark, monkeypatch):
    # few fingerprints come twice in a task: gathering them before the shuffle was a table of nearly all rows (it spilled)
    plans, stage = {}, collocations.stage

    def seen(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df)

    monkeypatch.setattr(collocations, "stage", seen)
    frame = spark.createDataFrame([("a b. b a. a b c", "x")] * 10, "text string, lang string")
    assert got(collocations.collocations(frame)) == mine([("a b. b a. a b c", "x")] * 10)
    plan = plans["fp", "f"]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]
