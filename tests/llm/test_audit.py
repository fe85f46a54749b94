import re
from collections import Counter, defaultdict

from brute import edge_rows

from sheetloom.llm import divergence
from sheetloom.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def audit(rows, least=10, top=10):
    """(lang, source, part, item) -> (value, rank) from (text, lang, source) rows, term by term."""
    docs = [((lang or ""), (source or ""), [lower(t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = {}
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)

        def ppb(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (c[t] + 2) * 10**9 // (n + 2 * v) for t in kept}
        p = {s: ppb(count[lang, s]) for s in sources}
        q = ppb(sum((count[lang, s] for s in sources), Counter()))

        def gap(a, b):
            return (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            for r, (val, o) in enumerate(pairs, 1):
                out[lang, s, "pair", o] = (-val, r)
            terms = sorted(((-gap(p[s][t], q[t]), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            for r, (val, t) in enumerate(terms[:top], 1):
                out[lang, s, "term", t] = (-val, r)
    return out


def got(df):
    return {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in df.collect()}


def test_op13_equals_brute_force_and_sql(spark, sf_dir, con):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    mine = got(QUERIES["op13_source_divergence"](spark, sf_dir))
    assert mine == audit(rows)
    assert mine == {(r[0], r[1], r[2], r[3]): (r[4], r[5]) for r in con.sql(SQL["op13_source_divergence"]).fetchall()}


def test_op13_edges(spark):
    texts = [t for _, t in edge_rows()]
    langs = [None, "en", "en", "", "de"]
    sources = [None, "a", "b", "a", "ä"]
    rows = [(t, langs[i % 5], sources[(i * 3) % 5]) for i, t in enumerate(texts * 4)]
    rows += [("Über über ÜBER the THE the. the,the", "en", "hot")] * 30 + [("nothing here 123", "en", "quiet")]
    frame = spark.createDataFrame([(t, lg, s, 1, "x", "y", 3) for t, lg, s in rows],
                                  "text string, lang string, source string, _row long, chunk string, term string, n_docs int")
    assert got(divergence.audit(frame)) == audit(rows)
    # a small share per task: the hot chunks are split over many salts
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert got(divergence.audit(frame, least_docs=2, top=3)) == audit(rows, 2, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert divergence.audit(frame.limit(0)).count() == 0
    # one source alone: no pairs; no kept term: pairs of value 0
    assert got(divergence.audit(spark.createDataFrame([("a b", "x", "s")], "text string, lang string, source string"))) == {}
    two = spark.createDataFrame([("a", "x", "s"), (None, "x", "t")], "text string, lang string, source string")
    assert got(divergence.audit(two)) == {("x", "s", "pair", "t"): (0, 1), ("x", "t", "pair", "s"): (0, 1)}


def test_op13_terms_of_several_forms_by_join(spark, monkeypatch):
    # beyond the bound the forms are joined with every document's chunks: the same rows
    rows = [("The the, THE. the! other Other", "en", s) for s in ("a", "b")] * 6 + [("the x", "en", "c"), (None, None, None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "BROADCAST_FORMS", 0)
    monkeypatch.setattr(divergence, "BROADCAST_CHARS", 0)
    assert got(divergence.audit(frame, least_docs=3)) == audit(rows, 3)


def test_op13_counts_terms_after_one_shuffle(spark):
    # terms in many chunk forms reach the shuffle as counts, one row a group and term, not as chunks
    rows = [("The the, THE. (the)\x01the!", "en", "a"), ("the-end", "en", "a"), ("the", "en", "b"), (None, "en", "b"), ("the", None, "b")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    counted = divergence.term_counts(frame, least_docs=3)
    assert sorted((r.lang, r.source, r.term, r["count"]) for r in counted.collect()) == [("en", "a", "the", 6), ("en", "b", "the", 1)]
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "regexp" not in plan
    sent = frame.select("lang", "source", "text").na.fill("").coalesce(1).mapInArrow(
        divergence._count_terms, "lang string, source string, term string, count long, n_docs long")
    assert {(r.lang, r.source, r.term, r["count"], r.n_docs) for r in sent.collect()} == {
        ("en", "a", "the", 6, 2), ("en", "a", "end", 1, 1), ("en", "b", "the", 1, 1), ("", "b", "the", 1, 1)}


def test_op13_sends_no_terms_and_no_vectors_through_the_driver(spark, monkeypatch):
    rows = [("the a b the", "en", s) for s in ("a", "b", "c")] * 4 + [("der die", "de", s) for s in ("a", "b")] * 3 + [(None, None, None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    plans, stage = [], divergence.stage
    monkeypatch.setattr(divergence, "stage", lambda df: (plans.append(df), stage(df))[1])
    for bound in (divergence.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", bound)
        plans.clear()
        out = divergence.audit(frame, least_docs=2)
        assert got(out) == audit(rows, 2)
        # on small tables Spark itself would send every side
        for df in [*plans, out]:
            text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            for sent in re.findall(r"\) BroadcastExchange.*\nInput \[\d+\]: \[(.*)\]", text):
                assert not re.search(r"\b(term|vec|other|_v)#", sent), sent
