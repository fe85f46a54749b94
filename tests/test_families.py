import json
import math

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import similarity as S
from sheetloom.operators import corpus as C
from sheetloom.operators import families as FM
from sheetloom.sources.families import read_families, read_family_records, write_families

# Two published structural vectors of one family.
A = [0.3076923076923077, 0.38461538461538464, 0.23076923076923078, 0.07692307692307693, 0.0, 0.5, 1.0,
     0.6666666666666666, 1.0, 1.0, 0.5700000000000001]
B = [0.5, 0.125, 0.25, 0.125, 0.0, 0.5, 0.25, 0.0, 0.6, 1.0, 1.0]


@pytest.fixture(scope="module")
def store(spark):
    members = spark.createDataFrame([("f", "j1", "2024-01-01", 1, A), ("f", "j2", "2024-01-02", 1, B)],
                                    "name string, job_id string, added string, built_against bigint, vector array<double>")
    families = FM.centroid(members).select("name", F.lit(1).cast("bigint").alias("canonical_version"),
                                           F.lit("j1").alias("canonical_source"), "vector", "n_members")
    return families, members


def test_published_cosines(spark, store):
    families, members = store
    pair = spark.createDataFrame([(A, B)], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert round(pair, 4) == 0.8141
    scores = {r["job_id"]: round(r["score"], 4) for r in FM.top_matches(members, families, 1, key="job_id").collect()}
    assert scores == {"j1": 0.9608, "j2": 0.9433}


def test_zero_vector_and_no_families(spark, store):
    families, _ = store
    t = spark.createDataFrame([("t", [0.0] * 11)], "table_id string, vector array<double>")
    assert FM.match(t, families).first()["verdict"] == "unrelated"
    assert FM.match(t, families.filter("false")).first()["verdict"] == "no-families"


@pytest.mark.parametrize("block_rows, broadcast_rows", [(1000, 1000), (7, 1000), (7, 0)])
def test_top_matches_by_brute_force(spark, block_rows, broadcast_rows):
    vec = lambda i: [math.sin(i * k + 1) for k in range(1, 12)]
    fams = spark.createDataFrame([(f"f{i:03d}", vec(i)) for i in range(40)], "name string, vector array<double>")
    tabs = spark.createDataFrame([(f"t{i}", vec(100 + i)) for i in range(9)], "table_id string, vector array<double>")
    got = FM.top_matches(tabs, fams, 3, block_rows=block_rows, broadcast_rows=broadcast_rows).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    want = {(f"t{i}", r + 1): n for i in range(9) for r, (_, n) in enumerate(
        sorted((-cos(vec(100 + i), vec(j)), f"f{j:03d}") for j in range(40))[:3])}
    assert {(r["table_id"], r["rank"]): r["name"] for r in got} == want


def test_promote_modes(spark, store):
    families, members = store
    new = spark.createDataFrame([("f", "j3", "2024-02-01", B), ("g", "k1", "2024-02-01", A), ("f", "j1", "2024-02-01", A)],
                                "name string, job_id string, added string, vector array<double>")
    fam, mem = FM.promote(families, members, new, "add")
    assert {r["name"]: (r["canonical_version"], r["canonical_source"], r["n_members"]) for r in fam.collect()} == {
        "f": (1, "j1", 3), "g": (1, "k1", 1)}
    fam, mem = FM.promote(families, members, new, "evolve")
    assert {r["name"]: (r["canonical_version"], r["canonical_source"]) for r in fam.collect()} == {"f": (2, "j3"), "g": (1, "k1")}
    assert {r["job_id"]: r["built_against"] for r in mem.collect()} == {"j1": 1, "j2": 1, "j3": 2, "k1": 1}
    far = new.withColumn("vector", F.when(F.col("name") == "f", F.array(*[F.lit(0.0)] * 10, F.lit(1.0))).otherwise(F.col("vector")))
    assert {r["job_id"] for r in FM.promote(families, members, far, min_score=0.9)[1].collect()} == {"j1", "j2", "k1"}


def test_store_round_trip(spark, store, tmp_path):
    families, members = store
    write_families(families, members, str(tmp_path / "store"))
    (tmp_path / "store" / "families" / "bad.json").write_text("{broken\n")
    fam, mem = read_families(spark, str(tmp_path / "store"))
    assert [r["name"] for r in fam.collect()] == ["f"] and mem.count() == 2
    record = {"name": "f", "canonical_source": "j1", "fingerprint": {"vector": A}, "members": [{"job_id": "j1", "fingerprint": {"vector": A}}]}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "one" / "g.json").write_text("{")
    fam, mem = read_family_records(spark, str(tmp_path / "one"))
    assert [(r["name"], r["canonical_version"], r["n_members"]) for r in fam.collect()] == [("f", 1, 1)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_nearest_by_brute_force(spark, broadcast_rows):
    words = [f"w{i:02d}x" for i in range(30)]
    texts = [(i, " ".join(words[(i * k) % 30] for k in range(1, 3 + i % 9))) for i in range(60)] + [(99, "zz")]
    corpus = [(i, " ".join(words[(i * 7 + k * k) % 30] for k in range(2 + i % 5))) for i in range(25)]
    got = C.nearest(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(corpus, "item_id bigint, text string"),
                    broadcast_rows=broadcast_rows).collect()

    def best(t):
        a, top = {w for w in t.split() if len(w) > 2}, (0.0, None)
        for i, c in corpus:
            b = {w for w in c.split() if len(w) > 2}
            s = len(a & b) / len(a | b) if a | b else 0.0
            if s > top[0]:
                top = (s, i)
        return top
    assert {r["doc_id"]: (r["similarity"], r["nearest"]) for r in got} == {i: best(t) for i, t in texts}


def test_centroid_refuses_other_lengths(spark):
    members = spark.createDataFrame([("f", [1.0] * 20)], "name string, vector array<double>")
    with pytest.raises(Exception, match="another length"):
        FM.centroid(members).collect()


def test_tables_without_probe_rows_keep_their_rows(spark):
    from sheetloom.operators import header as H
    from sheetloom.operators import profile as P
    from sheetloom.sources.grid import original_size, to_grid

    grid = spark.createDataFrame([("t", 16, "a"), ("t", 17, "b"), ("u", 1, "h"), ("u", 2, "x")], "table_id string, row_idx bigint, c0 string")
    assert sorted((r["table_id"], r["row_idx"]) for r in H.split_header(grid).collect()) == [("t", 16), ("t", 17), ("u", 2)]
    wide = spark.range(30).select("id", *[F.lit(i).alias(f"k{i}") for i in range(69)])
    cut = to_grid(wide, F.lit("w"), ["id"], max_cols=60, scan_rows=10)
    assert P.dims(cut).first()["truncated"] is False
    assert P.dims(cut, original=original_size(wide, F.lit("w"))).first()["truncated"] is True
    assert len(to_grid(wide, F.lit("w"), ["id"]).columns) == 72


def test_a_narrow_table_beside_a_wide_one(spark):
    from sheetloom.operators import profile as P
    from sheetloom.plans.inspect import inspect

    rows = [("n", i, "no" if i == 1 else str(i), "name" if i == 1 else f"text {i}", None) for i in range(1, 21)]
    wide = [("w", i, "no" if i == 1 else str(i), "name" if i == 1 else f"text {i}", "unit" if i == 1 else "kg") for i in range(1, 21)]
    schema = "table_id string, row_idx bigint, c0 string, c1 string, c2 string"
    both, alone = spark.createDataFrame(rows + wide, schema), spark.createDataFrame([r[:4] for r in rows], schema.rsplit(",", 1)[0])
    assert {r["table_id"]: r["max_col"] for r in P.dims(both).collect()} == {"n": 2, "w": 3}
    shared = {r["table_id"]: r for r in inspect(both).fingerprints().collect()}
    assert shared["n"]["ncol"] == 2 and shared["w"]["ncol"] == 3 and shared["n"]["min_fill"] == 1.0
    assert list(shared["n"]["vector"]) == list(inspect(alone).fingerprints().collect()[0]["vector"])
