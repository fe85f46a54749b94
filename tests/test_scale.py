"""Plans that must stay as they are for large tables; every test builds its own rows."""
import contextlib
import time

from pyspark.sql import functions as F

from sheetloom.operators import nodes as ND
from sheetloom.operators import profile as P
from sheetloom.operators import segment as S
from sheetloom.operators import staging
from sheetloom.operators import validate as V
from sheetloom.operators.ordered import Last, number_rows, running
from sheetloom.sources import documents as D
from sheetloom.sources.grid import to_cells
from workload import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def conf(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_numbered_rows_do_not_move_again(spark):
    df = spark.range(500).selectExpr("if(id % 5 = 0, null, id % 3) as k", "id as v")
    with conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = number_rows(df, ["k"], ["v"])
        assert "SortMergeJoin" not in plan(out)
        got = sorted((-1 if r.k is None else r.k, r.v, r.row_idx) for r in out.collect())
    seen, want = {}, []
    for k, v in sorted((-1 if i % 5 == 0 else i % 3, i) for i in range(500)):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k]))
    assert got == want


def test_running_computes_its_values_after_the_shuffle(spark):
    df = spark.range(300).selectExpr("'t' as k", "id + 1 as row_idx", "if(id % 7 = 0, id, null) as v")
    out = running(df, ["k"], "row_idx", {"w": Last(F.col("v"))}, bucket_rows=50)
    moved = [p for p in plan(out).split("Exchange ") if "REPARTITION_BY_COL" in p]
    assert moved and all("_in_w" not in p.split("Project")[0] for p in moved)
    got = {r.row_idx: r.w for r in out.collect()}
    assert got == {i + 1: i - i % 7 for i in range(300)}


def test_unmapped_cells_are_not_broadcast(spark):
    cells = spark.createDataFrame([("t", r, c, "x") for r in range(4) for c in range(3)], "table_id string, row_idx long, col_idx int, value string")
    held = cells.filter("col_idx = 1 or row_idx = 2").select("table_id", "row_idx", "col_idx")
    out = S.unmapped_cells(cells, held)
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.row_idx, r.col_idx) for r in out.collect()) == [(r, c) for r in (0, 1, 3) for c in (0, 2)]


def test_monotonic_columns_move_numbers_only(spark):
    rows = [("t", i, c, v, k) for i in range(1, 6) for c, v, k in ((0, str(i % 4), "int"), (1, "x", "str"), (2, None, None))]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, value string, cell_type string")
    out = P.monotonic_columns(cells)
    moved = plan(out).split("REPARTITION_BY_COL")[1:]
    assert moved and all("Filter" in p for p in moved)
    assert sorted(map(tuple, out.collect())) == [(t, c, b, n) for t, c, b, n in [("t", 0, 1, 5), ("t", 1, 0, 0), ("t", 2, 0, 0)]]


def test_tasks_of_a_small_file_with_many_rows_stay_short(spark, tmp_path):
    spark.range(10 * fixtures.SPREAD_ROWS).coalesce(1).write.parquet(str(tmp_path / "t"))
    out = fixtures.spread(spark.read.parquet(str(tmp_path / "t")))
    assert out.rdd.getNumPartitions() >= 10


def test_schema_is_inferred_from_one_walk(spark):
    docs = D.parse_documents(spark.range(20).selectExpr("id as doc_id", """concat('{"a":', id, ',"b":["x"]}') as text"""))
    out = V.infer_schema(ND.nodes(docs))
    assert "parse_json" not in plan(out)
    assert {r.rule_path: r.n for r in out.collect()} == {"": 20, "/a": 20, "/b": 20, "/b/*": 20}


def test_walk_needs_one_array_beside_the_row(spark):
    text = '{"a":[{"b":[1,null,{"c":""}]},"x"]}'
    tree = ND.nodes(D.parse_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert "_l0" not in plan(tree)
    assert {(r.path, r.depth, r.kind, r.mixed) for r in tree.collect()} == {
        ("", 0, "object", True), ("/a", 1, "array", True), ("/a/0", 2, "object", True), ("/a/1", 2, "string", True),
        ("/a/0/b", 3, "array", True), ("/a/0/b/0", 4, "integer", True), ("/a/0/b/1", 4, "null", True),
        ("/a/0/b/2", 4, "object", True), ("/a/0/b/2/c", 5, "string", True)}


def test_profile_counts_cells_once(spark):
    cells = spark.range(50).selectExpr("'t' as table_id", "id + 1 as row_idx", "0 as col_idx", "'h' as header", "cast(id % 4 as string) as value", "'int' as cell_type")
    out = P.profile(cells)
    assert "Range (" not in plan(out)
    row = out.collect()[0]
    assert (row["rows"], row.distinct_n, row.top_values[0]["count"]) == (50, 4, 13)


def test_stage_leaves_no_shuffle_files_and_no_settings(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    settings = {k: spark.conf.get(k, None) for k in staging._WHILE_WRITING}
    out = staging.stage(spark.range(10_000).repartition(8, "id"))
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.2)
    assert disk.getAllFiles().size() <= before
    assert {k: spark.conf.get(k, None) for k in staging._WHILE_WRITING} == settings
    assert out.count() == 10_000


def test_cells_read_apart_are_the_same_and_made_when_asked_for(spark, tmp_path):
    rows = [("t", i, i, float(i) / 4, None if i % 3 else f" x{i}", i % 2 == 0) for i in range(1, 9)] + [("u", 1, None, None, None, None)]
    spark.createDataFrame(rows, "table_id string, row_idx long, a int, b double, c string, d boolean").write.parquet(str(tmp_path / "g"))
    grid = spark.read.parquet(str(tmp_path / "g"))
    for infer in (False, True):
        apart, stacked = to_cells(grid, infer, apart=True), to_cells(grid, infer)
        assert apart.dtypes == stacked.dtypes
        assert sorted(map(str, apart.collect())) == sorted(map(str, stacked.collect()))
    sizes = plan(to_cells(grid, apart=True).groupBy("table_id").agg(F.max("row_idx")))
    assert "Generate" not in sizes and "ReadSchema: struct<table_id:string,row_idx:bigint>" in sizes and "b:double" not in sizes


def test_typed_cells_are_not_written(spark, tmp_path):
    kinds = {"int": "cast(id % 7 as int)", "str": "concat('s', id % 3)", "float": "id / 4.0D", "date": "date_add(date'2020-01-01', cast(id as int))"}
    for t, cols in fixtures.TYPED.items():
        spark.range(6).selectExpr(*(f"{kinds[k]} as {c}" for c, k in cols)).write.parquet(str(tmp_path / f"{t}.parquet"))
    cells = fixtures.typed_cells(spark, str(tmp_path))
    assert "value:string" not in plan(cells) and "Generate" not in plan(cells)
    assert cells is fixtures.typed_cells(spark, str(tmp_path))
    assert cells.count() == 6 * sum(map(len, fixtures.TYPED.values()))
    assert {(r.table_id, r.header): r.value for r in cells.filter("row_idx = 1").collect()}["orders", "o_orderstatus"] == "s0"


def test_enum_candidates_count_cells_once(spark):
    cells = spark.range(60).selectExpr("'t' as table_id", "id + 1 as row_idx", "0 as col_idx", "'h' as header", "concat('v', id % 4) as value", "'str' as cell_type")
    out = P.enum_candidates(P.key_counts(cells))
    assert "Range (" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("t", 0, "h", 4, ["v0", "v1", "v2", "v3"])]


def test_stage_holds_its_settings_while_it_writes(spark, monkeypatch):
    seen, key = [], next(iter(staging.COMPILED))
    before, df = spark.conf.get(key, None), spark.range(3)
    real = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda self, path: (seen.append(spark.conf.get(key)), real(self, path))[1])
    assert staging.stage(df, staging.COMPILED).count() == 3
    assert seen == [staging.COMPILED[key]] and spark.conf.get(key, None) == before
