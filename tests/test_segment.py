"""Sheet conversion against a sequential pass over a small sheet with a long entry."""
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import segment as S
from sheetloom.plans.convert import SheetSpec, convert, unassigned


@pytest.fixture(scope="module")
def sheet_rows():
    rnd = random.Random(3)
    rows = []
    for i in range(1, 401):
        start = i in (3, 10, 11, 350)            # entry 3 of 4 holds most rows
        rows.append(("t", i, str(i) if start else None, rnd.choice(["x", None]) if start else rnd.choice(["y", "z", None]),
                     rnd.choice(["p", "q", None, None]), rnd.choice(["v%d" % (i % 9), None, "-"])))
    return rows


def sequential(rows):
    entries, cur = [], None
    for _, i, a, b, key, v in rows:
        if all(c is None for c in (a, b, key, v)):
            continue
        if a is not None:
            cur = {"no": a, "attr": b, "groups": [[key, []]]}
            entries.append(cur)
        elif cur is None:
            continue
        elif key is not None and key != cur["groups"][-1][0]:
            cur["groups"].append([key, []])
        if b is not None and cur["attr"] is None:
            cur["attr"] = b
        if v not in (None, "-"):
            cur["groups"][-1][1].append(v)
    return entries


def test_convert(spark, sheet_rows):
    df = spark.createDataFrame(sheet_rows, "table_id string, row_idx bigint, a string, b string, k string, v string")
    spec = SheetSpec(F.col("a").isNotNull(), {"no": F.col("a"), "attr": F.col("b")},
                     {"items": F.col("v")}, F.col("k"))
    got = [{"no": r["no"], "attr": r["attr"], "groups": [[g["group_key"], list(g["items"])] for g in r["groups"]]}
           for r in sorted(convert(df, spec).collect(), key=lambda r: r["entry_id"])]
    assert got == sequential(sheet_rows)
    assert [r["row_idx"] for r in unassigned(df, spec).collect()] == [r[1] for r in sheet_rows[:2] if any(c is not None for c in r[2:])]
    parts = convert(df, spec, part_rows=50).collect()      # attributes are those of the whole entry
    assert {(r["entry_id"], r["no"], r["attr"]) for r in parts} == {(i, e["no"], e["attr"]) for i, e in enumerate(sequential(sheet_rows), 1)}
    assert len(parts) > 4


def test_long_entry_in_parts_is_whole(spark, sheet_rows):
    df = spark.createDataFrame(sheet_rows, "table_id string, row_idx bigint, a string, b string, k string, v string")
    rows = S.segment(df, F.col("a").isNotNull(), part_rows=50, bucket_rows=64)
    parts = S.collect_ordered(rows.filter("entry_id > 0"), ["table_id", "entry_id"], F.col("v"), part_rows=50).collect()
    assert max(len(r["items"]) for r in parts) <= 50 and len({r["part"] for r in parts}) > 1
    joined = [v for r in sorted(parts, key=lambda r: (r["entry_id"], r["part"])) for v in r["items"]]
    assert joined == [r[5] for r in sheet_rows if r[1] >= 3 and r[5] is not None]


def test_conservation_adds_up(spark, sheet_rows):
    df = spark.createDataFrame(sheet_rows, "table_id string, row_idx bigint, a string, b string, k string, v string")
    blank = F.coalesce("a", "b", "k", "v").isNull()
    r = S.conservation(S.segment(df, F.col("a").isNotNull()), F.col("a").isNotNull(), blank).first()
    assert r["rows_seen"] == r["entry_rows"] + r["continuation_rows"] + r["section_rows"] + r["unassigned_rows"]
    assert r["all_rows"] == r["rows_seen"] + r["blank_rows"] == 400 and r["entry_rows"] == 4
