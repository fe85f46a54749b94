"""Nesting against a sequential restatement of the rule on random lists."""
import json
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators.nest import assemble_tree, nest, tree_type

TEXT = {0: "1. x", 1: "a. x", 2: "1) x", -1: "plain"}


def parents(levels, orphan):
    """Parent position per item, by walking the list once."""
    slots, head, out = {}, None, []
    for i, k in enumerate(levels, 1):
        if k == -1 and orphan == "attach":
            out.append(slots[max(slots)] if slots else None)
        elif k == -1:
            out.append(None)
            if orphan == "group":
                slots, head = {}, i
        else:
            above = [j for j in slots if j < k]
            out.append(slots[max(above)] if above else head)
            slots = {j: p for j, p in slots.items() if j < k} | {k: i}
    return out


@pytest.fixture(scope="module")
def lists():
    rnd = random.Random(7)
    return [[rnd.choice([-1, 0, 1, 2]) for _ in range(rnd.randint(1, 25))] for _ in range(150)]


@pytest.mark.parametrize("orphan", ["attach", "group", "root"])
@pytest.mark.parametrize("bucket_rows", [4, 1_000_000])
def test_parents(spark, lists, orphan, bucket_rows):
    rows = [(n, i, TEXT[k]) for n, ks in enumerate(lists) for i, k in enumerate(ks, 1)]
    df = spark.createDataFrame(rows, "l bigint, i bigint, t string")
    out = nest(df, ["l"], "i", F.col("t"), orphan=orphan, bucket_rows=bucket_rows).collect()
    got = {(r["l"], r["i"]): r["parent"] for r in out}
    want = {(n, i): p for n, ks in enumerate(lists) for i, p in enumerate(parents(ks, orphan), 1)}
    assert got == want
    assert all(r["depth"] == len(r["path"]) - 1 and r["path"][-1] == r["i"] for r in out)


def tree(levels, orphan):
    nodes = [{"text": f"{TEXT[k]} {i}"} for i, k in enumerate(levels, 1)]
    roots = []
    for node, p in zip(nodes, parents(levels, orphan)):
        (roots if p is None else nodes[p - 1].setdefault("sub", [])).append(node)
    return roots


@pytest.mark.parametrize("orphan", ["attach", "group", "root"])
def test_tree_text(spark, lists, orphan):
    rows = [(n, i, f"{TEXT[k]} {i}") for n, ks in enumerate(lists) for i, k in enumerate(ks, 1)]
    df = spark.createDataFrame(rows, "l bigint, i bigint, t string")
    out = assemble_tree(nest(df, ["l"], "i", F.col("t"), orphan=orphan), ["l"], "i").collect()
    assert {r["l"]: json.loads(r["tree"]) for r in out} == {n: tree(ks, orphan) for n, ks in enumerate(lists)}


def test_long_list_comes_in_whole_parts(spark, lists):
    ks = [k for part in lists for k in part]
    df = spark.createDataFrame([(i, f"{TEXT[k]} {i}") for i, k in enumerate(ks, 1)], "i bigint, t string").withColumn("l", F.lit(1))
    out = assemble_tree(nest(df, ["l"], "i", F.col("t"), bucket_rows=100), ["l"], "i", part_rows=50).collect()

    def texts(items):
        for x in items:
            yield x["text"]
            yield from texts(x.get("sub", []))
    found = [t for r in sorted(out, key=lambda r: r["part"]) for t in texts(json.loads(r["tree"]))]
    assert found == [f"{TEXT[k]} {i}" for i, k in enumerate(ks, 1)] and len(out) > 1


def test_drop_and_typed_tree(spark):
    df = spark.createDataFrame([(1, 1, "1. a"), (1, 2, "-"), (1, 3, "a. “b”"), (1, 4, " ")], "l bigint, i bigint, t string")
    out = assemble_tree(nest(df, ["l"], "i", F.col("t"), drop=["-"]), ["l"], "i", "teks", "anak")
    typed = out.select(F.from_json("tree", tree_type(3, "teks", "anak")).alias("t")).first()["t"]
    assert typed[0]["teks"] == "1. a" and typed[0]["anak"][0]["teks"] == "a. “b”"
