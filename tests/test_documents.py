import json

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import nodes as N
from sheetloom.operators import quality as Q
from sheetloom.operators import validate as V
from sheetloom.sources.documents import parse_documents, read_documents, to_text, write_documents
from sheetloom.sources.rules import merge_checks


def docs(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return parse_documents(spark.createDataFrame(rows, "doc_id int, text string"))


def walk(node, path=""):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walk(v, f"{path}/{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, f"{path}/{i}")
    else:
        yield path, node


DOC = {"a": [1, None, {"x": "y", "z": []}, [["deep"]]], "b": {}, "c": True, "d": "", "e": {"f": {"g": [2.5, -3]}}}


def test_leaves_equal_recursive_walk(spark):
    got = {(r["path"], r["value"]) for r in N.leaves(N.nodes(docs(spark, DOC))).collect()}
    text = {True: "true", None: None}
    assert got == {(p, v if isinstance(v, str) else text[v] if v is True or v is None else json.dumps(v)) for p, v in walk(DOC)}


def test_scalar_and_unreadable_documents(spark):
    got = N.leaves(N.nodes(docs(spark, '"s"', "[1,", "7"))).collect()
    assert sorted((r["doc_id"], r["path"], r["value"]) for r in got) == [(0, "", "s"), (2, "", "7")]


def test_too_deep_is_an_error(spark):
    deep = "[" * 20 + "1" + "]" * 20
    with pytest.raises(Exception, match="nested deeper"):
        N.leaves(N.nodes(docs(spark, deep))).collect()
    assert N.leaves(N.nodes(docs(spark, deep), max_depth=20)).count() == 1


RECURSIVE = {"type": "array", "items": {"$ref": "#/$defs/Item"}, "$defs": {"Item": {
    "type": "object", "required": ["text"], "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 2}, "sub": {"type": "array", "items": {"$ref": "#/$defs/Item"}}}}}}


def test_recursive_schema(spark):
    doc = [{"text": "ok", "sub": [{"text": "x", "sub": [{"sub": [], "odd": 1}]}]}, 5]
    got = {(r["path"], r["keyword"], r["arg"], r["actual"]) for r in V.validate(N.nodes(docs(spark, doc)), RECURSIVE).collect()}
    assert got == {("/0/sub/0/text", "minLength", "2", "1"), ("/0/sub/0/sub/0", "required", "text", None),
                   ("/0/sub/0/sub/0", "additionalProperties", "text,sub", "odd"), ("/1", "type", "object", "integer")}


@pytest.mark.parametrize("schema", [
    {"type": "strng"}, {"pattern": "("}, {"$ref": "#/$defs/none"}, {"oneOf": []}, {"properties": {"a": 5}}, {"required": "a"}])
def test_malformed_schema_is_refused(schema):
    with pytest.raises(ValueError):
        V.compile_rules(schema)


def test_duplicates_by_value(spark):
    doc = {"l": [{"a": 1, "b": 2}, {"b": 2, "a": 1}, "x", "x", "x", None, None, 1, "1"]}
    got = sorted((r["path"], r["value"]) for r in Q.duplicate_items(N.nodes(docs(spark, doc))).collect())
    assert got == [("/l/1", "(complex item)"), ("/l/3", "x"), ("/l/4", "x"), ("/l/6", "null")]


def test_disabled_and_custom_checks(spark):
    checks = merge_checks({"whitespace": {"enabled": False}, "shouting": {"enabled": True, "severity": "error", "predicate": "value = upper(value)"}})
    found = Q.dq_scan(N.nodes(docs(spark, {"a": " LOUD ", "b": "", "c": None})), checks)
    assert {r["category"] for r in found.collect()} == {"shouting", "empty_vs_null"}
    first = Q.order_summary(Q.dq_summary(found, checks)).first()
    assert (first["category"], first["severity"]) == ("shouting", "error")


def test_write_keeps_non_ascii(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "s string, n int").select(F.struct("s", "n").alias("doc"))
    write_documents(df, str(tmp_path / "out"))
    back = read_documents(spark, str(tmp_path / "out")).collect()
    assert [json.loads(r["text"]) for r in back if r["text"]] == [{"s": "é", "n": 1}] and "é" in "".join(r["text"] for r in back)


def test_numbers_without_fraction_are_integers_and_nulls_are_written(spark):
    docs = parse_documents(spark.createDataFrame([(1, '{"a": 1e2}'), (2, '{"a": 1.5}'), (3, '{"a": 2.0}')], "doc_id long, text string"))
    schema = {"type": "object", "properties": {"a": {"type": "integer"}}}
    assert [r["doc_id"] for r in V.validate(N.nodes(docs), schema).collect()] == [2]
    text = spark.range(1).select(to_text(F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))).alias("t")).first()["t"]
    assert text == '{"a":null,"b":1}'


def test_unsupported_schemas_are_refused():
    for schema in ({"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"$ref": "#/$defs/x"}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            V.check_schema(schema)


def test_paths_sort_by_number_of_any_length(spark):
    steps = ["/a/2", "/a/10", "/a/1700000000001", "/a/1700000000000", "/a/007"]
    rows = spark.createDataFrame([(s,) for s in steps], "p string").orderBy(V.path_order(F.col("p"))).collect()
    assert [r["p"] for r in rows] == ["/a/2", "/a/007", "/a/10", "/a/1700000000000", "/a/1700000000001"]
