"""Validate documents against a JSON Schema subset.

A schema is expanded on the driver into one rule per field path (its size is that
of the schema, never of the data); nodes meet their rule in one equi-join on the
path and all keywords are tested in one projection.
"""
from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expectations as X
from .nodes import MAX_DEPTH, value_text
from .staging import stage

# Schema keywords that are tested, and those that only annotate.
TESTED = {"type", "required", "additionalProperties", "properties", "items", "$ref", "enum", "const",
          "pattern", "minLength", "minItems", "minimum"}
NOTES = {"$schema", "$id", "$defs", "title", "description", "default", "$comment", "examples"}
TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}
BROADCAST_RULES = 10_000

RULE_SCHEMA = """rule_path string, types array<string>, required array<string>, allowed array<string>,
enum array<string>, pattern string, min_length bigint, min_items bigint, minimum double"""


@dataclass(frozen=True)
class Rule:
    rule_path: str
    types: list | None = None
    required: list | None = None
    allowed: list | None = None
    enum: list | None = None
    pattern: str | None = None
    min_length: int | None = None
    min_items: int | None = None
    minimum: float | None = None


def _canonical(value: object) -> str:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def check_schema(schema: Mapping) -> None:
    """Refuse a malformed or unsupported rule set before any data is read."""
    for where, part in _parts(schema, "#", set()):
        unknown = set(part) - TESTED - NOTES
        if unknown:
            raise ValueError(f"{where}: unsupported keywords {sorted(unknown)}")
        types = part.get("type")
        for t in [types] if isinstance(types, str) else types or []:
            if t not in TYPES:
                raise ValueError(f"{where}: unknown type {t!r}")
        if "pattern" in part:
            try:
                re.compile(part["pattern"])
            except re.error as e:
                raise ValueError(f"{where}: bad pattern: {e}") from e
        if not isinstance(part.get("required", []), list) or not isinstance(part.get("enum", []), list):
            raise ValueError(f"{where}: required and enum must be lists")
        if not isinstance(part.get("additionalProperties", True), bool):
            raise ValueError(f"{where}: additionalProperties as a schema is not supported")
        if "$ref" in part:
            _resolve(part, schema)


def _parts(part: object, where: str, seen: set):
    if not isinstance(part, Mapping):
        raise ValueError(f"{where}: not an object")
    yield where, part
    for group in ("properties", "$defs"):
        for name, inner in part.get(group, {}).items():
            yield from _parts(inner, f"{where}/{group}/{name}", seen)
    if "items" in part:
        yield from _parts(part["items"], f"{where}/items", seen)


def _resolve(part: Mapping, root: Mapping, seen: tuple[str, ...] = ()) -> Mapping:
    if "$ref" not in part:
        return part
    if part["$ref"] in seen:
        raise ValueError(f"reference {part['$ref']!r} leads back to itself")
    target = root
    for step in part["$ref"].lstrip("#/").split("/"):
        if step not in target:
            raise ValueError(f"unresolved reference {part['$ref']!r}")
        target = target[step]
    return {**_resolve(target, root, (*seen, part["$ref"])), **{k: v for k, v in part.items() if k != "$ref"}}


def compile_rules(schema: Mapping, max_depth: int = MAX_DEPTH) -> list[Rule]:
    """One rule per path down to the walk's depth; recursion unrolls that far."""
    check_schema(schema)
    rules: list[Rule] = []

    def visit(part: Mapping, path: str, depth: int) -> None:
        part = _resolve(part, schema)
        types = part.get("type")
        enum = part.get("enum", [part["const"]] if "const" in part else None)
        closed = part.get("additionalProperties") is False
        rules.append(Rule(
            path, [types] if isinstance(types, str) else types, part.get("required"),
            list(part.get("properties", {})) if closed else None,
            [_canonical(v) for v in enum] if enum is not None else None,
            part.get("pattern"), part.get("minLength"), part.get("minItems"),
            None if part.get("minimum") is None else float(part["minimum"])))
        if depth < max_depth:
            for name, inner in part.get("properties", {}).items():
                visit(inner, f"{path}/{name}", depth + 1)
            if "items" in part:
                visit(part["items"], f"{path}/*", depth + 1)

    visit(schema, "", 0)
    return rules


def _keys(kind: Column, v: Column) -> Column:
    return F.when(kind == "object", F.map_keys(v.try_cast("map<string,variant>")))


def validate(tree: DataFrame, schema: Mapping, ids: Sequence[str] = ("doc_id",),
             max_depth: int = MAX_DEPTH, keywords: Sequence[str] | None = None) -> DataFrame:
    """Errors ``(ids, path, keyword, arg, actual)`` of the nodes of documents."""
    rules = compile_rules(schema, max_depth)
    table = tree.sparkSession.createDataFrame([tuple(r.__dict__.values()) for r in rules], RULE_SCHEMA)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    kind, v = F.col("kind"), F.col("v")
    rows = tree.join(table, "rule_path").select(
        *ids, "path", "kind", "n_children", "rule_path", *[f for f in Rule.__dataclass_fields__ if f != "rule_path"],
        _keys(kind, v).alias("keys"), value_text(kind, v).alias("value"),
        F.when(F.col("enum").isNotNull(), F.coalesce(F.to_json(v), F.lit("null"))).alias("item"))

    def error(keyword: str, broken: Column, arg: Column, actual: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.struct(
            F.lit(keyword).alias("keyword"), arg.cast("string").alias("arg"), actual.cast("string").alias("actual")))

    number = F.col("value").try_cast("double")
    whole = F.coalesce((kind == "number") & (number == F.floor(number)), F.lit(False))
    is_text, is_number = kind == "string", kind.isin("integer", "number")
    broken_pattern = F.lit(False)
    for pattern in sorted({r.pattern for r in rules if r.pattern is not None}):
        broken_pattern = broken_pattern | ((F.col("pattern") == pattern) & X.breaks_pattern(F.col("value"), pattern))
    extra = X.extra_fields(F.col("keys"), F.col("allowed"))
    single = F.array(
        error("type", X.breaks_type(kind, F.col("types"), whole), F.array_join("types", "|"), kind),
        error("additionalProperties", F.size(extra) > 0, F.array_join("allowed", ","), F.array_join(extra, ",")),
        error("enum", X.breaks_enum(F.col("item"), F.col("enum")), F.array_join("enum", ","), F.col("item")),
        error("pattern", is_text & broken_pattern, F.col("pattern"), F.col("value")),
        error("minLength", is_text & X.shorter_than(F.col("value"), F.col("min_length")), F.col("min_length"),
              F.length("value")),
        error("minItems", (kind == "array") & (F.col("n_children") < F.col("min_items")), F.col("min_items"),
              F.col("n_children")),
        error("minimum", is_number & (F.col("value").try_cast("double") < F.col("minimum")), F.col("minimum"),
              F.col("value")))
    missing = F.transform(X.missing_fields(F.col("keys"), F.col("required")), lambda k: F.struct(
        F.lit("required").alias("keyword"), k.alias("arg"), F.lit(None).cast("string").alias("actual")))
    found = F.concat(F.array_compact(single), F.coalesce(missing, F.array().cast(
        "array<struct<keyword:string,arg:string,actual:string>>")))
    out = rows.select(*ids, "path", F.inline_outer(found)).filter(F.col("keyword").isNotNull())
    return out if keywords is None else out.filter(F.col("keyword").isin(*keywords))


def path_order(path: Column) -> Column:
    """Sort key of a slash path: positions by number, names by text."""
    # a number sorts by its length, then by its digits, however long it is
    return F.transform(F.split(path, "/"), lambda s: F.when(
        s.rlike(r"^\d+$"), F.concat(F.lpad(F.length(F.regexp_replace(s, "^0+(?=.)", "")).cast("string"), 10, "0"), F.lit(":"),
                                   F.regexp_replace(s, "^0+(?=.)", ""))).otherwise(s))


def top_errors(errors: DataFrame, n: int = 50, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First ``n`` errors of every document by path, with the number left out."""
    order = Window.partitionBy(*ids).orderBy(path_order(F.col("path")), "keyword", "arg")
    counts = errors.groupBy(*ids).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("overflow"))
    first = errors.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)
    return first.join(counts, list(ids))


def validity(docs: DataFrame, errors: DataFrame, ids: Sequence[str] = ("doc_id",), doc: str = "doc") -> DataFrame:
    """Verdict and error count per document; an unreadable document is not valid."""
    counts = errors.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    readable = docs.select(*ids, F.col(doc).isNotNull().alias("readable"))
    return readable.join(counts, list(ids), "left").select(
        *ids, "readable", (F.col("readable") & (n == 0)).alias("valid"), n.alias("error_count"))


def schema_fields(schemas: DataFrame, ids: Sequence[str] = ("schema_id",)) -> DataFrame:
    """Definition and property names anywhere in schema documents, from their nodes."""
    found = schemas.filter(F.col("path") != "").select(
        *ids, F.split("path", "/").alias("steps"))
    name, parent = F.element_at("steps", -1), F.element_at("steps", -2)
    is_def = (F.size("steps") == 3) & (parent == "$defs")
    kind = F.when(is_def, "definition").when(parent == "properties", "field")
    return found.select(*ids, kind.alias("kind"), name.alias("name")).filter(F.col("kind").isNotNull()).distinct()


def infer_schema(tree: DataFrame, ids: Sequence[str] = ("doc_id",), max_enum: int = 15) -> DataFrame:
    """Rules that the given documents satisfy, one row per field path.

    ``required`` says that every parent object has the field; ``enum`` lists the
    values of a text field with few of them.  The rule is ours.
    """
    kind = F.col("kind")
    up = F.regexp_replace("rule_path", "/[^/]*$", "")
    text = F.when(kind == "string", F.col("v").cast("string"))
    rows = tree.select("rule_path", up.alias("up"), "kind", text.alias("text"), "n_children",
                       F.when(kind.isin("integer", "number"), F.to_json("v").try_cast("double")).alias("num"))
    # values are counted before they meet in one group per path, and written, so that the
    # documents are walked once
    values = stage(rows.groupBy("rule_path", "up", "kind", "text").agg(
        F.count(F.lit(1)).alias("n"), F.min("num").alias("num"), F.min("n_children").alias("children")))
    per = values.groupBy("rule_path", "up").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("types"),
        F.count("text").alias("distinct_n"), F.min(F.length("text")).alias("min_length"),
        F.min("num").alias("minimum"), F.min(F.when(kind == "array", F.col("children"))).alias("min_items"))
    few = per.filter(F.col("distinct_n").between(1, max_enum)).select("rule_path")
    # at most max_enum values per path reach the list
    enum = values.filter(F.col("text").isNotNull()).join(few, "rule_path").groupBy("rule_path").agg(
        F.array_sort(F.collect_list("text")).alias("enum"))
    objects = values.filter(kind == "object").groupBy(F.col("rule_path").alias("up")).agg(F.sum("n").alias("_parents"))
    return per.join(objects, "up", "left").join(enum, "rule_path", "left").select(
        "rule_path", "types", "n", F.coalesce(F.col("n") == F.col("_parents"), F.lit(False)).alias("required"),
        "min_length", "minimum", "min_items", "enum")
