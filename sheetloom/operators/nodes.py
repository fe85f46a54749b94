"""Walk JSON documents of unknown shape, without recursion or a shuffle.

A document is one VARIANT value, so its nodes are bounded by that value's size
and unfold inside the task that holds it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 16

# One level of a document is an array of nodes; opening it reads the members of its
# containers, which are the next level.
_OPENED = """transform({level}, n -> named_struct('path', n.path, 'rule_path', n.rule_path,
  'parent_path', n.parent_path, 'depth', n.depth, 'pos', n.pos, 'v', n.v,
  'm', try_cast(n.v as map<string,variant>), 'a', try_cast(n.v as array<variant>)))"""
_MEMBERS = """flatten(transform(filter({level}, n -> n.m is not null or n.a is not null), n -> coalesce(
  transform(map_entries(n.m), e -> named_struct('path', concat(n.path, '/', e.key),
    'rule_path', concat(n.rule_path, '/', e.key), 'parent_path', n.path, 'depth', n.depth + 1,
    'pos', cast(null as bigint), 'v', e.value)),
  transform(n.a, (x, i) -> named_struct('path', concat(n.path, '/', i),
    'rule_path', concat(n.rule_path, '/*'), 'parent_path', n.path, 'depth', n.depth + 1,
    'pos', cast(i as bigint), 'v', x)))))"""
_CLOSED = """transform({level}, n -> named_struct('path', n.path, 'rule_path', n.rule_path,
  'parent_path', n.parent_path, 'depth', n.depth, 'pos', n.pos,
  'box', case when n.m is not null then 'object' when n.a is not null then 'array' end,
  'n_children', cast(case when n.m is not null then size(n.m) when n.a is not null then size(n.a) end as bigint),
  'v', n.v))"""


def nodes(docs: DataFrame, doc: str = "doc", ids: Sequence[str] = ("doc_id",),
          max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every node of every document.

    Columns: ids, ``path`` (slash path, array positions as segments, root ''),
    ``rule_path`` (the same with ``*`` for positions), ``parent_path``, ``depth``,
    ``pos`` (array elements only), ``kind``, ``n_children``, the VARIANT ``v`` and
    ``mixed``: whether the document has both an empty string and a null.
    Levels unfold as one array inside the row and explode once at the end.  A document
    nested deeper than ``max_depth`` is an error, not a cut.
    """
    ids = list(ids)
    root = ("array(named_struct('path', '', 'rule_path', '', 'parent_path', cast(null as string), "
            f"'depth', 0L, 'pos', cast(null as bigint), 'v', {doc}))")
    cur = docs.filter(F.col(doc).isNotNull()).selectExpr(*ids, f"{_OPENED.format(level=root)} as _root")
    # all levels in one expression: a column per level is copied with the row by every later one
    members = _OPENED.format(level=_MEMBERS.format(level="acc.open"))
    closed = _CLOSED.format(level="acc.open")
    none = f"filter({_CLOSED.format(level='_root')}, n -> false)"
    walk = (f"aggregate(sequence(1, {max_depth}), named_struct('done', {none}, 'open', _root), (acc, step) -> if(size(acc.open) = 0, acc, "
            f"named_struct('done', concat(acc.done, {closed}), 'open', {members})))")
    cur = cur.selectExpr(*ids, f"{walk} as _walk")
    too_deep = "exists(_walk.open, n -> coalesce(size(n.m), 0) > 0 or coalesce(size(n.a), 0) > 0)"
    last = (f"if({too_deep}, raise_error('document nested deeper than max_depth={max_depth}'), "
            f"{_CLOSED.format(level='_walk.open')})")
    cur = cur.selectExpr(*ids, f"concat(_walk.done, {last}) as _all")
    mixed = ("exists(_all, n -> n.box is null and (n.v is null or is_variant_null(n.v))) "
             "and exists(_all, n -> n.box is null and coalesce(try_variant_get(n.v, '$', 'string') = '', false))")
    # outer, here and wherever a computed array is unfolded: for the inner form the
    # optimizer tests the array in a filter of its own and so computes it twice
    cur = cur.selectExpr(*ids, f"{mixed} as mixed", "explode_outer(_all) as n")
    # the text is read several times, so it is a column of its own
    scalar = cur.select(*ids, "n.*", F.when(F.col("n.box").isNull(), F.coalesce(F.to_json("n.v"), F.lit("null"))).alias("_t"), "mixed")
    return scalar.select(*ids, "path", "rule_path", "parent_path", "depth", "pos",
                         F.coalesce("box", _scalar_kind(F.col("_t"))).alias("kind"), "n_children", "v", "mixed")


def _scalar_kind(text: Column) -> Column:
    first = F.left(text, F.lit(1))
    return (F.when(first == '"', "string").when(first == "n", "null").when(first.isin("t", "f"), "boolean")
            .when(text.rlike(r"^-?\d+$"), "integer").otherwise("number"))


def value_text(kind: Column, v: Column) -> Column:
    """String nodes as their text, everything else as JSON."""
    return F.when(kind == "string", v.cast("string")).otherwise(F.to_json(v))


def leaves(tree: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Scalar nodes ``(ids, path, rule_path, kind, value)``; JSON null gives a null value."""
    kind = F.col("kind")
    value = F.when(kind != "null", value_text(kind, F.col("v")))
    return (tree.filter(~kind.isin("object", "array"))
            .select(*ids, "path", "rule_path", "kind", value.alias("value")))


def array_items(tree: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Array elements ``(ids, array_path, pos, path, kind, item)``; ``item`` is JSON
    with sorted keys, so equal objects have equal text."""
    return tree.filter(F.col("pos").isNotNull()).select(
        *ids, F.col("parent_path").alias("array_path"), "pos", "path", "kind",
        F.coalesce(F.to_json("v"), F.lit("null")).alias("item"))


def array_counts(docs: DataFrame, doc: str = "doc", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sizes of the arrays directly below the root (``root[]`` for a root array)."""
    base = docs.select(*ids, F.expr(f"try_cast({doc} as array<variant>)").alias("_root"),
                       F.expr(f"try_cast({doc} as map<string,variant>)").alias("_map"))
    whole = F.array(F.struct(F.lit("root[]").alias("name"), F.size("_root").cast("bigint").alias("size")))
    sized = F.transform(F.map_entries("_map"), lambda e: F.struct(
        e["key"].alias("name"), F.size(e["value"].try_cast("array<variant>")).cast("bigint").alias("size")))
    found = F.when(F.col("_root").isNotNull(), whole).otherwise(F.filter(sized, lambda x: x["size"].isNotNull() & (x["size"] >= 0)))
    return base.select(*ids, F.inline_outer(found)).filter(F.col("name").isNotNull())


def field_paths(tree: DataFrame) -> DataFrame:
    """Distinct field paths observed in a set of documents."""
    return tree.filter(F.col("path") != "").select("rule_path").distinct()


def field_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields shared by two document sets, new in ``a`` or missing from it."""
    left = field_paths(a).withColumn("in_a", F.lit(True))
    right = field_paths(b).withColumn("in_b", F.lit(True))
    state = (F.when(F.col("in_a") & F.col("in_b"), "shared")
             .when(F.col("in_a"), "new").otherwise("missing"))
    return left.join(right, "rule_path", "full").select("rule_path", state.alias("state"))
