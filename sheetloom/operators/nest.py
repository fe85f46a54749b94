"""Numbered lists to trees.

An item of level k closes every deeper open slot, so slot j is open for a row iff
the last item of level j came after the last items of all lower levels.  With
the last position of every level at hand (one ``running`` call), ancestors,
parent and depth are row-local.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import BUCKET_ROWS, Last, running
from .segment import PART_ROWS


def nest(df: DataFrame, keys: Sequence[str], order: str, text: Column,
         levels: Sequence[tuple[str, str]] = T.LEVELS, orphan: str = "attach",
         list_col: str | None = None, drop: Sequence[str] = (),
         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adjacency rows ``(keys, order, text, level, parent, depth, path)``.

    ``keys`` (plus ``list_col``, whose lists must be contiguous in ``order``) name
    the list; ``path`` holds the positions of all ancestors and of the item.
    ``orphan`` says where an item without a number goes: under the deepest open
    item (attach), to the root as a header of what follows (group), or to the root
    (root).
    """
    if orphan not in ("attach", "group", "root"):
        raise ValueError(f"orphan: {orphan}")
    names = [*keys, *([list_col] if list_col else [])]
    item = T.clean(text, empty_to_none=False)
    items = df.select(*names, order, item.alias("text")).filter(F.col("text") != "")
    if drop:
        items = items.filter(~F.col("text").isin(*drop))
    items = items.withColumn("level", T.level_of(F.col("text"), levels))

    n = len(levels)
    here = F.struct(F.col(order).alias("at"), (F.col(list_col) if list_col else F.lit(0)).alias("list"))
    specs = {f"_p{j}": Last(F.when(F.col("level") == j, here), inclusive=False) for j in range(n)}
    if orphan == "group":
        specs["_head"] = Last(F.when(F.col("level") == -1, here), inclusive=False)
    rows = running(items, list(keys), order, specs, bucket_rows=bucket_rows)

    def position(name: str) -> Column:
        c = F.col(f"{name}.at")
        return F.when(F.col(f"{name}.list") == F.col(list_col), c) if list_col else c

    rows = rows.select(*items.columns, *[position(f"_p{j}").alias(f"_p{j}") for j in range(n)],
                       *([position("_head").alias("_head")] if orphan == "group" else []))
    level, slots = F.col("level"), []
    for j in range(n):
        last = F.col(f"_p{j}")
        newest = [F.col(f"_p{i}") for i in range(j)] + ([F.col("_head")] if orphan == "group" else [])
        is_open = last.isNotNull()
        for other in newest:
            is_open = is_open & (other.isNull() | (last > other))
        below = level > j
        if orphan == "attach":
            below = below | (level == -1)
        slots.append(F.when(is_open & below, last))
    if orphan == "group":
        slots.insert(0, F.when(level >= 0, F.col("_head")))
    path = F.array_compact(F.array(*slots, F.col(order)))
    return rows.select(*items.columns, path.alias("path")).select(
        *names, order, "text", F.col("level").cast("bigint").alias("level"),
        F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"),
        (F.size("path") - 1).cast("bigint").alias("depth"), "path")


def assemble_tree(nested: DataFrame, keys: Sequence[str], order: str, text_key: str = "text",
                  child_key: str = "sub", start: str | None = None,
                  part_rows: int = PART_ROWS) -> DataFrame:
    """Trees as JSON text, one row per list and part; childless items have no child key.

    Items in path order are the tree in preorder, so each item's opening and
    closing brackets follow from its depth and the next item's.  A list longer than
    ``part_rows`` positions comes in several parts; an item whose parent lies in
    an earlier part is a root of its part and names that parent in ``parent``.
    """
    at = F.col(order)
    origin = F.col(start) if start else F.lit(0).cast("bigint")
    size = F.lit(part_rows).cast("bigint")
    rows = nested.withColumn("part", F.call_function("div", at - origin, size))
    floor = origin + F.col("part") * size
    rows = rows.withColumn("_floor", floor)
    rows = rows.withColumn("_path", F.expr("filter(path, x -> x >= _floor)"))
    depth = F.size("_path") - 1
    away = F.when((depth == 0) & F.col("parent").isNotNull(), F.col("parent"))
    rows = rows.select(*keys, "part", "_path", depth.alias("_depth"),
                       F.to_json(F.struct(F.col("text").alias(text_key), away.alias("parent"))).alias("_json"))
    order_in = Window.partitionBy(*keys, "part").orderBy("_path")
    rows = rows.withColumn("_next", F.lead("_depth").over(order_in))
    following = F.coalesce("_next", F.lit(0))
    opened = F.expr("substring(_json, 1, length(_json) - 1)")
    closed = F.concat(F.col("_json"), F.repeat(F.lit("]}"), F.col("_depth") - following),
                      F.when(F.col("_next").isNotNull(), ",").otherwise(""))
    piece = F.when(following > F.col("_depth"), F.concat(opened, F.lit(f',"{child_key}":['))).otherwise(closed)
    grouped = rows.withColumn("_piece", piece).groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_path", "_piece"))).alias("_pieces"))
    tree = F.concat(F.lit("["), F.array_join(F.transform("_pieces", lambda x: x["_piece"]), ""), F.lit("]"))
    return grouped.select(*keys, "part", F.size("_pieces").cast("bigint").alias("n_items"), tree.alias("tree"))


def tree_type(depth: int, text_key: str = "text", child_key: str = "sub") -> str:
    """DDL of the fixed-depth struct array that ``from_json`` reads a tree into."""
    inner = f"struct<{text_key}:string>"
    for _ in range(depth):
        inner = f"struct<{text_key}:string,{child_key}:array<{inner}>>"
    return f"array<{inner}>"
