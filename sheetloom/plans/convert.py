"""Convert denormalized sheets into nested documents."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.assemble import assemble_document
from ..operators.nest import assemble_tree, nest
from ..operators.ordered import Last, running
from ..operators.segment import PART_ROWS, segment, subgroup_by_key
from ..operators.staging import stage
from ..operators.segment import subgroup_on_change
from ..sources.grid import ROW, TABLE, cell_columns


@dataclass(frozen=True)
class Level:
    """One level of groups inside an entry; a spec lists them from the outside in.

    A group opens where its parent opens. Without ``keyed`` it also opens where a
    non-null ``key`` differs from the current one, and every row of the parent is in a
    group. With ``keyed`` the current key is the last one since the parent opened, the
    same key in the same parent is the same group wherever it comes back, rows before
    any key are in no group of this level, and with ``triggers`` only those keys switch,
    except on rows where ``free`` holds. Each group has its key (``key_name``), the first
    non-null value of each ``first``, the values of ``distinct`` without repeats and of
    ``lists`` in row order (placeholders left out), each ``trees`` column nested by
    numbering as a VARIANT tree, and the array of its children.
    """
    name: str
    key: Column
    keyed: bool = False
    triggers: Sequence[str] | None = None
    free: Column | None = None
    key_name: str = "key"
    first: Mapping[str, Column] = field(default_factory=dict)
    distinct: Mapping[str, Column] = field(default_factory=dict)
    lists: Mapping[str, Column] = field(default_factory=dict)
    trees: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class SheetSpec:
    """What the cells of a sheet mean.

    ``boundary`` starts an entry; ``header`` names entry attributes, ``group`` a
    sub-group key that opens a group where it changes, ``lists`` the detail cells.
    """
    boundary: Column
    header: Mapping[str, Column]
    lists: Mapping[str, Column]
    group: Column | None = None
    placeholders: Sequence[str] = field(default=T.PLACEHOLDERS)
    levels: Sequence[Level] = ()
    distinct: Mapping[str, Column] = field(default_factory=dict)
    trees: Mapping[str, Column] = field(default_factory=dict)


def _live(grid: DataFrame) -> DataFrame:
    return grid.filter(~T.is_blank([F.col(c).cast("string") for c in cell_columns(grid)]))


def unassigned(grid: DataFrame, spec: SheetSpec) -> DataFrame:
    """The rows ``(table_id, row_idx)`` that ``convert`` gives to no entry: those before the first boundary."""
    return segment(_live(grid), spec.boundary).filter(F.col("entry_id") == 0).select(TABLE, ROW)


def convert(grid: DataFrame, spec: SheetSpec, part_rows: int = PART_ROWS) -> DataFrame:
    """One nested document per entry (and part of a very long entry).

    A header attribute is the first value that its cell has in the entry, the boundary row
    first; a value further down neither changes it nor splits the entry.  All parts of an
    entry have the same attributes.
    """
    if spec.levels:
        if spec.group is not None:
            raise ValueError("give either group or levels")
        return convert_levels(grid, spec, part_rows)
    live = _live(grid)
    rows = live
    if spec.group is not None:
        # the second running pass reads the first, so it starts from a written table
        rows = stage(subgroup_on_change(live, spec.boundary, spec.group))
    rows = segment(rows, spec.boundary, part_rows=part_rows).filter(F.col("entry_id") > 0)
    lists = {n: F.when(~T.is_placeholder(c, spec.placeholders), c) for n, c in spec.lists.items()}
    entry = [TABLE, "entry_id", "part"]
    levels = [] if spec.group is None else [("groups", ["group_id", "group_key"])]
    docs = assemble_document(rows, entry, levels, lists, first=spec.header)
    whole = Window.partitionBy(TABLE, "entry_id")      # the parts of one entry
    return docs.select(*[F.min(c).over(whole)["v"].alias(c) if c in spec.header else F.col(c) for c in docs.columns])


_ENTRY = [TABLE, "entry_id", "part"]


def _keys(grid: DataFrame, spec: SheetSpec, part_rows: int) -> tuple[DataFrame, list[list[str]]]:
    """Rows of entries with the key columns of every level; per level, the columns that name a group."""
    rows = _live(grid).withColumn("_o0", F.coalesce(spec.boundary, F.lit(False)))
    names: list[list[str]] = []
    for k, level in enumerate(spec.levels, 1):
        reset = F.col(f"_o{k - 1}")
        if level.keyed:
            rows = subgroup_by_key(rows, reset, level.key, level.triggers, level.free).withColumnRenamed("group_key", f"_k{k}")
            if k < len(spec.levels):
                # a child opens where this level switches to another key or its parent opens
                rows = running(rows, [TABLE], ROW, {"_p": Last(F.struct(F.col(f"_k{k}").alias("v")), inclusive=False)})
                rows = rows.withColumn(f"_o{k}", reset | ~F.col("_p.v").eqNullSafe(F.col(f"_k{k}"))).drop("_p")
            names.append([*(names[-1] if names else []), f"_k{k}"])
        else:
            rows = (subgroup_on_change(rows, reset, level.key).drop("group_start")
                    .withColumnRenamed("group_id", f"_g{k}").withColumnRenamed("group_key", f"_k{k}").withColumnRenamed("opens", f"_o{k}"))
            names.append([*(names[-1] if names else []), f"_g{k}"])
        # the next running pass reads this one, so it starts from a written table
        rows = stage(rows)
    rows = segment(rows, spec.boundary, part_rows=part_rows).filter(F.col("entry_id") > 0)
    return rows, names


def _attributes(rows: DataFrame, keys: list[str], first: Mapping[str, Column], distinct: Mapping[str, Column],
                lists: Mapping[str, Column], trees: Mapping[str, Column], placeholders: Sequence[str], extra=()) -> DataFrame:
    def kept(c: Column) -> Column:
        return F.when(~T.is_placeholder(c, placeholders), c)

    def held(c: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(ROW).alias("at"), c.alias("v")))))

    agg = [F.min(ROW).alias("_at"), *extra]
    agg += [F.min(F.when(c.isNotNull(), F.struct(F.col(ROW).alias("at"), c.alias("v"))))["v"].alias(n) for n, c in first.items()]
    agg += [F.array_distinct(F.transform(held(kept(c)), lambda x: x["v"])).alias(n) for n, c in distinct.items()]
    agg += [F.transform(held(kept(c)), lambda x: x["v"]).alias(n) for n, c in lists.items()]
    out = rows.groupBy(*keys).agg(*agg)
    for n, c in trees.items():
        items = rows.select(*keys, ROW, "entry_start", c.alias("_item"))
        nested = nest(items, keys, ROW, F.col("_item"), drop=tuple(placeholders))
        made = (assemble_tree(nested.join(items.select(*keys, ROW, "entry_start"), [*keys, ROW]), keys, ROW, start="entry_start")
                .select(*keys, F.parse_json("tree").alias(n)))
        out = out.join(made.groupBy(*keys).agg(F.first(n).alias(n)), keys, "left")
    return out


def convert_levels(grid: DataFrame, spec: SheetSpec, part_rows: int = PART_ROWS) -> DataFrame:
    """One nested document per entry (and part of a very long entry) with the levels of ``spec``.

    Keys come from running values, one pass per level; then each level's groups are
    aggregated from their rows and folded into their parents' arrays from the inside
    out, children in the order of their first row. A group without children has an
    empty array, a tree without items is null. Rows move by entry; no group is
    gathered beyond a part of ``part_rows`` rows.
    """
    rows, names = _keys(grid, spec, part_rows)
    rows = rows.repartition(*[F.col(c) for c in _ENTRY])
    built = None
    for k in range(len(spec.levels), 0, -1):
        level = spec.levels[k - 1]
        keys = [*_ENTRY, *names[k - 1]]
        mine = rows.filter(F.col(f"_k{k}").isNotNull()) if level.keyed else rows
        key = (F.col(f"_k{k}") if level.keyed else F.min(F.when(F.col(f"_o{k}"), F.struct(F.col(ROW).alias("at"), F.col(f"_k{k}").alias("v"))))["v"])
        out = _attributes(mine, keys, level.first, level.distinct, level.lists, level.trees, spec.placeholders,
                          extra=[] if level.keyed else [key.alias(level.key_name)])
        if level.keyed:
            out = out.withColumnRenamed(f"_k{k}", level.key_name).withColumn(f"_k{k}", F.col(level.key_name))
        inner = []
        if built is not None:
            child = spec.levels[k]
            out = out.join(built, keys, "left").withColumn(child.name, F.coalesce(child.name, F.array()))
            inner = [child.name]
        fields = [level.key_name, *level.first, *level.distinct, *level.lists, *level.trees, *inner]
        parent = [*_ENTRY, *names[k - 2]] if k > 1 else _ENTRY
        by_first = lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0)
        built = out.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct("_at", *fields)), by_first).alias("_items"))
        built = built.select(*parent, F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(level.name))
    firsts = [F.min(F.when(c.isNotNull(), F.struct(F.col(ROW).alias("at"), c.alias("v")))).alias(n) for n, c in spec.header.items()]
    top = _attributes(rows, _ENTRY, {}, spec.distinct, spec.lists, spec.trees, spec.placeholders, extra=firsts)
    first_level = spec.levels[0].name
    docs = top.join(built, _ENTRY, "left").withColumn(first_level, F.coalesce(first_level, F.array()))
    whole = Window.partitionBy(TABLE, "entry_id")      # the parts of one entry share its attributes
    header = [F.min(c).over(whole)["v"].alias(c) for c in spec.header]
    return docs.select(*_ENTRY, *header, *spec.distinct, *spec.lists, *spec.trees, first_level)


def _column_name(c: Column) -> str:
    """The cell column that a spec column reads; lineage needs plain column references."""
    text = str(c)
    if text.startswith("Column<'") and text.endswith("'>"):
        return text[len("Column<'"):-2].strip("`")
    raise ValueError(f"lineage needs plain cell columns, not {text}")


def lineage(grid: DataFrame, spec: SheetSpec, part_rows: int = PART_ROWS) -> DataFrame:
    """(table_id, row_idx, col_idx) of every cell whose value the documents of ``convert`` with levels hold.

    A key cell counts when its value is its group's key, a first-value cell when its value
    is the value chosen for its group or entry, a list, distinct or tree cell when it is
    not a placeholder and its row is in a group of that level. Cells of rows before the
    first entry, placeholders and values that a first value or key hides count nowhere.
    """
    if not spec.levels:
        raise ValueError("lineage is given for specs with levels")
    rows, names = _keys(grid, spec, part_rows)
    cells = {c: i for i, c in enumerate(cell_columns(grid))}

    class _Index(dict):
        def __missing__(self, name):
            raise ValueError(f"lineage needs plain cell columns, not {name}")

    index = _Index(cells)

    def kept(c: Column) -> Column:
        return c.isNotNull() & ~T.is_placeholder(c, spec.placeholders)

    def chosen(c: Column, keys: list[str]) -> Column:
        first = F.min(F.when(c.isNotNull(), F.struct(F.col(ROW).alias("at"), c.alias("v")))).over(Window.partitionBy(*keys))["v"]
        return c.isNotNull() & (c == first)

    marks: list[tuple[int, Column]] = [(index[_column_name(c)], chosen(c, [TABLE, "entry_id"])) for c in spec.header.values()]
    marks += [(index[_column_name(c)], kept(c)) for c in [*spec.distinct.values(), *spec.lists.values(), *spec.trees.values()]]
    for k, level in enumerate(spec.levels, 1):
        inside = F.col(f"_k{k}").isNotNull() if level.keyed else F.lit(True)
        keys = [*_ENTRY, *names[k - 1]]
        marks.append((index[_column_name(level.key)], level.key.isNotNull() & (level.key == F.col(f"_k{k}"))))
        marks += [(index[_column_name(c)], inside & chosen(c, keys)) for c in level.first.values()]
        marks += [(index[_column_name(c)], inside & kept(c)) for c in [*level.distinct.values(), *level.lists.values(), *level.trees.values()]]
    held = F.array_distinct(F.array_compact(F.array(*[F.when(m, F.lit(j)) for j, m in marks])))
    return rows.select(TABLE, ROW, held.alias("_held")).select(TABLE, ROW, F.explode("_held").alias("col_idx"))
