"""Denormalized rows to entries, groups and tiers.

Row order carries the meaning, so everything here is a running value over
``row_idx`` (see ``ordered.running``): an entry is a running count of boundary
rows, and "the value since the boundary" is the last event among rows that are a
boundary or bring a value.  None of it gathers a table, an entry or a group into
one task.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.grid import ROW, TABLE
from .ordered import BUCKET_ROWS, Last, Total, running

PART_ROWS = 100_000   # longest stretch of rows collected into one array


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _since(reset: Column, value: Column, inclusive: bool = True, when: Column | None = None) -> Last:
    """Last value brought by a row since the last reset row; a reset brings its own."""
    brings = value.isNotNull() if when is None else value.isNotNull() & _flag(when)
    return Last(F.when(_flag(reset) | brings, F.struct(value.alias("v"))), inclusive)


def _added(df: DataFrame, wanted: Sequence[str], *cols: Column) -> DataFrame:
    return df.select(*wanted, *cols)


def segment(df: DataFrame, boundary: Column, carry: Mapping[str, Column] | None = None,
            keys: Sequence[str] = (TABLE,), order: str = ROW, part_rows: int = PART_ROWS,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number entries and carry header cells down to continuation rows.

    Adds ``entry_id`` (0 before the first boundary), ``entry_start``, ``part``
    (which stretch of ``part_rows`` rows of a long entry the row is in) and every
    column of ``carry``.
    """
    specs: dict[str, Last | Total] = {
        "entry_id": Total(_flag(boundary).cast("bigint")),
        "_start": Last(F.when(_flag(boundary), F.col(order)))}
    carry = carry or {}
    for name, value in carry.items():
        specs[f"_c_{name}"] = _since(boundary, value)
    out = running(df, keys, order, specs, bucket_rows=bucket_rows)
    start = F.coalesce("_start", F.lit(1).cast("bigint"))
    kept = [c for c in df.columns if c not in carry]
    return out.select(*kept, *[F.col(f"_c_{n}.v").alias(n) for n in carry], "entry_id",
                      start.alias("entry_start"),
                      F.call_function("div", F.col(order) - start, F.lit(part_rows).cast("bigint")).alias("part"))


def carry_forward(df: DataFrame, boundary: Column, cols: Sequence[str],
                  keys: Sequence[str] = (TABLE,), order: str = ROW,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fill each column down from the last value since the boundary."""
    out = running(df, keys, order, {f"_c_{c}": _since(boundary, F.col(c)) for c in cols},
                  bucket_rows=bucket_rows)
    return out.select(*[F.col(f"_c_{c}.v").alias(c) if c in cols else F.col(c) for c in df.columns])


def segment_levels(df: DataFrame, section: Column, entry: Column, keys: Sequence[str] = (TABLE,),
                   order: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Section rows above entry rows.

    ``section_id`` and ``entry_id`` count from 1 within the table; a row between a
    section row and its first entry has entry 0.  ``row_kind`` says what the row
    is; section rows are consumed by their section.
    """
    section, entry = _flag(section), _flag(entry) & ~_flag(section)
    state = F.when(section | entry, F.struct(entry.alias("open")))
    out = running(df, keys, order, {
        "section_id": Total(section.cast("bigint")), "_entry": Total(entry.cast("bigint")),
        "_state": Last(state)}, bucket_rows=bucket_rows)
    kind = F.when(section, "section").when(entry, "entry").otherwise("continuation")
    opened = _flag(F.col("_state.open"))
    return out.select(*df.columns, "section_id",
                      F.when(opened, F.col("_entry")).otherwise(0).cast("bigint").alias("entry_id"),
                      kind.alias("row_kind"))


def subgroup_on_change(df: DataFrame, boundary: Column, key: Column, keys: Sequence[str] = (TABLE,),
                       order: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Open a group at every boundary and wherever a non-null key differs from the
    current one.  Adds ``group_id`` (running per table), ``group_key`` and
    ``group_start``."""
    before = running(df.withColumn("_key", key).withColumn("_reset", _flag(boundary)), keys, order,
                     {"_prev": _since(F.col("_reset"), F.col("_key"), inclusive=False)},
                     bucket_rows=bucket_rows)
    opens = F.col("_reset") | (F.col("_key").isNotNull() & ~F.col("_prev.v").eqNullSafe(F.col("_key")))
    out = running(before.withColumn("_opens", opens), keys, order, {
        "group_id": Total(F.col("_opens").cast("bigint")),
        "_head": Last(F.when(F.col("_opens"), F.struct(F.col("_key").alias("k"), F.col(order).alias("at"))))},
        bucket_rows=bucket_rows)
    return out.select(*df.columns, "group_id", F.col("_head.k").alias("group_key"),
                      F.col("_head.at").alias("group_start"), F.col("_opens").alias("opens"))


def subgroup_by_key(df: DataFrame, reset: Column, key: Column, triggers: Sequence[str] | None = None,
                    free: Column | None = None, keys: Sequence[str] = (TABLE,), order: str = ROW,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Current key since the last reset; the same key re-opens the same group.

    With ``triggers`` only those keys may switch, except on rows where ``free``
    holds.  Adds ``group_key`` (null before any key).
    """
    allowed = None
    if triggers is not None:
        allowed = key.isin(*triggers)
        allowed = allowed | _flag(free) if free is not None else allowed
    value = key if allowed is None else F.when(_flag(allowed), key)
    out = running(df, keys, order, {"_key": _since(reset, value)}, bucket_rows=bucket_rows)
    return out.select(*df.columns, F.col("_key.v").alias("group_key"))


def keyed_groups(df: DataFrame, parent: Sequence[str], key: str = "group_key", order: str = ROW) -> DataFrame:
    """One row per (parent, key) with the first row that opened it and its size."""
    return df.filter(F.col(key).isNotNull()).groupBy(*parent, key).agg(
        F.min(order).alias("first_row"), F.count(F.lit(1)).alias("n_rows"))


def first_value_of(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str = ROW) -> DataFrame:
    """First non-null value of each column per group, in row order."""
    return df.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def collect_ordered(df: DataFrame, keys: Sequence[str], value: Column, distinct: bool = False,
                    order: str = ROW, start: str = "entry_start", part_rows: int = PART_ROWS) -> DataFrame:
    """Values of a group as arrays in row order; nulls are left out.

    A group longer than ``part_rows`` rows comes as several rows, numbered by
    ``part``, so that no array grows with the group.  ``distinct`` keeps the first
    of equal values of the whole group.
    """
    rows = df.select(*keys, F.col(order).alias("_at"), F.col(start).alias("_start"), value.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull())
    if distinct:
        rows = rows.groupBy(*keys, "_v").agg(F.min("_at").alias("_at"), F.min("_start").alias("_start"))
    part = F.call_function("div", F.col("_at") - F.col("_start"), F.lit(part_rows).cast("bigint"))
    grouped = rows.withColumn("part", part).groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_items"))
    return grouped.select(*keys, "part", F.transform("_items", lambda x: x["_v"]).alias("items"))


def dedupe(array: Column) -> Column:
    """Array without repeats; the first of equal items stays."""
    return F.array_distinct(array)


def split_tiers(df: DataFrame, boundary: Column, text: Column, authority: Column,
                keys: Sequence[str] = (TABLE,), order: str = ROW,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Tiers inside entries: a boundary row, heading text, or a filled authority cell
    on a continuation row opens one; the heading is its label."""
    boundary = _flag(boundary)
    heading = T.is_heading(text)
    opens = boundary | heading | authority.isNotNull()
    label = F.struct(F.when(heading, text).alias("label"), F.col(order).alias("at"))
    out = running(df, keys, order, {
        "tier_id": Total(opens.cast("bigint")), "_tier": Last(F.when(opens, label))}, bucket_rows=bucket_rows)
    return out.select(*df.columns, "tier_id", F.col("_tier.label").alias("tier_label"),
                      F.col("_tier.at").alias("tier_start"), heading.alias("consumed"))


def join_split_name(df: DataFrame, boundary: Column, name: Column, keys: Sequence[str] = (TABLE,),
                    order: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Full name on boundary rows: a one-word name that does not end in ``)`` takes
    the cell of the next row of its entry, unless that is a wrapped note."""
    boundary = _flag(boundary)
    following = Last(F.struct(boundary.alias("boundary"), name.alias("name")), inclusive=False)
    out = running(df, keys, order, {"_next": following}, descending=True, bucket_rows=bucket_rows)
    rest = F.col("_next.name")
    split = (F.size(F.split(F.trim(name), f"{T.SPACE}+")) == 1) & ~name.endswith(")")
    joins = split & ~F.col("_next.boundary") & rest.isNotNull() & ~rest.rlike(T.NOTE)
    full = F.when(boundary & _flag(joins), F.concat_ws(" ", name, rest)).when(boundary, name)
    return out.select(*df.columns, full.alias("full_name"))


def conservation(df: DataFrame, boundary: Column, blank: Column, section: Column | None = None) -> DataFrame:
    """Row account per table: populated rows = entry + continuation + section +
    unassigned rows.  ``df`` carries ``entry_id``."""
    section = F.lit(False) if section is None else _flag(section)
    entry = _flag(boundary) & ~section
    live = ~_flag(blank)
    rest = live & ~entry & ~section
    return df.groupBy(TABLE).agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(~live).alias("blank_rows"),
        F.count_if(live).alias("rows_seen"), F.count_if(live & entry).alias("entry_rows"),
        F.count_if(live & section).alias("section_rows"),
        F.count_if(rest & (F.col("entry_id") > 0)).alias("continuation_rows"),
        F.count_if(rest & (F.col("entry_id") == 0)).alias("unassigned_rows"))


def unmapped_cells(cells: DataFrame, lineage: DataFrame) -> DataFrame:
    """Populated source cells that no output mentions: ``lineage`` holds the
    ``(table_id, row_idx, col_idx)`` that were emitted.  Both grow with the cells, so
    neither is sent whole to the driver and the tasks, whatever a plan's estimate says."""
    return (cells.filter(~T.is_blank_text(F.col("value")))
            .join(lineage.select(TABLE, ROW, "col_idx").hint("merge"), [TABLE, ROW, "col_idx"], "left_anti"))


def hierarchy_counts(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct groups per table at each level, one pre-aggregated pass per level.

    ``levels`` maps an output name to the columns that identify a group.
    """
    out = df.groupBy(TABLE).agg(F.count(F.lit(1)).alias("rows_seen"))
    for name, cols in levels.items():
        present = df.filter(F.greatest(*[F.col(c).isNull() for c in cols]) == False) \
            if len(cols) > 1 else df.filter(F.col(cols[0]).isNotNull())   # noqa: E712
        n = present.select(TABLE, *cols).distinct().groupBy(TABLE).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, TABLE, "left")
    return out.select(TABLE, "rows_seen", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in levels])
