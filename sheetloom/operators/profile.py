"""Column and table profiles of many grids at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.grid import ROW, TABLE, cell_columns
from .ordered import Last, Total, running
from .staging import COMPILED, stage

TYPES = ("bool", "int", "float", "date", "str")   # fixed values: cell type tags
COLUMN = (TABLE, "col_idx")


def _key(key_chars: int) -> Column:
    """Display key of a cell, null when blank.  Numbers, dates and booleans have no
    characters to clean, and printable ASCII words with single spaces stay as they
    are, so only other text pays for the cleaning."""
    value, tag = F.col("value"), F.col("cell_type")
    typed = F.coalesce(tag != "str", F.lit(False))
    short = F.length(value) <= key_chars
    return F.when(value.isNull(), None).when(short & (typed | value.rlike("^[!-~]++(?: [!-~]++)*+$")), value).when(~T.is_blank_text(value), T.cell_str(value, key_chars))


def key_counts(cells: DataFrame, key_chars: int = 40) -> DataFrame:
    """One row per (table, column, display key): the only shuffle of whole cells.

    Map-side aggregation shrinks hot keys before they move.  Blank cells share
    the null key.
    """
    keyed = cells.select(*COLUMN, "header", ROW, _key(key_chars).alias("key"), "cell_type",
                         F.length("value").alias("chars"))
    filled = F.col("key").isNotNull()
    by_type = []
    for t in TYPES:
        hit = filled & (F.col("cell_type") == t)
        by_type += [F.count_if(hit).alias(f"n_{t}"), F.min(F.when(hit, F.col(ROW))).alias(f"at_{t}")]
    return keyed.groupBy(*COLUMN, "header", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"),
        F.max(F.when(filled, F.col("chars"))).alias("chars"), *by_type)


def _inferred() -> Column:
    """Most common type; on equal counts the one seen first."""
    ranked = F.array(*[F.struct(F.col(f"n_{t}").alias("n"), (-F.col(f"at_{t}")).alias("at"),
                                F.lit(t).alias("t")) for t in TYPES])
    best = F.array_max(F.filter(ranked, lambda x: x["n"] > 0))
    return best["t"]


def _type_mix() -> Column:
    pairs = F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").alias("value")) for t in TYPES])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0))


def column_stats(keys: DataFrame, cap: int = 200) -> DataFrame:
    """Fill rate, types, distinct count and longest text per column."""
    filled = F.col("key").isNotNull()
    sums = [a for t in TYPES for a in (F.sum(f"n_{t}").alias(f"n_{t}"), F.min(f"at_{t}").alias(f"at_{t}"))]
    agg = keys.groupBy(*COLUMN, "header").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("nonempty"),
        F.count("key").alias("distinct_n"), F.coalesce(F.max("chars"), F.lit(0)).alias("max_len"), *sums)
    rate = F.round(F.try_divide(F.col("nonempty"), F.col("rows")), 3)
    return agg.select(
        *COLUMN, "header", "rows", F.coalesce(rate, F.lit(0.0)).alias("fill_rate"), "nonempty",
        "distinct_n", (F.col("distinct_n") > cap).alias("distinct_capped"),
        _inferred().alias("inferred_type"), _type_mix().alias("type_mix"), "max_len")


def top_values(keys: DataFrame, k: int = 8, cap_keys: int | None = None) -> DataFrame:
    """The k most common keys per column, earliest first among equals.

    ``cap_keys`` counts only the keys seen first, as a bounded counter does.
    """
    ranked = keys.filter(F.col("key").isNotNull())
    if cap_keys is not None:
        seen = Window.partitionBy(*COLUMN).orderBy("first_row", "key")
        ranked = ranked.withColumn("_seen", F.row_number().over(seen)).filter(F.col("_seen") <= cap_keys)
    best = Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "first_row", "key")
    return (ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(*COLUMN, "header", "rank", F.col("key").alias("value"), "n"))


def profile(cells: DataFrame, k: int = 8, cap: int = 200, cap_keys: bool = False,
            exact: bool = True) -> DataFrame:
    """Full profile of every column of every table.

    ``exact=False`` swaps the per-key shuffle for fixed-size sketches, for
    columns whose distinct values approach the row count.
    """
    if not exact:
        return _sketch_profile(cells, k, cap)
    # both parts read the counts, so cells are counted once
    keys = stage(key_counts(cells), COMPILED)
    top = (top_values(keys, k, cap if cap_keys else None).groupBy(*COLUMN)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                            lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
                .alias("top_values")))
    return column_stats(keys, cap).join(top, list(COLUMN), "left")


def _sketch_profile(cells: DataFrame, k: int, cap: int) -> DataFrame:
    filled = F.col("key").isNotNull()
    by_type = []
    for t in TYPES:
        hit = filled & (F.col("cell_type") == t)
        by_type += [F.count_if(hit).alias(f"n_{t}"), F.min(F.when(hit, F.col(ROW))).alias(f"at_{t}")]
    agg = cells.withColumn("key", _key(40)).groupBy(*COLUMN, "header").agg(
        F.count(F.lit(1)).alias("rows"), F.count("key").alias("nonempty"),
        F.approx_count_distinct("key", 0.02).alias("distinct_n"),
        F.coalesce(F.max(F.when(filled, F.length("value"))), F.lit(0)).alias("max_len"),
        F.expr(f"approx_top_k(key, {k}) FILTER (WHERE key IS NOT NULL)").alias("top"), *by_type)
    return agg.select(
        *COLUMN, "header", "rows", F.round(F.col("nonempty") / F.col("rows"), 3).alias("fill_rate"),
        "nonempty", "distinct_n", (F.col("distinct_n") > cap).alias("distinct_capped"),
        _inferred().alias("inferred_type"), _type_mix().alias("type_mix"), "max_len",
        F.transform("top", lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count")))
        .alias("top_values"))


# ---- table level ------------------------------------------------------------

def dims(grid: DataFrame, max_cols: int = 60, scan_rows: int = 5000, original: DataFrame | None = None) -> DataFrame:
    """Rows, columns, the scanned window, and whether the table is larger than it.

    A grid that ``to_grid`` has cut no longer shows it; ``original``
    (``grid.original_size``) gives the sizes from before the cut.  A table is as wide as its
    last column with any cell, whatever else the grid holds.
    """
    zero = F.lit(0).cast("bigint")
    width = F.greatest(zero, zero, *[F.when(F.col(c).isNotNull(), F.lit(i).cast("bigint")) for i, c in enumerate(cell_columns(grid), 1)])
    seen = grid.groupBy(TABLE).agg(F.max(ROW).alias("max_row"), F.max(width).alias("max_col"))
    rows, cols = F.col("max_row"), F.col("max_col")
    if original is not None:
        seen = seen.join(original.select(TABLE, "n_rows", "n_cols"), TABLE, "left")
        rows, cols = F.greatest("max_row", "n_rows"), F.greatest("max_col", "n_cols")
    return seen.select(
        TABLE, "max_row", "max_col",
        F.least("max_row", F.lit(scan_rows).cast("bigint")).alias("scanned_rows"),
        ((rows > scan_rows) | (cols > max_cols)).alias("truncated"))


def blank_rows(grid: DataFrame) -> DataFrame:
    return grid.filter(T.is_blank([F.col(c).cast("string") for c in cell_columns(grid)])).select(TABLE, ROW)


def blank_gaps(grid: DataFrame, listed: int = 30) -> DataFrame:
    """Blank rows per table: how many, and the numbers of the first ``listed``."""
    blank = blank_rows(grid)
    first = Window.partitionBy(TABLE).orderBy(ROW)
    rows = (blank.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= listed)
            .groupBy(TABLE).agg(F.array_sort(F.collect_list(ROW)).alias("rows")))
    return blank.groupBy(TABLE).agg(F.count(F.lit(1)).alias("gaps")).join(rows, TABLE)


def blank_bands(grid: DataFrame, min_rows: int = 2) -> DataFrame:
    """Runs of at least ``min_rows`` blank rows: wide bands suggest stacked tables,
    single gaps only separate records."""
    cols = [F.col(c).cast("string") for c in cell_columns(grid)]
    marked = grid.select(TABLE, ROW, T.is_blank(cols).alias("blank"))
    filled = running(marked, [TABLE], ROW, {"filled": Total(F.when(F.col("blank"), 0).otherwise(1).cast("bigint"))})
    bands = filled.filter("blank").groupBy(TABLE, "filled").agg(
        F.min(ROW).alias("start_row"), F.count(F.lit(1)).alias("n_rows"))
    return bands.filter(F.col("n_rows") >= min_rows).drop("filled")


def null_runs(grid: DataFrame, min_rows: int = 2) -> DataFrame:
    """Vertical runs of nulls under a value, which is what merged cells leave behind."""
    cols = cell_columns(grid)
    totals = {f"run_{i}": Total(F.col(c).isNotNull().cast("bigint")) for i, c in enumerate(cols)}
    runs = running(grid, [TABLE], ROW, totals)
    long = runs.unpivot([TABLE, ROW], [f"run_{i}" for i in range(len(cols))], "col", "run")
    found = long.filter(F.col("run") > 0).groupBy(TABLE, "col", "run").agg(
        F.min(ROW).alias("start_row"), F.count(F.lit(1)).alias("n_rows"))
    return found.filter(F.col("n_rows") >= min_rows).select(
        TABLE, F.regexp_extract("col", r"\d+$", 0).cast("bigint").alias("col_idx"), "start_row", "n_rows")


# ---- suggestions from a profile ----------------------------------------------

def monotonic_columns(cells: DataFrame) -> DataFrame:
    """Per column: number of whole-number values that do not exceed the one before."""
    ints = cells.select(*COLUMN, ROW, F.when(F.col("cell_type") == "int", F.col("value").try_cast("decimal(38,0)")).alias("v"))
    counts = ints.groupBy(*COLUMN).agg(F.count("v").alias("ints"))
    # other cells change no running value, so only numbers move; a null key is an error there
    numbers = ints.filter(F.col("v").isNotNull() | F.col(COLUMN[0]).isNull() | F.col(COLUMN[1]).isNull())
    seen = running(numbers, list(COLUMN), ROW, {"before": Last(F.col("v"), inclusive=False)})
    breaks = seen.groupBy(*COLUMN).agg(F.count_if(F.col("v") <= F.col("before")).alias("breaks"))
    return counts.join(breaks, list(COLUMN), "left").select(*COLUMN, F.coalesce("breaks", F.lit(0).cast("bigint")).alias("breaks"), "ints")


def suggest_boundary(prof: DataFrame, monotonic: DataFrame) -> DataFrame:
    """Column most likely to start an entry: a rising whole number or an identifier
    (no value repeated), at the lowest fill rate.  The rule is ours."""
    scored = prof.join(monotonic, list(COLUMN), "left")
    rising = (F.col("ints") == F.col("nonempty")) & (F.col("breaks") == 0)
    unique = F.col("distinct_n") == F.col("nonempty")
    reason = F.when(rising, "rising-number").when(unique, "identifier")
    order = Window.partitionBy(TABLE).orderBy(F.when(rising, 0).otherwise(1), "fill_rate", "col_idx")
    return (scored.filter((F.col("nonempty") > 1) & (F.col("fill_rate") < 1) & reason.isNotNull())
            .withColumn("rank", F.row_number().over(order)).filter("rank = 1")
            .select(*COLUMN, "header", "fill_rate", reason.alias("reason")))


def suggest_roles(prof: DataFrame, boundary: DataFrame) -> DataFrame:
    """Role by fill rate relative to the boundary column: header attribute up to 1.5
    times, sub-group key up to 4 times if it has few values, else detail list."""
    fill = boundary.select(TABLE, F.col("col_idx").alias("boundary_col"), F.col("fill_rate").alias("boundary_fill"))
    ratio = F.try_divide(F.col("fill_rate"), F.col("boundary_fill"))
    role = (F.when(F.col("col_idx") == F.col("boundary_col"), "boundary")
            .when(F.col("nonempty") == 0, "empty")
            .when(ratio <= 1.5, "header")
            .when((ratio <= 4) & (F.col("distinct_n") <= 15), "subgroup")
            .otherwise("detail"))
    return prof.join(fill, TABLE).select(*COLUMN, "header", "fill_rate", role.alias("role"))


def enum_candidates(keys: DataFrame, max_values: int = 15) -> DataFrame:
    """Text columns with few distinct values, and the values."""
    # both sides read the counts, so cells are counted once
    keys = stage(keys.select(*COLUMN, "header", "key", "n", "n_str"), COMPILED)
    small = keys.filter(F.col("key").isNotNull()).groupBy(*COLUMN, "header").agg(
        F.count(F.lit(1)).alias("distinct_n"), F.sum("n_str").alias("n_str"), F.sum("n").alias("n"))
    small = small.filter(F.col("distinct_n").between(2, max_values) & (F.col("n_str") * 2 > F.col("n")))
    # at most max_values keys per column reach the list
    return keys.filter(F.col("key").isNotNull()).join(small.select(*COLUMN, "distinct_n"), list(COLUMN)).groupBy(
        *COLUMN, "header", "distinct_n").agg(F.array_sort(F.collect_list("key")).alias("values"))


def numbering_styles(values: DataFrame, column: str = "value") -> DataFrame:
    """List-numbering styles seen per column, from rows ``(table_id, col_idx, value)``."""
    styles = [F.bool_or(F.col(column).rlike(p)).alias(f"s{i}") for i, (_, p) in enumerate(T.NUMBERING_STYLES)]
    found = values.groupBy(*COLUMN).agg(*styles)
    marks = [F.when(F.col(f"s{i}"), label) for i, (label, _) in enumerate(T.NUMBERING_STYLES)]
    return found.select(*COLUMN, F.array_compact(F.array(*marks)).alias("styles")).filter(F.size("styles") > 0)
