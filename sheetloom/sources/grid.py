"""Tables as row-addressed grids, and grids as long cell tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import number_rows

TABLE, ROW = "table_id", "row_idx"
ADDRESS = (TABLE, ROW)


def cell_columns(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in ADDRESS]


def to_grid(df: DataFrame, table: Column, order: Sequence[str | Column],
            max_cols: int | None = None, scan_rows: int | None = None) -> DataFrame:
    """Grid of many tables: rows numbered from 1; only the first ``max_cols`` columns, if given.

    With ``scan_rows`` only the first rows of every table stay.  The cut is taken
    twice, first per slice of a table and then per table, so that no task sees
    more than slices x ``scan_rows`` rows of one table.
    """
    kept = df.columns[:max_cols]
    keyed = df.withColumn(TABLE, table)
    if scan_rows is not None:
        wanted = [F.col(c) if isinstance(c, str) else c for c in order]
        keyed = keyed.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        # the remaining columns settle ties exactly as the numbering does
        first = Window.partitionBy(TABLE, "_slice").orderBy(*wanted, *df.columns)
        keyed = keyed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= scan_rows)
        keyed = keyed.drop("_n", "_slice")
    grid = number_rows(keyed, [TABLE], order, ROW)
    if scan_rows is not None:
        grid = grid.filter(F.col(ROW) <= scan_rows)
    return grid.select(TABLE, ROW, *kept)


def original_size(df: DataFrame, table: Column) -> DataFrame:
    """Rows and columns per table before ``to_grid`` cuts anything: ``(table_id, n_rows, n_cols)``."""
    return df.groupBy(table.alias(TABLE)).agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def _as_text(field) -> Column:
    c = F.col(field.name)
    if field.dataType.typeName() in ("double", "float"):
        return T.number_text(c.cast("double"))
    return c.cast("string")


def to_cells(grid: DataFrame, infer: bool = False, apart: bool = False) -> DataFrame:
    """Long cells ``(table_id, row_idx, col_idx, header, value, cell_type)``.

    The type tag comes from the Spark type of the column; with ``infer`` string
    columns are tagged from the text of each cell.  ``apart`` reads the grid once a
    column, for a grid that lies in files by column: a task then has cells of one column,
    and what is not asked for of them is not made.
    """
    fields = [f for f in grid.schema.fields if f.name not in ADDRESS]
    cells = []
    for i, f in enumerate(fields):
        value, tag = _as_text(f), T.type_tag(f.dataType.simpleString())
        known = T.cell_type(value) if infer and tag == "str" else F.when(value.isNotNull(), tag)
        cells += [F.lit(i), F.lit(f.name), value, known]
    names = ("col_idx", "header", "value", "cell_type")
    if apart and cells:
        own = [[c.alias(n) for c, n in zip(cells[i:i + 4], names)] for i in range(0, len(cells), 4)]
        return reduce(DataFrame.unionByName, [grid.select(*ADDRESS, *c) for c in own])
    return grid.select(*ADDRESS, F.stack(F.lit(len(fields)), *cells).alias(*names))


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every table with its row and column count."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_cols")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
