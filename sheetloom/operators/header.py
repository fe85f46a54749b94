"""Header rows: detection, splitting, and samples of the data below."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.grid import ROW, TABLE, cell_columns
from .ordered import BUCKET_ROWS, bucket_of


def detect_header(grid: DataFrame, max_probe: int = 15) -> DataFrame:
    """Densest texty row among the first rows: 2 x text cells + filled cells.

    A table without any of those rows keeps row 1 as its header row, with score 0.
    """
    filled, texty = F.lit(0), F.lit(0)
    for f in grid.schema.fields:
        if f.name in (TABLE, ROW):
            continue
        one = F.when(T.is_blank_text(F.col(f.name).cast("string")), 0).otherwise(1)
        filled = filled + one
        if f.dataType.typeName() == "string":
            texty = texty + one
    probed = F.col(ROW) <= max_probe
    scored = grid.select(TABLE, ROW, F.when(probed, texty * 2 + filled).alias("score"))
    best = F.max_by(F.struct(ROW, "score"), F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col(ROW))))
    return scored.groupBy(TABLE).agg(best.alias("b")).select(
        TABLE, F.coalesce(f"b.{ROW}", F.lit(1).cast("bigint")).alias("header_row"),
        F.coalesce(F.col("b.score").cast("bigint"), F.lit(0).cast("bigint")).alias("score"))


def attach_per_table(grid: DataFrame, per_table: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Join one row per table onto the grid without gathering a large table.

    The table row is repeated once per row bucket of its table, and the join is
    on (table, bucket), so a table with a third of all rows meets its row in as
    many tasks as it has buckets.
    """
    last = grid.groupBy(TABLE).agg(F.max(ROW).alias("_last"))
    repeated = per_table.join(last, TABLE).withColumn(
        "_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), bucket_of("_last", bucket_rows)))).drop("_last")
    return (grid.withColumn("_bucket", bucket_of(ROW, bucket_rows))
            .join(repeated, [TABLE, "_bucket"]).drop("_bucket"))


def split_header(grid: DataFrame, header: DataFrame | int | None = None) -> DataFrame:
    """Data rows below the header; row numbers stay those of the sheet.

    ``header`` overrides detection, for all tables (a number) or by table
    (``table_id, header_row``).
    """
    if isinstance(header, int):
        return grid.filter(F.col(ROW) > header).withColumn("header_row", F.lit(header).cast("bigint"))
    rows = detect_header(grid) if header is None else header
    return attach_per_table(grid, rows.select(TABLE, "header_row")).filter(F.col(ROW) > F.col("header_row"))


def header_cells(grid: DataFrame, header: DataFrame) -> DataFrame:
    """Display text of the header cells ``(table_id, col_idx, header)``."""
    cols = cell_columns(grid)
    # a header row lies among the probed rows, so this join starts from few rows
    rows = grid.join(header.select(TABLE, F.col("header_row").alias(ROW)), [TABLE, ROW])
    cells = F.posexplode(F.array(*[T.cell_str(F.col(c).cast("string"), 80) for c in cols]))
    return rows.select(TABLE, cells.alias("col_idx", "header"))


def sample_rows(data: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """First ``n`` rows per table that are not blank, cells clipped for display."""
    cols = columns or [c for c in cell_columns(data) if c != "header_row"]
    first = Window.partitionBy(TABLE).orderBy(ROW)
    return (data.filter(~T.is_blank([F.col(c).cast("string") for c in cols]))
            .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
            .select(TABLE, ROW, F.array(*[T.cell_str(F.col(c).cast("string")) for c in cols]).alias("cells")))
