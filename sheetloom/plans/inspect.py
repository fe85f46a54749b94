"""Inspect many sheets: header, profile, gaps, samples, fingerprint, family match."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import families as FM
from ..operators import fingerprint as FP
from ..operators import header as H
from ..operators import profile as P
from ..sources.grid import TABLE, to_cells


@dataclass(frozen=True)
class Inspection:
    """Lazy parts of a sheet report; each is one row (or a few) per table."""
    dims: DataFrame
    header: DataFrame
    columns: DataFrame
    gaps: DataFrame
    merged: DataFrame
    samples: DataFrame

    def fingerprints(self) -> DataFrame:
        return FP.fingerprint(FP.features(self.columns, self.dims, self.gaps, self.merged))

    def report(self) -> DataFrame:
        """One nested row per table."""
        columns = self.columns.groupBy(TABLE).agg(F.array_sort(F.collect_list(F.struct(
            "col_idx", *[c for c in self.columns.columns if c not in (TABLE, "col_idx", "type_mix")]))).alias("columns"))
        samples = self.samples.groupBy(TABLE).agg(
            F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("sample_rows"))
        out = self.dims.join(self.header.select(TABLE, "header_row"), TABLE, "left")
        for part in (columns, self.gaps, self.merged, samples):
            out = out.join(part, TABLE, "left")
        return out


def inspect(grid: DataFrame, header: int | DataFrame | None = None, max_cols: int = 60,
            scan_rows: int = 5000, samples: int = 10, top: int = 8) -> Inspection:
    """Report on every table of ``grid``.

    All rows are profiled; ``scan_rows`` only marks tables a bounded scan would
    have cut (``to_grid(scan_rows=...)`` takes that cut).
    """
    names = [c for c in grid.columns if c not in (TABLE, "row_idx")]
    found = H.detect_header(grid) if header is None or isinstance(header, int) else header
    if isinstance(header, int):
        found = found.withColumn("header_row", F.lit(header).cast("bigint"))
    data = H.split_header(grid, found).drop("header_row")
    titles = H.header_cells(grid, found).withColumnRenamed("header", "title")
    columns = P.profile(to_cells(data, infer=True), k=top).join(titles, [TABLE, "col_idx"], "left")
    columns = columns.withColumn("header", F.coalesce("title", F.lit(""))).drop("title")
    merged = P.null_runs(data).groupBy(TABLE).agg(F.count(F.lit(1)).alias("merged"))
    return Inspection(P.dims(grid, max_cols, scan_rows), found, columns, P.blank_gaps(data), merged,
                      H.sample_rows(data, samples, names))


def match_tables(grid: DataFrame, families: DataFrame, header: int | DataFrame | None = None) -> DataFrame:
    """Inspect, fingerprint and match every table in one lazy plan."""
    return FM.match(inspect(grid, header).fingerprints(), families)
