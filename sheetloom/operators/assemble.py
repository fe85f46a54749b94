"""Segmented rows to nested documents."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grid import ROW


def assemble_document(df: DataFrame, entry: Sequence[str], levels: Sequence[tuple[str, Sequence[str]]],
                      lists: Mapping[str, Column], order: str = ROW, first: Mapping[str, Column] | None = None) -> DataFrame:
    """One nested row per entry and part.

    ``entry`` names the columns that identify and describe an entry, ``part``
    among them, so that a long entry is built as several bounded documents.
    ``levels`` are (array name, columns) from the outside in, ``lists`` the detail
    arrays of the innermost level.  Groups keep the order of their first row.  ``first``
    adds attributes as structs ``(at, v)``: their first non-null value and its row.
    Rows move once: every later grouping refines the same partitioning.
    """
    entry = list(entry)
    rows = df.repartition(*[F.col(c) for c in entry])
    nested = [c for _, cols in levels for c in cols]
    agg = [F.min(order).alias("_at")]
    for name, value in lists.items():
        held = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v"))))
        agg.append(F.transform(F.array_sort(held), lambda x: x["v"]).alias(name))
    first = first or {}
    for name, value in first.items():
        agg.append(F.min(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v")))).alias(name))
    out = rows.groupBy(*entry, *nested).agg(*agg)
    inside = list(lists)
    for name, cols in reversed(levels):
        nested = nested[:len(nested) - len(cols)]
        member = F.struct("_at", *cols, *inside)
        out = out.groupBy(*entry, *nested).agg(
            F.min("_at").alias("_first"), F.array_sort(F.collect_list(member)).alias(name), *[F.min(n).alias(n) for n in first])
        fields = [*cols, *inside]
        out = out.select(*entry, *nested, *first, F.col("_first").alias("_at"),
                         F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
        inside = [name]
    return out.select(*entry, *first, *inside)
