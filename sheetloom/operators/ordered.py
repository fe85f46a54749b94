"""Ordered computations that do not put a whole table into one task.

A plain window over ``partitionBy(table_id)`` sorts a table in one task, and one
table may hold a third of all rows.  Both primitives here cut a table into
buckets of bounded size and carry a one-row summary of every bucket forward.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

BUCKET_ROWS = 100_000
BROADCAST_PIECES = 100_000   # (partition, group) counts that may reach every task
_POSITION_BITS = 33   # monotonically_increasing_id keeps the partition above bit 33


@dataclass(frozen=True)
class Last:
    """Last non-null value of ``value`` up to this row (or before it)."""
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Total:
    """Sum of ``value`` up to and including this row."""
    value: Column


def bucket_of(order: str | Column, bucket_rows: int = BUCKET_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", order.cast("bigint"), F.lit(bucket_rows).cast("bigint"))


def running(df: DataFrame, keys: Sequence[str], order: str,
            specs: Mapping[str, Last | Total], descending: bool = False,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add running values per ``keys`` in the order of a unique integer column.

    ``order`` is unique within ``keys``, so a bucket holds at most
    ``bucket_rows`` rows whatever the size of the group.  Rows are shuffled once,
    by (keys, bucket), without the values of ``specs``, which are computed where the
    rows arrive; the summaries are pre-aggregated before their shuffle and
    joined back on the same (keys, bucket), which moves no row again.  A null key
    is an error.
    """
    keys = list(keys)
    at = -F.col(order) if descending else F.col(order)
    bucket = bucket_of(at, bucket_rows)
    for k in keys:
        bucket = F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key column {k}"))).otherwise(bucket)
    bucketed = df.withColumn("_bucket", bucket)
    inputs = [at.alias("_at"), *[spec.value.alias(f"_in_{name}") for name, spec in specs.items()]]

    summary = bucketed.select("*", *inputs).groupBy(*keys, "_bucket").agg(*[
        F.sum(f"_in_{n}").alias(f"_sum_{n}") if isinstance(s, Total)
        else F.max_by(F.struct(F.col(f"_in_{n}").alias("v")),
                      F.when(F.col(f"_in_{n}").isNotNull(), F.col("_at"))).alias(f"_sum_{n}")
        for n, s in specs.items()])
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*keys, "_bucket", *[
        F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") if isinstance(s, Total)
        else F.last(f"_sum_{n}.v", ignorenulls=True).over(before).alias(f"_carry_{n}")
        for n, s in specs.items()])

    within = Window.partitionBy(*keys, "_bucket").orderBy("_at")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    preceding = within.rowsBetween(Window.unboundedPreceding, -1)
    moved = bucketed.repartition(*[F.col(k) for k in keys], F.col("_bucket"))
    local = moved.select("*", *inputs).select(*df.columns, "_bucket", *[
        F.sum(f"_in_{n}").over(upto).alias(f"_local_{n}") if isinstance(s, Total)
        else F.last(f"_in_{n}", ignorenulls=True)
              .over(upto if s.inclusive else preceding).alias(f"_local_{n}")
        for n, s in specs.items()])
    return local.join(carry, [*keys, "_bucket"], "left").select(*df.columns, *[
        (F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n)
        if isinstance(s, Total)
        else F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n)
        for n, s in specs.items()])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                name: str = "row_idx") -> DataFrame:
    """Number the rows of every group from 1 in the given order.

    Rows are range-partitioned on (keys, order), so a large group spreads over as
    many tasks as it needs; positions inside a partition become positions in the
    group by adding the row counts of the group's earlier partitions, of which
    there is one small row per (partition, group).  Remaining columns break ties,
    so equal inputs get equal numbers; full copies are interchangeable.
    """
    keys = list(keys)
    wanted = [F.col(c) if isinstance(c, str) else c for c in order]
    sortable = [f.name for f in df.schema.fields
                if f.dataType.typeName() not in ("map", "variant")]
    sort_cols = [*[F.col(k) for k in keys], *wanted,
                 *[F.col(c) for c in sortable if c not in keys]]
    spread = df.withColumn("_copy", F.monotonically_increasing_id())
    numbered = (spread.repartitionByRange(*sort_cols, F.col("_copy"))
                .sortWithinPartitions(*sort_cols, "_copy").drop("_copy")
                .withColumn("_mid", F.monotonically_increasing_id()))
    rows = stage(numbered).withColumn("_part", F.shiftright("_mid", _POSITION_BITS))
    pieces = stage(rows.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"),
                                                    F.count(F.lit(1)).alias("_n")))
    earlier = (Window.partitionBy(*keys).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(*keys, "_part", (
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    if pieces.count() <= BROADCAST_PIECES:
        # few offsets go to the rows, which then do not move again
        offsets = F.broadcast(offsets)
    same = F.col("r._part") == F.col("o._part")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    return (rows.alias("r").join(offsets.alias("o"), same)
            .select(*[F.col(f"r.{c}") for c in df.columns],
                    (F.col("r._mid") + F.col("o._shift")).alias(name)))
