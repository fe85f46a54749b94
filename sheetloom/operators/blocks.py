"""Score every row of a large table against every row of a small one.

The small side is packed into arrays of bounded size and each large row folds
over an array in place, so no pair is ever a row.  Large rows meet a block in an
equi-join on its number.  Up to ``BROADCAST_ROWS`` small rows (counted first) the
blocks are broadcast; beyond that they are shuffled, once per slice of the large
side, so that no block gathers all large rows in one task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 256
BROADCAST_ROWS = 20_000
SLICES = 512


def fold_blocks(large: DataFrame, small: DataFrame, key: Sequence[str], payload: Column,
                fold: Callable[[Column], Column], name: str, block_rows: int = BLOCK_ROWS,
                broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Add ``name = fold(block)`` for every (large row, block); returns the block count.

    ``payload`` is a struct; a block is an array of payloads sorted by their first
    field.  ``key`` identifies a large row.
    """
    n = small.count()
    if n == 0:
        return large.withColumn(name, F.lit(None)), 0
    n_blocks = -(-n // block_rows)
    packed = small.select(payload.alias("_p"))
    # computed even for one block: a constant would turn the join into a cross join
    block = F.pmod(F.xxhash64("_p"), F.lit(n_blocks).cast("bigint"))
    packed = packed.groupBy(block.alias("_block")).agg(F.array_sort(F.collect_list("_p")).alias("_items"))
    spread = large.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    if n <= broadcast_rows:
        joined = spread.join(F.broadcast(packed), "_block")
    else:
        slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint")))
        joined = (spread.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(SLICES).cast("bigint")))
                  .join(packed.withColumn("_slice", slices), ["_block", "_slice"]).drop("_slice"))
    return joined.withColumn(name, fold(F.col("_items"))).drop("_items", "_block"), n_blocks
