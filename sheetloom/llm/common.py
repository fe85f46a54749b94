"""Helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import stage  # noqa: F401  (tables that cut lineage lie in the shared folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fold(doc_id: str = "doc_id", mod: int = 4) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hand_back() -> None:
    """Give memory that Arrow holds and no longer uses back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()


def handing_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory that is free after one of them goes back before the next is read."""
    for batch in batches:
        yield batch
        del batch
        hand_back()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task holds beside a batch stays small."""
    for batch in handing_back(batches):
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
            hand_back()


def passing(batches: Iterator[pa.RecordBatch], at: int, passes: Callable[[str], bool]) -> Iterator[pa.RecordBatch]:
    """Rows whose text in column ``at`` passes, a slice at a time."""
    for batch in in_slices(batches):
        yield batch.filter(pa.array([passes(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))


def keep_rows(df: DataFrame, decide: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """Rows whose text (a null one as empty) passes, with all their columns; ``decide`` makes the test once a task."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return passing(batches, at, decide())

    return df.mapInArrow(run, df.schema)


def split_hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, spread: list[str]) -> DataFrame:
    """``big`` joined with ``small`` (one row a key), keys that many rows of ``big`` share dealt over several tasks.

    ``weight`` in ``small`` is the number of rows of ``big`` with that key. A key with
    more than a task's share (total / shuffle partitions) gets ceil(weight / share)
    salts; at most as many keys as there are shuffle partitions can be so hot, and only
    they (their keys and salt counts) are broadcast. Rows of ``big`` choose a salt by a
    hash of ``spread``; the key's row of ``small`` is repeated once a salt.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    share = max(1, -(-total // partitions(big)))
    hot = F.broadcast(small.where(F.col(weight) > share).select(*on, F.ceil(F.col(weight) / share).cast("int").alias("_salts")))
    left = (big.join(hot, on, "left")
            .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts"))).cast("int"))
            .drop("_salts"))
    right = (small.join(hot, on, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    return left.join(right, [*on, "_salt"]).drop("_salt")
