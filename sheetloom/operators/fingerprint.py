"""Structural fingerprints: header-agnostic features and vectors of tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.grid import TABLE

# Upper bounds of the fill-rate buckets (the last is open), vector size.
FILL_BOUNDS = (0.1, 0.25, 0.5, 0.75)
VECTOR_SIZE = 11
NUMERIC_FEATURES = ("ncol", "rows_per_entry", "num_styles", "enum_cols", "code_cols", "longtext_cols", "gap_density")


def fill_buckets() -> Column:
    """Aggregate: number of columns per fill-rate bucket."""
    low = [None, *FILL_BOUNDS]
    high = [*FILL_BOUNDS, None]
    counts = []
    for a, b in zip(low, high):
        hit = F.lit(True)
        if a is not None:
            hit = hit & (F.col("fill_rate") >= a)
        if b is not None:
            hit = hit & (F.col("fill_rate") < b)
        counts.append(F.count_if(hit))
    return F.array(*counts)


def rows_per_entry(min_fill: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.lit(1.0), min_fill), 1), F.lit(0.0))


def _distinct(cap: int) -> Column:
    return F.least("distinct_n", F.lit(cap).cast("bigint"))


def is_enum_column(cap: int = 200) -> Column:
    return (F.col("inferred_type") == "str") & _distinct(cap).between(2, 15) & (F.col("fill_rate") > 0.1)


def is_code_column(cap: int = 200) -> Column:
    return (F.col("inferred_type") == "int") & (_distinct(cap) > 20)


def has_style(pattern: str) -> Column:
    """A listed top value of a text column carries the numbering style."""
    hit = F.exists(F.col("top_values"), lambda x: x["value"].rlike(pattern))
    return F.coalesce((F.col("inferred_type") == "str") & hit, F.lit(False))


def gap_density(gaps: Column, max_row: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(gaps, max_row), 3), F.lit(0.0))


def features(profile: DataFrame, dims: DataFrame, gaps: DataFrame | None = None,
             merged: DataFrame | None = None) -> DataFrame:
    """Thirteen features per table in one aggregation over the column profiles.

    ``dims`` has ``(table_id, max_row)``, ``gaps`` ``(table_id, gaps)`` and
    ``merged`` ``(table_id, merged)``; absent rows count as zero.  Columns behind a table's
    last one with a cell or a header belong to wider tables of the grid and do not count.
    """
    used = F.max(F.when((F.col("nonempty") > 0) | (F.col("header") != ""), F.col("col_idx"))).over(Window.partitionBy(TABLE))
    profile = profile.withColumn("_last", used).filter(F.col("col_idx") <= F.col("_last")).drop("_last")
    styles = {f"_s{i}": has_style(p) for i, (_, p) in enumerate(T.NUMBERING_STYLES)}
    flagged = profile.select("*", *[c.alias(n) for n, c in styles.items()])
    any_style = F.greatest(*[F.col(n) for n in styles])
    agg = flagged.groupBy(TABLE).agg(
        F.count(F.lit(1)).alias("ncol"), F.min("fill_rate").alias("min_fill"),
        F.count_if(any_style).alias("numbering_cols"), F.count_if(is_enum_column()).alias("enum_cols"),
        F.count_if(is_code_column()).alias("code_cols"), F.count_if(F.col("max_len") > 100).alias("longtext_cols"),
        fill_buckets().alias("fill_buckets"),
        # one element per column, and a grid has at most max_cols of them
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", T.norm_header(F.col("header")).alias("h")))),
                    lambda x: x["h"]).alias("headers"),
        *[F.bool_or(n).cast("bigint").alias(n) for n in styles])
    zero = F.lit(0).cast("bigint")
    out = agg.join(dims.select(TABLE, "max_row"), TABLE, "left")
    out = out.join(gaps.select(TABLE, "gaps"), TABLE, "left") if gaps is not None else out.withColumn("gaps", zero)
    out = out.join(merged.select(TABLE, "merged"), TABLE, "left") if merged is not None else out.withColumn("merged", zero)
    return out.select(
        TABLE, "ncol", "max_row", "min_fill", rows_per_entry(F.col("min_fill")).alias("rows_per_entry"),
        sum((F.col(n) for n in styles), zero).alias("num_styles"), "numbering_cols", "enum_cols", "code_cols",
        "longtext_cols", F.coalesce("merged", zero).alias("merged"),
        gap_density(F.coalesce("gaps", zero), F.col("max_row")).alias("gap_density"), "fill_buckets", "headers")


def vector() -> Column:
    """Eleven numbers between 0 and 1 from a feature row."""
    total = F.greatest(F.aggregate("fill_buckets", F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    shares = [F.get("fill_buckets", F.lit(i)) / total for i in range(len(FILL_BOUNDS) + 1)]

    def share(name: str, most: int) -> Column:
        return F.least(F.col(name), F.lit(most)) / F.lit(most)

    denormalized = F.least(F.col("rows_per_entry") / 4, F.lit(1.0))
    return F.array(*shares, share("num_styles", 4), share("enum_cols", 4), share("code_cols", 3),
                   share("longtext_cols", 5), denormalized, F.least(F.col("gap_density") * 10, F.lit(1.0)))


def fingerprint(feature_rows: DataFrame) -> DataFrame:
    return feature_rows.withColumn("vector", vector())


def feature_delta(table: DataFrame, canonical: DataFrame, on: str = TABLE) -> DataFrame:
    """Numeric features of a table against those of its canonical member, long form."""
    def long(df: DataFrame, name: str) -> DataFrame:
        wide = df.select(on, *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES])
        return wide.unpivot([on], list(NUMERIC_FEATURES), "feature", name)
    both = long(table, "table_value").join(long(canonical, "canonical_value"), [on, "feature"], "left")
    gap = F.coalesce("table_value", F.lit(0.0)) - F.coalesce("canonical_value", F.lit(0.0))
    return both.withColumn("delta", F.round(gap, 2))
