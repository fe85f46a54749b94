"""Bucketed running values and row numbers against plain windows."""
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.operators.ordered import Last, Total, number_rows, running
from sheetloom.sources.grid import to_grid


@pytest.fixture(scope="module")
def rows(spark):
    # one group holds most rows; gaps in the order and nulls in the values
    return spark.range(4000).select(
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("g"), F.col("id") % 5)).otherwise("hot").alias("k"),
        (F.col("id") * 3 - 2000).alias("at"), F.when(F.col("id") % 11 > 6, F.col("id").cast("string")).alias("v"))


@pytest.mark.parametrize("bucket_rows", [1, 17, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_window(rows, bucket_rows, descending):
    out = running(rows, ["k"], "at", {"total": Total(F.col("v").isNotNull().cast("bigint")), "upto": Last(F.col("v")),
                                      "before": Last(F.col("v"), inclusive=False)}, descending, bucket_rows)
    w = W.partitionBy("k").orderBy(F.desc("at") if descending else F.col("at"))
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    check = out.select("*", F.count("v").over(upto).alias("t2"), F.last("v", True).over(upto).alias("u2"),
                       F.last("v", True).over(before).alias("b2"))
    assert check.count() == 4000
    assert check.filter("not (total <=> t2 and upto <=> u2 and before <=> b2)").count() == 0


def test_running_refuses_null_keys(spark):
    df = spark.createDataFrame([(None, 1)], "k string, at bigint")
    with pytest.raises(Exception, match="null in key column"):
        running(df, ["k"], "at", {"n": Total(F.lit(1))}).collect()


def test_number_rows_with_copies_and_null_keys(spark):
    # a third of all rows are copies of one row; a key may be null
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"),
                                  F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("v"))
    out = number_rows(df, ["k"], ["v"])
    w = W.partitionBy("k").orderBy("row_idx")
    seen = out.select("*", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("p"))
    assert seen.count() == 3000
    assert seen.filter("rn <> row_idx or p > v").count() == 0


def test_scan_window_equals_prefix(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("t"), F.pmod(F.hash("id"), F.lit(50)).alias("v"), "id")
    whole = to_grid(df, F.col("t").cast("string"), ["v"]).filter("row_idx <= 30")
    cut = to_grid(df, F.col("t").cast("string"), ["v"], scan_rows=30)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == 60
