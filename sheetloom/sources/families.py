"""The family store: two tables of JSON lines, ``families`` and ``members``.

Members are rows of their own, so a family may have any number of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILY_SCHEMA = ("name string, canonical_version bigint, canonical_source string, "
                 "vector array<double>, n_members bigint")
MEMBER_SCHEMA = "name string, job_id string, added string, built_against bigint, vector array<double>"


def write_families(families: DataFrame, members: DataFrame, path: str) -> None:
    """Write a snapshot of the store."""
    families.write.json(f"{path}/families")
    members.write.json(f"{path}/members")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    return lines.filter(F.col("_bad").isNull() & F.col("name").isNotNull()).drop("_bad")


def read_families(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Families by name, and members; unreadable records are skipped."""
    families = _read(spark, f"{path}/families", FAMILY_SCHEMA)
    families = families.withColumn("canonical_version", F.coalesce("canonical_version", F.lit(1).cast("bigint")))
    return families.orderBy("name"), _read(spark, f"{path}/members", MEMBER_SCHEMA)


def read_family_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from one JSON file per family with its members inside."""
    schema = ("name string, canonical_version bigint, canonical_source string, "
              "fingerprint struct<vector:array<double>>, "
              "members array<struct<job_id:string, added:string, built_against:bigint, "
              "fingerprint:struct<vector:array<double>>>>, _bad string")
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True)
           .option("columnNameOfCorruptRecord", "_bad").json(path))
    store = raw.filter(F.col("_bad").isNull() & F.col("name").isNotNull())
    families = store.select("name", F.coalesce("canonical_version", F.lit(1).cast("bigint")).alias("canonical_version"),
                            "canonical_source", F.col("fingerprint.vector").alias("vector"),
                            F.size("members").cast("bigint").alias("n_members"))
    members = store.select("name", F.explode("members").alias("m")).select(
        "name", "m.job_id", "m.added", "m.built_against", F.col("m.fingerprint.vector").alias("vector"))
    return families.orderBy("name"), members
