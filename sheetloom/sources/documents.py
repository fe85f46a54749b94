"""JSON documents in and out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: ``(doc_id, text)`` with the file path as id."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def parse_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``doc`` as VARIANT; unreadable text gives a null document."""
    return df.withColumn("doc", F.try_parse_json(F.col(text)))


def to_text(doc: Column) -> Column:
    """JSON text of a struct or VARIANT; non-ASCII stays as it is, null fields are written as null."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def write_documents(df: DataFrame, path: str, doc: str = "doc", mode: str = "errorifexists") -> None:
    """Write one JSON document per line as UTF-8."""
    df.select(to_text(F.col(doc)).alias("value")).write.mode(mode).text(path)
