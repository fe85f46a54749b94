"""Cut lineage through a table written to the cluster's shared folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_DIR_CONF = "spark.checkpoint.dir"
#: While a table is written: shuffle files go when that has ended, and what travels to Python at once has a bounded size.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
#: For rows with long expressions: the JVM leaves a method of more bytes uncompiled, so operators then run one by one.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    path = spark.conf.get(_DIR_CONF, None) or spark.sparkContext.getConf().get(_DIR_CONF)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR_CONF} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="sheetloom-")
    spark.conf.set(_DIR_CONF, path)
    return path


def stage(df: DataFrame, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Later reads see the same rows whatever executors are lost in between, prune
    columns and push filters down.  Shuffle files of the write go when it has ended.
    ``settings`` hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheetloom/{uuid.uuid4().hex}"
    during = _WHILE_WRITING | dict(settings or {})
    before = {k: spark.conf.get(k, None) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
