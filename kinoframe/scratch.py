"""The folder that all executors share, and what is cut there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset the warehouse serves, if it is no machine's own disk or the session is a
    single machine."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and re.match(r"(file:)?/", warehouse):
        raise ValueError(f"executors do not share {warehouse}: set spark.checkpoint.dir to a folder that they share")
    return f"{warehouse}/_shared"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in it, which goes when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{where}/data"


def cut(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage ends in files that survive the loss of executors."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()
