"""Cutting the lineage of iterative jobs on reliable storage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may go without: there one machine runs everything, and a
    temporary folder will do. On a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Fresh folder on the shared storage, for tables and stream checkpoints."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` on the shared storage and forget its history.

    A table is written and read back. checkpoint() would keep the size estimate of
    the plan it replaces, and loops multiply such estimates with every join, until
    planning itself never ends.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
