"""Checkpoints that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where the session names none."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder of checkpoints."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def columnar(df: DataFrame) -> DataFrame:
    """The same as Parquet, for large tables: small, and each reader reads only the columns and pages that it asks for."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
