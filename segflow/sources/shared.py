"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode only a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="segflow-"))
    return _local[0]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/segflow-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def staged(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """``df`` itself if ``stage`` returned it, else these columns of it (none named: all), staged."""
    if hasattr(df, "staged_at"):
        return df
    return stage(df.select(*columns) if columns else df, label)
