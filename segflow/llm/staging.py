"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _local_root
    _local_root = _local_root or tempfile.mkdtemp(prefix="segflow-")
    return _local_root


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. It also gives
    later joins plain scans on both sides, so that adaptive execution may split hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/segflow-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned and that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)


def clear_staged(spark: SparkSession) -> None:
    """Delete every table staged by this application; call it when its results are written."""
    _delete(spark, f"{shared_root(spark)}/segflow-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
