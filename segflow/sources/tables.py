"""Tables bucketed by video and sorted within, for what is read many times.

Windows, folds, groupings and joins by video of such a table need no exchange: the files are
dealt as they would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


def save_by_video(rows: DataFrame, name: str, path: str, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` as the table ``name`` with its files at ``path``: one file a bucket of videos, sorted by video and ``order``."""
    dealt = rows.repartition(buckets, "video_id")
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "video_id").sortBy("video_id", *order).saveAsTable(name)
    return rows.sparkSession.table(name)


def drop(spark: SparkSession, name: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def out_of_order(table: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(file, n): for each file, the rows that do not come after the one before them, by video and ``order``, as they are stored."""
    place = F.struct("video_id", *order)
    stored = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), place.alias("place"), F.monotonically_increasing_id().alias("at"))
    before: Column = F.lag("place").over(Window.partitionBy("file").orderBy("part", "at"))
    return stored.select("file", (before > F.col("place")).alias("late")).groupBy("file").agg(F.count(F.when(F.col("late"), 1)).alias("n"))
