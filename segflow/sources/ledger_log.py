"""The ledger as a log: numbered parts of documents, and a snapshot of what older parts came to.

Parts lie in ``parts/N``, snapshots in ``snapshots/N``; a snapshot N holds the newest document of
each video of all parts up to N, in BUCKETS files by hash of the video. Readers take the newest
snapshot and the parts after it, so what they read is bounded by the number of videos and
COMPACT_AFTER parts, whatever the number of writes. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.operators import ledger

#: Files of a snapshot; parts after the snapshot beyond which the next one is made.
BUCKETS, COMPACT_AFTER = 64, 16


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders below ``path``; a part counts once Spark has marked it as whole."""
    p, store = _files(spark, f"{path}/*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName()) for x in store.globStatus(p) or [])


def write_part(documents: DataFrame, path: str, number: int | None = None) -> None:
    """Adds documents as the part of that number, in place of an earlier one of it; by default as the next."""
    if number is None:
        spark = documents.sparkSession
        number = max([0, *_numbers(spark, f"{path}/parts"), *_numbers(spark, f"{path}/snapshots")]) + 1
    documents.select(*_COLUMNS).write.mode("overwrite").parquet(f"{path}/parts/{number}")


_COLUMNS = ["video_id", "version", "video", "steps", "artifacts", "updated_at"]


def _tables(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest snapshot (0: none) and the parts after it."""
    base = max([0, *_numbers(spark, f"{path}/snapshots")])
    return base, [n for n in _numbers(spark, f"{path}/parts") if n > base]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest document of each video (of equal updated_at, that of the later part); none if there is no ledger yet."""
    base, parts = _tables(spark, path)
    return _merged(spark, path, base, parts)


def _merged(spark: SparkSession, path: str, base: int, parts: list[int]) -> DataFrame:
    tables = [f"{path}/snapshots/{base}"] * bool(base) + [f"{path}/parts/{n}" for n in parts]
    if not tables:
        return spark.createDataFrame([], ledger.SCHEMA)
    rows = spark.read.schema(ledger.SCHEMA).parquet(*tables).filter("video_id is not null")
    number = F.regexp_extract("_metadata.file_path", r"/(\d+)/[^/]*$", 1).cast("bigint")
    x = F.max_by(F.struct(*_COLUMNS[1:]), F.struct("updated_at", number))
    return rows.groupBy("video_id").agg(x.alias("x")).select("video_id", "x.*")


def compact(spark: SparkSession, path: str, after: int = 0, buckets: int = BUCKETS) -> None:
    """A new snapshot if more than ``after`` parts follow the last one; it appears whole, and then what it holds is deleted."""
    base, parts = _tables(spark, path)
    if len(parts) <= after:
        return
    made, last = f"{path}/.made-{uuid.uuid4().hex}", parts[-1]
    _merged(spark, path, base, parts).repartition(buckets, "video_id").sortWithinPartitions("video_id").write.parquet(made)
    source, store = _files(spark, made)
    target, _ = _files(spark, f"{path}/snapshots/{last}")
    store.mkdirs(target.getParent())
    if not store.rename(source, target):
        raise OSError(f"{made} could not become {path}/snapshots/{last}")
    for old in [f"{path}/parts/{n}" for n in parts] + [f"{path}/snapshots/{base}"] * bool(base):
        store.delete(_files(spark, old)[0], True)
