"""Incremental runs: new or changed inputs once, finished work skipped.

What is known of each video (its size and time) is keyed state of the stream, in a RocksDB store
whose changes are logged; a batch looks up the videos that came, not the ledger. The ledger is
what a run leaves for others to read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from segflow.operators import ledger
from segflow.sources import ledger_log

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SEEN = "video_id string, path string, size bigint, mtime timestamp, file string"


class ChangedVideos(StatefulProcessor):
    """Rows of videos whose size or time is not the one that the state has; it then has the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("signature", "size bigint, mtime timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.known.get()) if self.known.exists() else None
        newest = None
        for row in rows:
            now = (row.size, row.mtime)
            if known is None or now != known:
                newest = now if newest is None else max(newest, now, key=_age)
                yield row
        if newest is not None:
            self.known.update(newest)

    def close(self) -> None:
        pass


def _age(signature: tuple) -> tuple:
    size, mtime = signature
    return (mtime is not None, mtime, size is not None, size)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A video's rows in a file are many and alike: one of each kind for each Arrow batch goes on."""
    for batch in batches:
        names = batch.schema.names
        yield from pa.Table.from_batches([batch]).group_by(names).aggregate([]).select(names).to_batches()


def run_available(spark: SparkSession, inbox: str, schema: str, out: str, ledger_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], fmt: str = "parquet", compact_after: int = ledger_log.COMPACT_AFTER) -> None:
    """Processes the files that came to ``inbox`` since the last run, then stops.

    ``schema`` has video_id, path, size and mtime among its columns; a video's rows repeat them.
    ``process`` turns the rows of new or changed videos into results with video_id. If rows of
    a batch differ in a video's size or mtime, those of the newest count. A batch writes its
    results, and then the documents of its videos as a part of the ledger, each to a place of
    its own; a batch that is repeated after a crash finds the state as it was before it, and
    replaces both. read_results reads them. The ledger's updated_at counts batches, as
    milliseconds. Rows with a null video_id are left out.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(schema).format(fmt).load(inbox)
        seen = rows.select(F.col("video_id").cast("string").alias("video_id"), F.col("path").cast("string").alias("path"), F.col("size").cast("bigint").alias("size"), F.col("mtime").cast("timestamp").alias("mtime"), F.col("_metadata.file_path").alias("file"))
        seen = seen.filter("video_id is not null").mapInArrow(_distinct, _SEEN)
        todo = seen.groupBy("video_id").transformWithState(statefulProcessor=ChangedVideos(), outputStructType=_SEEN, outputMode="Append", timeMode="None")

        def batch(found: DataFrame, batch_id: int) -> None:
            _process(found, batch_id, schema, fmt, out, ledger_path, process)

        todo.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ledger_log.compact(spark, ledger_path, compact_after)


def _process(found: DataFrame, batch_id: int, schema: str, fmt: str, out: str, ledger_path: str, process: Callable[[DataFrame], DataFrame]) -> None:
    session = found.sparkSession
    found = found.persist()
    try:
        # files of one batch, as the stream's own log has them; _metadata writes paths as URIs
        files = [unquote(r.file) for r in found.select("file").distinct().collect()]
        newest = found.groupBy("video_id").agg(F.max_by(F.struct("path", "size", "mtime"), F.struct("mtime", "size")).alias("x")).select("video_id", "x.*")
        rows = session.read.schema(schema).format(fmt).load(files) if files else session.createDataFrame([], schema)
        n = newest.select(F.col("video_id").alias("__video"), F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
        own = (F.col("video_id").cast("string") == F.col("__video")) & F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime"))
        process(rows.join(n, own, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        ledger_log.write_part(ledger.finished(newest, "asr_done", F.timestamp_millis(F.lit(batch_id + 1))), ledger_path, batch_id + 1)
    finally:
        found.unpersist()


def read_results(spark: SparkSession, out: str, schema: str, ledger_path: str) -> DataFrame:
    """The results (``schema``, with video_id) of the batch that processed each video last, as the ledger has it."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    newest = ledger_log.read(spark, ledger_path).select("video_id", (F.unix_millis("updated_at") - 1).alias("batch"))
    return rows.join(newest, ["video_id", "batch"], "left_semi").drop("batch")
