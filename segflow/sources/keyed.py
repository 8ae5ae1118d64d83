"""Files of one document for each key, in hashed folders, written and replaced as a whole.

A table is a folder with a file ``current-N``, of which the greatest N names its runs, oldest
first. A run holds ``FOLDERS`` folders at most; a key's file lies in the folder of its hash.
Tasks write their folders below an attempt of their own, the commit moves these (as many as
there are folders), and the table changes at once when the next ``current-N`` appears. A whole
write leaves one run; an update adds a run, whose documents count instead of older ones of
their keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from segflow.functions import text as T

FOLDERS = 256
CURRENT = "current-"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


@dataclass
class Moved(WriterCommitMessage):
    """Folders that a task wrote below its attempt."""

    attempt: str
    folders: list[str]


def file_name(key: str) -> str:
    """The key, escaped as in a URI; a name does not begin with a dot or underscore, which readers take for hidden."""
    name = quote(key, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") and name else name


class KeyedWriter(DataSourceArrowWriter):
    """Rows (folder, key, chunk), sorted by folder and key, to a file for each key: head, chunks apart by a separator, tail."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.run, self.suffix = options["path"].rstrip("/"), options["run"], options["suffix"]
        self.head, self.between, self.tail = (options[x].encode() for x in ("head", "between", "tail"))
        self.update = options["update"] == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        store, root = _store(self.path)
        context = TaskContext.get()
        attempt = f"{self.run}/.attempt-{context.partitionId()}-{context.taskAttemptId()}"
        folders: list[str] = []
        at, out, begun = None, None, False

        def close() -> None:
            if out:
                out.write(self.tail)
                out.close()

        for batch in iterator:
            for folder, key, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (folder, key) != at:
                    close()
                    if not folders or folders[-1] != folder:
                        folders.append(folder)
                        store.create_dir(f"{root}/{attempt}/{folder}", recursive=True)
                    out = store.open_output_stream(f"{root}/{attempt}/{folder}/{file_name(key)}{self.suffix}")
                    out.write(self.head)
                    at, begun = (folder, key), False
                if chunk is not None:
                    out.write((self.between if begun else b"") + chunk.encode())
                    begun = True
        close()
        return Moved(attempt, folders)

    def commit(self, messages: list[Moved | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.run}", recursive=True)
        for m in messages:
            for folder in m.folders if m else []:
                store.move(f"{root}/{m.attempt}/{folder}", f"{root}/{self.run}/{folder}")
        for x in store.get_file_info(fs.FileSelector(f"{root}/{self.run}")):
            if x.base_name.startswith(".attempt-"):
                store.delete_dir(x.path)
        marks, before = _state(store, root)
        runs = [*before, self.run] if self.update else [self.run]
        with store.open_output_stream(f"{root}/.{self.run}") as out:
            out.write("".join(f"{r}\n" for r in runs).encode())
        number = int(marks[-1].removeprefix(CURRENT)) + 1 if marks else 1
        store.move(f"{root}/.{self.run}", f"{root}/{CURRENT}{number:012d}")
        for mark in marks:
            store.delete_file(f"{root}/{mark}")
        for old in set(before) - set(runs):
            store.delete_dir(f"{root}/{old}")

    def abort(self, messages: list[Moved | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.run}")


class KeyedFiles(DataSource):
    """``format("keyed_files")``: a sink only; ``read_documents`` reads."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(dict(self.options))


def _state(store: fs.FileSystem, root: str) -> tuple[list[str], list[str]]:
    """Names of the files that name runs, and the runs of the newest."""
    marks = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(CURRENT))
    if not marks:
        return [], []
    with store.open_input_stream(f"{root}/{marks[-1]}") as f:
        return marks, f.read().decode().split()


def write_documents(rows: DataFrame, path: str, suffix: str, head: str, between: str, tail: str, order: list[str], folders: int = FOLDERS, update: bool = False) -> None:
    """A file for each video_id of ``rows`` (video_id, chunk and the columns of ``order``), with its chunks in order.

    A row with a null chunk makes a file and adds nothing to it. Rows with a null or
    empty video_id are an error. Chunks are streamed to their file; no document is held as a whole. ``update``
    keeps the documents of other videos, which may be read meanwhile, as they were.
    """
    rows.sparkSession.dataSource.register(KeyedFiles)
    key = F.coalesce(F.nullif(F.col("video_id").cast("string"), F.lit("")), F.raise_error(F.lit("a row without video_id")).cast("string"))
    folder = F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(folders)))), 4, "0")
    dealt = rows.withColumns({"__key": key, "__folder": folder}).repartition("__folder").sortWithinPartitions("__folder", "__key", *order)
    out = dealt.select(F.col("__folder").alias("folder"), F.col("__key").alias("key"), F.col("chunk").cast("string").alias("chunk"))
    options = {"run": f"run-{uuid.uuid4().hex}", "suffix": suffix, "head": head, "between": between, "tail": tail, "update": str(update).lower()}
    out.write.format("keyed_files").mode("append").options(**options).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, doc) of a table that ``write_documents`` wrote, or of any folder of files named by video."""
    jvm = spark.sparkContext._jvm

    def matches(pattern: str) -> list[str]:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        return [x.getPath().toString() for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []]

    marks = matches(f"{path}/{CURRENT}*")
    # names in _metadata are escaped as in a URI, where a plus stands for itself
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = plain(T.stem(F.col("_metadata.file_name")))
    if not marks:
        return spark.read.text(path, wholetext=True).select(name.alias("video_id"), F.col("value").alias("doc"))
    # one run a write since the last whole one; a write of no rows has no folders
    runs = [r.value for r in spark.read.text(max(marks)).collect() if matches(f"{path}/{r.value}/*")]
    if not runs:
        return spark.createDataFrame([], "video_id string, doc string")
    files = spark.read.text([f"{path}/{r}/*" for r in runs], wholetext=True)
    run = F.regexp_extract("_metadata.file_path", r"/(run-[0-9a-f]{32})/[^/]+/[^/]+$", 1)
    docs = files.select(plain(name).alias("video_id"), F.col("value").alias("doc"), F.array_position(F.array(*(F.lit(r) for r in runs)), run).alias("__run"))
    if len(runs) == 1:
        return docs.drop("__run")
    return docs.groupBy("video_id").agg(F.max_by("doc", "__run").alias("doc"))


def compact_documents(spark: SparkSession, path: str, suffix: str, folders: int = FOLDERS) -> None:
    """The newest document of each video in one run, in place of all runs."""
    write_documents(read_documents(spark, path).withColumnRenamed("doc", "chunk"), path, suffix, "", "", "", [], folders)
