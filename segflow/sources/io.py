"""Readers and writers of transcripts, turns, clip metadata and media listings.

Readers take explicit schemas, coerce types and skip rows that are not objects. JSON
documents are one file for each video, in folders of any kind or as ``keyed`` writes them; a
name without suffix is the video_id. Numbers may be quoted. A document that cannot be read
gives no rows but an error, (video_id, error), by the ``_errors`` function of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.functions import text as T
from segflow.sources import keyed, ledger_log

_WHISPER = "result struct<language: string>, transcription array<struct<offsets: struct<`from`: string, `to`: string>, text: string>>, _corrupt_record string"
# Numbers are read as text: they may be quoted, or whole ones written as 3.0.
_SEGMENT = "idx string, start string, end string, text_src string, text_tgt string, text_en string, text_ja string, speaker_id string, detected_lang string"
_META = "segno string, flac_path string, duration_sec string"
TURNS = "video_id string, start double, end double, speaker string, turn_no int"


def scan_media(spark: SparkSession, path: str, suffixes: tuple[str, ...] = params.MEDIA_SUFFIXES) -> DataFrame:
    """(video_id, path, size, mtime) of media files below a folder, sorted by path; a missing folder has none. Contents are not read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(conf).exists(folder):
        return spark.createDataFrame([], "video_id string, path string, size bigint, mtime timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    return files.filter(suffix.isin(*suffixes)).select(T.stem(F.col("path")).alias("video_id"), "path", "size", "mtime").orderBy("path")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _whole(c: Column, kind: str) -> Column:
    """A whole number, cut off towards zero."""
    return _number(c).try_cast(kind)


def _malformed(doc: Column, root: str) -> Column:
    """Why a text is no JSON document with that root ('{' or '['); null: it is one."""
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), doc, F.lit("]"))) == 1, F.lit(False))
    kind = {"{": "not an object", "[": "not a list"}[root]
    start = F.regexp_extract(doc, r"^\s*(.)", 1)
    return F.when(F.coalesce(doc, F.lit("")).rlike(r"\A\s*\z"), F.lit("empty file")).when(~one, F.lit("not JSON")).when(start != root, F.lit(kind))


def _whisper_parsed(docs: DataFrame) -> DataFrame:
    """docs with ``d``, the parsed document, and ``error`` (null: none)."""
    parsed = docs.select("video_id", "doc", F.from_json("doc", _WHISPER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    entries = F.col("d.transcription")
    bad = lambda k: lambda x: x["offsets"][k].isNotNull() & _number(x["offsets"][k]).isNull()
    error = F.coalesce(_malformed(F.col("doc"), "{"), F.when(F.col("d._corrupt_record").isNotNull(), F.lit("unexpected types")))
    inner = F.when(F.exists(entries, lambda x: x.isNull()), F.lit("an entry that is no object")).when(F.exists(entries, bad("from")) | F.exists(entries, bad("to")), F.lit("an offset that is no number"))
    return parsed.select("video_id", "d", F.coalesce(error, inner).alias("error"))


def _whisper_rows(docs: DataFrame) -> DataFrame:
    """(video_id, pos, start, end, text_src, detected_lang): what is kept of documents without error."""
    d = _whisper_parsed(docs).filter("error is null")
    lang = F.when(T.text_or_empty(F.col("d.result.language")) != "", T.lang_name_to_code(F.col("d.result.language"))).otherwise(F.lit(""))
    rows = d.select("video_id", lang.alias("detected_lang"), F.posexplode("d.transcription").alias("pos", "x"))
    at = lambda k: F.coalesce(_whole(F.col("x.offsets")[k], "long"), F.lit(0)) / 1000.0
    return rows.select("video_id", "pos", at("from").alias("start"), at("to").alias("end"), T.strip(F.col("x.text")).alias("text_src"), "detected_lang").filter("text_src <> '' and end > start")


def whisper_segments(docs: DataFrame) -> DataFrame:
    """Segments from (video_id, doc): recogniser output as JSON text. Milliseconds become seconds; blank texts and empty intervals go; idx counts what is kept."""
    idx = (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("int")
    return _whisper_rows(docs).select("video_id", idx.alias("idx"), "start", "end", "text_src", F.lit("").alias("text_tgt"), F.lit("").alias("speaker_id"), "detected_lang")


def whisper_errors(docs: DataFrame) -> DataFrame:
    """(video_id, error) of the recogniser documents that are malformed, or of which no segment is kept."""
    d = _whisper_parsed(docs)
    at = lambda x, k: F.coalesce(_whole(x["offsets"][k], "long"), F.lit(0))
    kept = F.exists("d.transcription", lambda x: (T.strip(x["text"]) != "") & (at(x, "to") > at(x, "from")))
    error = F.coalesce("error", F.when(~F.coalesce(kept, F.lit(False)), F.lit("no segments")))
    return d.select("video_id", error.alias("error")).filter("error is not null")


def read_whisper_json(spark: SparkSession, path: str) -> DataFrame:
    return whisper_segments(keyed.read_documents(spark, path))


def read_diarized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, turns) from (video_id, pos, text, speaker_id, start, end): blanks, remarks, rows without speaker and empty intervals go."""
    text = T.strip(F.col("text"))
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kept = rows.select("video_id", "pos", text.alias("text_src"), T.speaker_label(F.col("speaker_id")).alias("speaker"), F.col("speaker_id").isNotNull().alias("spoken"), at("start").alias("start"), at("end").alias("end"))
    kept = kept.filter((F.col("text_src") != "") & ~T.is_non_speech(F.col("text_src")) & F.col("spoken") & (F.col("end") > F.col("start")))
    kept = kept.withColumn("idx", (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("int"))
    segments = kept.select("video_id", "idx", "start", "end", "text_src", F.lit("").alias("text_tgt"), F.col("speaker").alias("speaker_id"), F.lit("").alias("detected_lang"))
    return segments, kept.select("video_id", F.col("idx").alias("turn_no"), "start", "end", "speaker")


def document_errors(docs: DataFrame) -> DataFrame:
    """(video_id, error) of the documents that are no array of JSON, as stored segments and clip metadata are: they give no rows, and fail their own video only."""
    return docs.select("video_id", _malformed(F.col("doc"), "[").alias("error")).filter("error is not null")


def _listed(doc: Column) -> Column:
    """The items of a JSON array, as text; null if the document is none."""
    return F.when(_malformed(doc, "[").isNull(), F.from_json(doc, "array<string>"))


def _items(docs: DataFrame) -> DataFrame:
    """(video_id, pos, item): the objects of each document's array, as JSON text."""
    return docs.select("video_id", F.posexplode(_listed(F.col("doc"))).alias("pos", "item")).filter(F.ltrim("item").startswith("{"))


def stored_segments(docs: DataFrame) -> DataFrame:
    """Segments from (video_id, doc): stored arrays, also with the older text columns; blank counts as missing."""
    r = _items(docs).select("video_id", "pos", F.from_json("item", _SEGMENT).alias("x"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names), F.lit(""))
    return r.select(
        "video_id",
        F.coalesce(_whole(F.col("x.idx"), "int"), "pos").alias("idx"),
        F.coalesce(_number(F.col("x.start")), F.lit(0.0)).alias("start"),
        F.coalesce(_number(F.col("x.end")), F.lit(0.0)).alias("end"),
        first("text_src", "text_en").alias("text_src"),
        first("text_tgt", "text_ja").alias("text_tgt"),
        first("speaker_id").alias("speaker_id"),
        first("detected_lang").alias("detected_lang"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return stored_segments(keyed.read_documents(spark, path))


def write_segments(segments: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), folders: int = keyed.FOLDERS, update: bool = False) -> None:
    """All seven fields by video; the commit never shows half a table.

    ``fmt`` "json": a document for each video in hashed folders, which read_segments reads;
    with ``update``, documents of other videos stay. Else a table in that format.
    """
    fields = ["idx", "start", "end", "text_src", "text_tgt", "speaker_id", "detected_lang"]
    out = segments.select("video_id", *fields)
    if fmt == "json":
        item = F.to_json(F.struct(*fields))
        keyed.write_documents(out.select("video_id", "idx", "start", "end", item.alias("chunk")), path, ".json", "[\n", ",\n", "\n]\n", ["idx", "start", "end"], folders, update)
        return
    out.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def srt_cues(segments: DataFrame) -> DataFrame:
    """(video_id, cue_no, cue): blank texts go; numbers count from 1; an end before its start becomes the start."""
    s = segments.select("video_id", "idx", "start", F.greatest("start", "end").alias("stop"), T.normalize_spaces(F.col("text_src")).alias("said")).filter("said <> ''")
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("idx", "start", "stop", "said"))
    cue = F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat(T.srt_timestamp(F.col("start")), F.lit(" --> "), T.srt_timestamp(F.col("stop"))), "said")
    return s.withColumn("cue_no", no).select("video_id", "cue_no", cue.alias("cue"))


def to_srt(segments: DataFrame) -> DataFrame:
    """(video_id, srt_text): cues apart by a blank line, with one line feed at the end. Videos without cues have '\\n'."""
    texts = srt_cues(segments).groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue_no", "cue"))), lambda x: x["cue"]), "\n\n").alias("t"))
    return segments.select("video_id").distinct().join(texts, "video_id", "left").select("video_id", F.concat(F.coalesce("t", F.lit("")), F.lit("\n")).alias("srt_text"))


def write_srt(segments: DataFrame, path: str, folders: int = keyed.FOLDERS, update: bool = False) -> None:
    """A subtitle file for each video in hashed folders; its text is that of to_srt, but streamed cue by cue."""
    videos = segments.select("video_id").distinct().select("video_id", F.lit(0).alias("cue_no"), F.lit(None).cast("string").alias("chunk"))
    cues = srt_cues(segments).withColumnRenamed("cue", "chunk")
    keyed.write_documents(videos.unionByName(cues), path, ".srt", "", "\n\n", "\n", ["cue_no"], folders, update)


def valid_tts_meta(rows: DataFrame) -> DataFrame:
    """(video_id, segno, flac_path, duration_sec) from rows with pos: invalid ones go; of one segno the last counts."""
    good = rows.filter((F.col("segno") > 0) & (T.text_or_empty(F.col("flac_path")) != "") & (F.col("duration_sec") > 0))
    last = good.groupBy("video_id", "segno").agg(F.max_by(F.struct("flac_path", "duration_sec"), "pos").alias("x"))
    return last.select("video_id", "segno", "x.flac_path", "x.duration_sec")


def read_tts_meta(spark: SparkSession, path: str) -> DataFrame:
    rows = _items(keyed.read_documents(spark, path)).select("video_id", "pos", F.from_json("item", _META).alias("x"))
    return valid_tts_meta(rows.select("video_id", "pos", _whole(F.col("x.segno"), "int").alias("segno"), "x.flac_path", _number(F.col("x.duration_sec")).alias("duration_sec")))


def write_tts_meta(meta: DataFrame, path: str, folders: int = keyed.FOLDERS, update: bool = False) -> None:
    """A document for each video, by segno, in hashed folders; read_tts_meta reads it."""
    item = F.to_json(F.struct("segno", "flac_path", "duration_sec"))
    keyed.write_documents(meta.select("video_id", "segno", item.alias("chunk")), path, ".json", "[\n", ",\n", "\n]\n", ["segno"], folders, update)


def upsert_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of one key the new row counts."""
    columns = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__rank", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("__rank", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__rank").alias("x")).select(*keys, "x.*")


def upsert_ref_meta(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Reference metadata (video_id, key, prompt_text, ref_start, ref_end), updated key by key."""
    return upsert_by_key(existing, new, ["video_id", "key"])


def segment_keys(meta: DataFrame) -> DataFrame:
    """Metadata with key as segno; keys that are not whole numbers go."""
    return meta.withColumn("segno", F.col("key").try_cast("int")).filter("segno is not null").drop("key")


def read_turns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Turns with turn_no, their place in emission order."""
    return spark.read.schema(TURNS).format(fmt).load(path)


def turn_counts(turns: DataFrame) -> DataFrame:
    """(video_id, n_turns, n_speakers)."""
    return turns.groupBy("video_id").agg(F.count("*").cast("long").alias("n_turns"), F.count_distinct("speaker").cast("long").alias("n_speakers"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest document of each video."""
    return ledger_log.read(spark, path)


def write_ledger(documents: DataFrame, path: str) -> None:
    """Adds documents; the newest of each video counts when read. Now and then ``ledger_log.compact`` makes few files of many."""
    ledger_log.write_part(documents, path)
    ledger_log.compact(documents.sparkSession, path, ledger_log.COMPACT_AFTER)
