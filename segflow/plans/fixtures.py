"""Transcript tables derived from general ones, so that work grows with the given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.operators.shape import with_segno

WORDS = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fragments(text: Column) -> Column:
    """Runs of six words, joined by one space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0b]+"), lambda x: x != "")
    cut = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / WORDS).cast("int")), lambda i: F.array_join(F.slice(w, i * WORDS + 1, WORDS), " "))))
    return cut[0]


def _timed(rows: DataFrame) -> DataFrame:
    """rows: video_id, idx, speaker_id, text_src -> segments."""
    dur = 200 + 60 * F.length("text_src")
    gap = F.pmod(F.col("video_id") * 31 + F.col("idx") * 17, F.lit(1500))
    total = F.sum(dur + gap).over(Window.partitionBy("video_id").orderBy("idx"))
    t = rows.withColumn("dur", dur).withColumn("total", total)
    return t.select("video_id", F.col("idx").cast("int").alias("idx"), ((F.col("total") - F.col("dur")) / 1000.0).alias("start"), (F.col("total") / 1000.0).alias("end"), "text_src", F.lit("").alias("text_tgt"), "speaker_id", F.lit("").alias("detected_lang"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns of conversations cut into recogniser-like fragments."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", "role", F.posexplode(_fragments(F.col("text"))).alias("k", "text_src"))
    idx = F.row_number().over(Window.partitionBy("video_id").orderBy("turn", "k", "role", "text_src")) - 1
    return _timed(c.select("video_id", idx.alias("idx"), F.col("role").alias("speaker_id"), "text_src"))


def edge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: F1 with blank texts, empty and reversed intervals, overlaps and distances of exactly the limits."""
    s, k = segments(spark, sf_dir), F.col("idx")
    before = F.lag("end").over(Window.partitionBy("video_id").orderBy("idx"))
    start = F.when(k % 7 == 2, F.col("start") - 1.5).when((k % 19 == 6) & before.isNotNull(), before + 0.85).when((k % 19 == 11) & before.isNotNull(), before + 0.15).otherwise(F.col("start"))
    s = s.withColumn("from", start)
    end = F.when(k % 17 == 3, F.col("from")).when(k % 17 == 8, F.col("from") - 0.2).when(k % 11 == 1, F.col("from") + 0.35).when(k % 11 == 5, F.col("from") + 0.7).otherwise(F.greatest(F.col("from"), F.col("end")))
    text = F.when(k % 13 == 4, F.lit("")).when(k % 13 == 9, F.lit(" \u3000")).otherwise(F.col("text_src"))
    return s.withColumn("end", end).withColumn("start", F.col("from")).withColumn("text_src", text).drop("from")


def wild_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with ends an hour late, infinite, NaN, and of the size of epoch seconds and milliseconds."""
    k = F.col("idx") + F.col("video_id")
    end = F.when(k % 23 == 5, F.col("end") + 3600).when(k % 29 == 7, float("inf")).when(k % 31 == 9, float("nan")).when(k % 37 == 11, 1.7e9).when(k % 41 == 13, 1.7e12).otherwise(F.col("end"))
    return segments(spark, sf_dir).withColumn("end", end)


def turns(spark: SparkSession, sf_dir: str, base=segments) -> DataFrame:
    """shifted speaker turns, with gaps, and videos without any."""
    s = base(spark, sf_dir).filter("idx % 5 <> 3 and video_id % 10 <> 7 and not (video_id % 10 = 3 and idx < 2)")
    return s.select("video_id", F.col("idx").alias("turn_no"), (F.col("start") - 0.3).alias("start"), (F.col("end") - 0.2).alias("end"), F.col("speaker_id").alias("speaker"))


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into fragments, three speakers in turn."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(_fragments(F.col("text"))).alias("idx", "text_src"))
    return _timed(d.select("video_id", "idx", F.concat(F.lit("S"), F.pmod(F.floor(F.col("idx") / 25), F.lit(3)).cast("string")).alias("speaker_id"), "text_src"))


def source_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 as one video for each source, of which one may be most of the corpus; idx has gaps, times go on from document to document."""
    s = long_segments(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("source", F.lit("")).alias("source"))
    s = s.withColumnRenamed("video_id", "doc").join(docs, "doc")
    late = F.col("doc") * 100_000.0
    return s.select(F.col("source").alias("video_id"), (F.col("doc") * 100_000 + F.col("idx")).alias("idx"), (F.col("start") + late).alias("start"), (F.col("end") + late).alias("end"), "text_src", "text_tgt", "speaker_id", "detected_lang")


def tts_meta(spark: SparkSession, sf_dir: str, base=segments) -> DataFrame:
    """durations of synthesised clips, missing for every fourth segment."""
    s = with_segno(base(spark, sf_dir)).filter("segno % 4 <> 0")
    dur = (500 + F.pmod(F.col("segno") * 137 + F.col("video_id") * 11, F.lit(4000))) / 1000.0
    return s.select("video_id", "segno", F.format_string("seg_%05d.flac", "segno").alias("flac_path"), dur.alias("duration_sec"))


def durations(spark: SparkSession, sf_dir: str, base=segments) -> DataFrame:
    return base(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("m")).select("video_id", (F.col("m") + F.col("video_id") % 4 * 0.07).alias("video_dur"))


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments with stored translations in every state."""
    k = F.col("segno") % 7
    tgt = F.when(k == 0, F.lit("")).when(k == 1, F.lit(params.ERROR_MARK)).when(k == 2, F.lit("xx xx xx")).otherwise(F.lower("text_src"))
    return with_segno(segments(spark, sf_dir)).withColumn("text_tgt", tgt)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one media file for each conversation."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("size"))
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.format_string("in/v%d.mp4", "conv_id").alias("path"), "size", F.timestamp_seconds("conv_id").alias("mtime"))


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a third absent, a third with another size, a third unchanged."""
    n = F.col("video_id").cast("long") % 3
    m = media(spark, sf_dir).filter(n != 0)
    video = F.struct(F.concat(F.lit("old/"), "path").alias("path"), F.when(n == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    return m.select("video_id", F.lit(9).alias("version"), video.alias("video"), F.create_map(F.lit("asr_done"), F.lit("true")).alias("steps"), F.create_map(F.lit("segments"), F.concat("video_id", F.lit(".json"))).alias("artifacts"), F.col("mtime").alias("updated_at"))
