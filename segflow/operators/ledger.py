"""Progress of each video across runs, and the grid of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow import params
from segflow.functions import text as T

SCHEMA = "video_id string, version int, video struct<path: string, size: bigint, mtime: timestamp>, steps map<string, string>, artifacts map<string, string>, updated_at timestamp"
VERSION = 9
#: Fixed value: steps of a fresh document; other steps may be set, too.
STEPS = {"probe_done": "false", "asr_done": "false", "diarization_done": "false", "translate_done": "false", "tts": '{"done_count":0,"total":0}', "retime_done": "false", "mux_done": "false"}


def changed_inputs(media: DataFrame, ledger: DataFrame) -> DataFrame:
    """media (video_id, path, size, mtime) with state: 'resume' if size and mtime equal the ledger's, else 'changed' or 'new'. The path does not count."""
    old = ledger.select("video_id", F.col("video.size").alias("old_size"), F.col("video.mtime").alias("old_mtime"), F.lit(True).alias("known"))
    both = media.join(old, "video_id", "left")
    same = F.col("known") & F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    return both.select("video_id", "path", "size", "mtime", F.when(same, F.lit("resume")).when(F.col("known"), F.lit("changed")).otherwise(F.lit("new")).alias("state"))


def unfinished_media(media: DataFrame, outputs: DataFrame, suffix: str = params.OUTPUT_SUFFIX) -> DataFrame:
    """Media whose output (path) is not there yet, next to the source."""
    wanted = F.concat(F.regexp_replace("path", r"[^/]*\z", ""), T.output_name(F.col("path"), suffix))
    done = outputs.select(F.col("path").alias("wanted"))
    return media.withColumn("wanted", wanted).join(done, "wanted", "left_anti").drop("wanted")


def latest(ledger: DataFrame) -> DataFrame:
    """The newest document of each video."""
    columns = [c for c in ledger.columns if c != "video_id"]
    return ledger.groupBy("video_id").agg(F.max_by(F.struct(*columns), "updated_at").alias("x")).select("video_id", "x.*")


def open_ledger(media: DataFrame, ledger: DataFrame) -> DataFrame:
    """One document for each video: the stored one if its signature matches, else a fresh one."""
    stored = latest(ledger)
    fresh = F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv))
    state = changed_inputs(media, stored).join(stored.select("video_id", "version", "steps", "artifacts", "updated_at"), "video_id", "left")
    resume = F.col("state") == "resume"
    return state.select(
        "video_id",
        F.when(resume, F.col("version")).otherwise(VERSION).alias("version"),
        F.struct("path", "size", "mtime").alias("video"),
        F.when(resume, F.col("steps")).otherwise(fresh).alias("steps"),
        F.when(resume, F.col("artifacts")).otherwise(F.create_map().cast("map<string,string>")).alias("artifacts"),
        F.when(resume, F.col("updated_at")).alias("updated_at"),
        "state",
    )


def finished(media: DataFrame, step: str, at: Column) -> DataFrame:
    """A fresh document with ``step`` done for each video of media (video_id, path, size, mtime)."""
    entries = STEPS | {step: "true"}
    return media.select(
        "video_id",
        F.lit(VERSION).alias("version"),
        F.struct("path", "size", "mtime").alias("video"),
        F.create_map(*(F.lit(x) for kv in entries.items() for x in kv)).alias("steps"),
        F.create_map().cast("map<string,string>").alias("artifacts"),
        at.alias("updated_at"),
    )


def set_entries(ledger: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """``column`` (steps or artifacts) with the entries of ``updates`` (video_id, entries: map) set; new values win."""
    u = updates.select("video_id", F.col("entries").alias("__new"))
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return ledger.join(u, "video_id", "left").withColumn(column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(F.map_concat(kept, "__new"))).drop("__new")


def batch_outcome(results: DataFrame) -> DataFrame:
    """(n_videos, n_failed): one row; ``results``: video_id, error (null: success)."""
    return results.agg(F.count("*").cast("long").alias("n_videos"), F.count("error").cast("long").alias("n_failed"))


def video_errors(*found: DataFrame) -> DataFrame:
    """(video_id, error): one error for each video that has any, of tables with both columns (error null: none)."""
    every = None
    for d in found:
        own = d.filter("error is not null").select(F.col("video_id").cast("string").alias("video_id"), "error")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("video_id").agg(F.min("error").alias("error"))


def failed_videos(results: DataFrame) -> DataFrame:
    """(video_id, error): a row for every failure."""
    return results.filter("error is not null").select("video_id", "error")


def case_grid(spark) -> DataFrame:
    """(case_no, asr_engine, enable_audio_separation, tts_engine, case_id): every configuration, in product order."""
    axis = lambda name, values: spark.createDataFrame(list(enumerate(values)), f"{name}_no int, {name} string")
    a, b, c = axis("asr_engine", params.ASR_ENGINES), axis("enable_audio_separation", params.AUDIO_MODES), axis("tts_engine", params.TTS_ENGINES)
    grid = a.crossJoin(b).crossJoin(c)  # three short fixed lists
    no = (F.col("asr_engine_no") * len(params.AUDIO_MODES) + F.col("enable_audio_separation_no")) * len(params.TTS_ENGINES) + F.col("tts_engine_no")
    return grid.select(no.alias("case_no"), "asr_engine", "enable_audio_separation", "tts_engine", T.case_id(F.col("asr_engine"), F.col("enable_audio_separation"), F.col("tts_engine")).alias("case_id"))


def with_status(results: DataFrame) -> DataFrame:
    """passed: return code 0 and an output that exists; else failed."""
    return results.withColumn("status", F.when((F.coalesce("returncode", F.lit(1)) == 0) & F.col("output_exists"), F.lit("passed")).otherwise(F.lit("failed")))


def matrix_summary(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, passed, failed)."""
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return with_status(results).groupBy(*keys).agg(F.count("*").cast("long").alias("total"), count("passed"), count("failed"))
