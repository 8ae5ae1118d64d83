"""Planning and reconciling speech synthesis, which runs elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow import params
from segflow.functions import text as T
from segflow.functions import timing
from segflow.operators.speakers import choose_references


def pending_synthesis(segments: DataFrame, outputs: DataFrame) -> DataFrame:
    """Eligible segments (with segno) that have no usable output.

    ``outputs``: video_id, segno, file_exists, duration_sec, in_meta. An output is usable if its
    file exists and is known from metadata or has a positive duration.
    """
    eligible = segments.filter(timing.tts_eligible(F.col("start"), F.col("end"), F.col("text_tgt")))
    return eligible.join(usable_outputs(outputs), ["video_id", "segno"], "left_anti")


def usable_outputs(outputs: DataFrame) -> DataFrame:
    """(video_id, segno) of the outputs that need not be made again."""
    usable = F.col("file_exists") & (F.col("in_meta") | (F.coalesce("duration_sec", F.lit(0.0)) > 0))
    return outputs.filter(usable).select("video_id", "segno")


def synthesis_plan(segments: DataFrame, by_segment: DataFrame, by_speaker: DataFrame, engine: str = "omnivoice", target: str = "ja") -> DataFrame:
    """(video_id, segno, text, ref_level, prompt_text, target_sec, request, error): what to synthesise.

    Segments without a reference are left out. ``request`` is the body for a synthesis server
    (null for in-process engines); ``error`` tells why an engine cannot do the language.
    """
    eligible = segments.filter(timing.tts_eligible(F.col("start"), F.col("end"), F.col("text_tgt")))
    chosen = choose_references(eligible, by_segment, by_speaker).filter("ref_level is not null")
    text = T.normalize_spaces(F.col("text_tgt"))
    wav = F.when(F.col("ref_level") == "segment", F.format_string("ovseg_ref_%05d.wav", "segno")).otherwise(F.concat(F.lit("ovref_"), "speaker_id", F.lit(".wav")))
    request = T.synthesis_request(text, wav) if engine == "irodori" else F.lit(None).cast("string")
    return chosen.select(
        "video_id",
        "segno",
        text.alias("text"),
        "ref_level",
        "prompt_text",
        timing.target_duration(T.duration(F.col("start"), F.col("end"))).alias("target_sec"),
        request.alias("request"),
        T.pair_error(F.lit(engine), F.lit(target)).alias("error"),
    )


def reconcile(plan: DataFrame, results: DataFrame, retries: int = params.QUALITY_RETRIES, check: bool = True) -> DataFrame:
    """(video_id, segno, flac_path, duration_sec, attempts, quality_reason): the accepted clip of each planned segment.

    ``results``: video_id, segno, attempt (from 1), flac_path, duration_sec. The first attempt
    that passes is taken; the last allowed one is taken as it is. Clips without duration give no
    row. Without ``check`` the first attempt counts.
    """
    r = results.filter(F.col("attempt") <= retries + 1).join(plan.select("video_id", "segno", "text", "target_sec"), ["video_id", "segno"])
    reason = timing.quality_reason(F.col("duration_sec"), F.col("target_sec"), F.col("text")) if check else F.lit(None).cast("string")
    r = r.withColumn("quality_reason", reason)
    passed = F.col("quality_reason").isNull()
    best = F.min_by(F.struct("flac_path", "duration_sec", F.col("attempt").alias("attempts"), "quality_reason"), F.struct((~passed).cast("int"), F.when(passed, F.col("attempt")).otherwise(-F.col("attempt"))))
    return r.groupBy("video_id", "segno").agg(best.alias("x")).select("video_id", "segno", "x.*").filter("duration_sec > 0")


def synthesis_progress(segments: DataFrame, outputs: DataFrame, plan: DataFrame, results: DataFrame, accepted: DataFrame) -> DataFrame:
    """(video_id, total, done_count, failed) of a run that may still go on.

    Done are segments that need no clip or have no reference (not in ``plan``), those whose
    earlier output is reused, those with an accepted clip, and failed ones: planned, tried
    (in ``results``), and without an accepted clip. What is planned but not tried is not done.
    """
    key = ["video_id", "segno"]
    mark = lambda d, name: d.select(*key).distinct().withColumn(name, F.lit(True))
    s = segments.select(*key)
    for d, name in ((usable_outputs(outputs), "reused"), (plan, "planned"), (results, "tried"), (accepted, "made")):
        s = s.join(mark(d, name), key, "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    asked = yes("planned") & ~yes("reused") & ~yes("made")
    count = lambda c: F.sum(c.cast("long"))
    return s.groupBy("video_id").agg(F.count("*").cast("long").alias("total"), count(~(asked & ~yes("tried"))).alias("done_count"), count(asked & yes("tried")).alias("failed"))
