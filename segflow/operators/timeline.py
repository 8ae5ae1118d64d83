"""Retiming: a video cut into gaps, speech and a tail, stretched to synthesised clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.functions import text as T
from segflow.functions import timing
from segflow.operators.scan import scan
from segflow.operators.shape import place_order, with_segno
from segflow.sources.shared import staged

_EPS = params.EPSILON


def accepted_segments(segments: DataFrame, durations: DataFrame, block: int | None = None) -> DataFrame:
    """Segments that a cursor sweep accepts: (video_id, segno, start, end, cursor, vd), clamped into the video.

    ``durations``: video_id, video_dur. The cursor is the end of what came before; segments
    that end at or before it are dropped. A running maximum stands for the sweep. ``block``: in
    blocks of so many segments (see scan); places and cursor then come from one pass, and the clamp at the
    video's end, which keeps the order of ends, follows it.
    """
    limits = durations.select("video_id", F.greatest(F.lit(0.0), "video_dur").alias("vd"))
    start = F.greatest(F.lit(0.0), F.col("start"))
    end = F.greatest(start, "end")
    clamped = [F.least(start, "vd").alias("start"), F.least(end, "vd").alias("end")]
    if block:
        order = place_order(segments)
        s = scan(staged(segments, "scan", *dict.fromkeys(("video_id", *order, "start", "end"))), order, block, limits, "inner", segno=("count", F.lit(1)), cursor=("max", end))
        cursor = F.when(F.col("cursor").isNotNull(), F.least("cursor", "vd"))
        s = s.select("video_id", F.col("segno").cast("int").alias("segno"), "vd", *clamped, cursor.alias("cursor"))
    else:
        s = with_segno(segments).join(limits, "video_id").select("video_id", "segno", "vd", *clamped)
        s = s.withColumn("cursor", F.max("end").over(Window.partitionBy("video_id").orderBy("segno").rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("cursor", F.coalesce("cursor", F.lit(0.0)))
    return s.filter((F.col("cursor") < F.col("vd") - _EPS) & (F.col("end") > F.col("cursor") + _EPS))


def _speech(accepted: DataFrame, tts_meta: DataFrame) -> DataFrame:
    """with out_duration and speed: the synthesised duration if there is one, else the original."""
    m = tts_meta.select("video_id", "segno", "duration_sec").filter("duration_sec > 0")
    own = F.greatest(F.lit(params.MIN_SPEECH_SEC), F.col("end") - F.col("start"))
    joined = accepted.join(m, ["video_id", "segno"], "left")
    return joined.select("*", F.coalesce("duration_sec", own).alias("out_duration"), F.when(F.col("duration_sec").isNotNull(), own / F.greatest(F.lit(params.MIN_SPEECH_SEC), "duration_sec")).otherwise(1.0).alias("speed"))


def layout(segments: DataFrame, tts_meta: DataFrame, durations: DataFrame, absorb: bool = True) -> DataFrame:
    """(video_id, part_no, kind, orig_start, orig_end, out_duration, speed, segno): the parts in order.

    A gap comes before speech that starts past the cursor; a tail fills the video. Overlapping
    speech keeps its own start, so that its source is played again. With ``absorb``, gaps under
    ``MIN_PART_SEC`` join the next speech and such a tail the last speech. Videos without
    segments are one tail; those without duration have no parts.
    """
    w = Window.partitionBy("video_id").orderBy("segno")
    speech = _speech(accepted_segments(segments, durations), tts_meta)
    speech = speech.withColumn("gap", F.when(F.col("start") > F.col("cursor") + _EPS, F.col("start") - F.col("cursor"))).withColumn("next", F.lead("segno").over(w))
    speech = speech.withColumn("tail", F.when(F.col("next").isNull() & (F.col("vd") > F.col("end") + _EPS), F.col("vd") - F.col("end")))
    tiny = lambda c: F.coalesce(F.col(c) < params.MIN_PART_SEC, F.lit(False)) if absorb else F.lit(False)
    row = lambda kind, a, b, out, speed, segno: F.struct(F.lit(kind).alias("kind"), a.alias("orig_start"), b.alias("orig_end"), out.alias("out_duration"), speed.alias("speed"), segno.alias("segno"))
    c = F.col
    begin = F.when(tiny("gap"), c("cursor")).otherwise(c("start"))
    end = F.when(tiny("tail"), c("vd")).otherwise(c("end"))
    speed = F.when(tiny("gap") | tiny("tail"), F.greatest(F.lit(params.MIN_SPEECH_SEC), end - begin) / F.greatest(F.lit(params.MIN_SPEECH_SEC), c("out_duration"))).otherwise(c("speed"))
    none = F.lit(0)
    gap = F.when(c("gap").isNotNull() & ~tiny("gap"), row("gap", c("cursor"), c("start"), c("gap"), F.lit(1.0), none))
    tail = F.when(c("tail").isNotNull() & ~tiny("tail"), row("tail", c("end"), c("vd"), c("tail"), F.lit(1.0), none))
    parts = speech.select("video_id", "segno", F.posexplode(F.array(gap, row("speech", begin, end, c("out_duration"), speed, c("segno")), tail)).alias("k", "x")).filter("x is not null")
    # videos that no segment covers
    bare = durations.join(speech.select("video_id").distinct(), "video_id", "left_anti").filter(c("video_dur") > _EPS)
    bare = bare.select("video_id", F.lit(0).alias("segno"), F.lit(0).alias("k"), row("tail", F.lit(0.0), c("video_dur"), c("video_dur"), F.lit(1.0), none).alias("x"))
    every = parts.unionByName(bare).withColumn("part_no", F.row_number().over(Window.partitionBy("video_id").orderBy("segno", "k")))
    return every.select("video_id", "part_no", "x.*")


def retimed_totals(parts: DataFrame) -> DataFrame:
    """(video_id, n_parts, total_out)."""
    return parts.groupBy("video_id").agg(F.count("*").cast("long").alias("n_parts"), F.round(F.sum("out_duration"), 6).alias("total_out"))


def place(parts: DataFrame, block: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Parts with out_start: where each begins on the new timeline. ``block``: in blocks of so many parts (see scan).

    ``order``: columns that say the parts' order, where they have no part_no yet; it then comes from the same pass.
    """
    if block:
        numbered = {"part_no": ("count", F.lit(1))} if order else {}
        return scan(staged(parts, "scan"), order or ("part_no",), block, out_start=("sum", F.col("out_duration")), **numbered)
    if order:
        parts = parts.withColumn("part_no", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)).cast("long"))
    before = Window.partitionBy("video_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("out_start", F.coalesce(F.sum("out_duration").over(before), F.lit(0.0)))


def track_source(kind: Column, path: Column, exists: Column) -> Column:
    """Where a part's dubbed sound comes from: 'silence', 'file', or 'missing' (silence of the same length)."""
    return F.when(kind != "speech", F.lit("silence")).when(path.isNotNull() & F.coalesce(exists, F.lit(False)), F.lit("file")).otherwise(F.lit("missing"))


def render_plan(parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each part: trim, speed, tempo chain, source, concat line and place.

    ``outputs``: video_id, segno, flac_path, file_exists.
    """
    o = outputs.select("video_id", "segno", "flac_path", "file_exists")
    p = place(parts).join(o, ["video_id", "segno"], "left")
    source = track_source(F.col("kind"), F.col("flac_path"), F.col("file_exists"))
    p = p.withColumn("source", source).withColumn("trim", timing.safe_trim(F.col("orig_start"), F.col("orig_end"))).withColumn("safe_speed", timing.safe_speed(F.col("speed")))
    name = F.when(F.col("source") == "file", F.col("flac_path")).when(F.col("source") == "silence", F.format_string("dub_%05d_sil.flac", "part_no")).otherwise(F.format_string("dub_%05d_missing.flac", "part_no"))
    return p.select(
        "video_id",
        "part_no",
        "kind",
        F.col("trim.start").alias("trim_start"),
        F.col("trim.end").alias("trim_end"),
        F.col("safe_speed").alias("speed"),
        timing.tempo_chain(F.col("safe_speed")).alias("tempo"),
        "source",
        T.concat_line(name).alias("concat_line"),
        "out_start",
        "out_duration",
    )
