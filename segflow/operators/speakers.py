"""Speakers: overlap assignment, inventories and voice references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.functions import text as T
from segflow.operators.intervals import overlapping
from segflow.operators.scan import scan
from segflow.operators.shape import with_segno
from segflow.sources.shared import stage, staged


def overlap_totals(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(video_id, idx, speaker, overlap, first_turn): positive overlaps summed for each speaker.

    ``overlap`` is rounded to a microsecond, so that ties do not depend on the order of additions.
    """
    s = segments.select("video_id", "idx", F.col("start").alias("a0"), F.col("end").alias("a1"))
    t = turns.select("video_id", "turn_no", F.col("start").alias("b0"), F.col("end").alias("b1"), "speaker")
    met = overlapping(s, t).select("video_id", "idx", "speaker", "turn_no", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))
    return met.groupBy("video_id", "idx", "speaker").agg(F.round(F.sum("shared"), 6).alias("overlap"), F.min("turn_no").alias("first_turn"))


def assign_speakers(segments: DataFrame, turns: DataFrame, block: int | None = None) -> DataFrame:
    """Segments with the speaker whose turns overlap most (ties: met first).

    Without overlap the previous segment's speaker carries on; at a video's start the turn
    nearest to the segment's middle decides, and without turns the speaker is UNKNOWN.
    idx must be unique within a video. ``block``: speakers carry on in blocks of so many segments (see scan).
    """
    totals = overlap_totals(segments, turns)
    best = totals.groupBy("video_id", "idx").agg(F.min_by("speaker", F.struct(-F.col("overlap"), "first_turn")).alias("best"))
    if block:
        return _carry_in_blocks(segments, turns, best, block)
    found = segments.drop("speaker_id").join(best, ["video_id", "idx"], "left")
    carried = found.withColumn("held", F.last("best", True).over(Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    # only videos that start without an overlap need the nearest turn, and for their first segment only
    first = carried.groupBy("video_id").agg(F.min_by(F.struct("held", ((F.col("start") + F.col("end")) / 2).alias("mid")), "idx").alias("x")).filter("x.held is null").select("video_id", "x.mid")
    named = carried.join(_nearest(first, turns), "video_id", "left")
    return named.withColumn("speaker_id", _named()).select(*segments.columns)



def _named() -> Column:
    return F.coalesce("held", F.when(F.col("nearest") != "", F.col("nearest")), F.lit("UNKNOWN"))


def _nearest(first: DataFrame, turns: DataFrame) -> DataFrame:
    """(video_id, nearest): the speaker of the turn nearest to mid, of ``first`` (video_id, mid)."""
    near = first.join(turns, "video_id").withColumn("gap", F.least(F.abs(F.col("start") - F.col("mid")), F.abs(F.col("end") - F.col("mid"))))
    return near.groupBy("video_id").agg(F.min_by("speaker", F.struct("gap", "turn_no")).alias("nearest"))


def _carry_in_blocks(segments: DataFrame, turns: DataFrame, best: DataFrame, block: int) -> DataFrame:
    """Segments with the speaker carried on from ``best``, whose rows are marks just before those of their segments.

    So segments are not joined by video and idx, and are exchanged once, by their blocks; what a
    video's start falls back to comes with the blocks, too.
    """
    s = staged(segments, "scan")
    best = stage(best.filter("video_id is not null and idx is not null and best is not null"), "best")
    first = s.groupBy("video_id").agg(F.min("idx").alias("idx"), F.min_by((F.col("start") + F.col("end")) / 2, "idx").alias("mid"))
    near = _nearest(first.join(best, ["video_id", "idx"], "left_anti").select("video_id", "mid"), turns)
    rows = s.drop("speaker_id").withColumn("__row", F.lit(1)).unionByName(best.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    named = scan(rows, ("idx", "__row"), block, near, held=("last", F.col("best"))).filter("__row = 1")
    return named.withColumn("speaker_id", _named()).select(*segments.columns)


def speaker_inventory(segments: DataFrame) -> DataFrame:
    """(video_id, n_speakers, speakers sorted)."""
    ids = F.array_sort(F.collect_set("speaker_id"))
    return segments.groupBy("video_id").agg(F.size(ids).cast("long").alias("n_speakers"), ids.alias("speakers"))


def turns_by_speaker(turns: DataFrame) -> DataFrame:
    """(video_id, speaker, n_turns, total_sec, first_turn)."""
    return turns.groupBy("video_id", "speaker").agg(F.count("*").cast("long").alias("n_turns"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("total_sec"), F.min("turn_no").alias("first_turn"))


def best_references(turns: DataFrame, min_sec: float = params.REF_MIN_SEC, max_sec: float = params.REF_MAX_SEC, target_sec: float = params.REF_TARGET_SEC) -> DataFrame:
    """(video_id, speaker_id, ref_start, ref_end): each speaker's best clip.

    Turns of ``min_sec`` or more are scored by their distance from ``target_sec``; without any
    the longest counts, if it lasts a second. Ties: the earlier turn. Turns whose length is NaN do not count.
    """
    dur = F.round(F.col("end") - F.col("start"), 9)
    long_enough = dur >= min_sec
    score = F.when(long_enough, F.round(F.abs(F.least(dur, F.lit(max_sec)) - target_sec), 9)).otherwise(-dur)
    pick = F.min_by(F.struct("start", "end", long_enough.alias("cut"), dur.alias("dur")), F.struct((~long_enough).cast("int"), score, "turn_no"))
    best = turns.filter(~F.isnan(F.col("end") - F.col("start"))).groupBy("video_id", F.col("speaker").alias("speaker_id")).agg(pick.alias("x")).filter(F.col("x.cut") | (F.col("x.dur") >= params.REF_FALLBACK_SEC))
    end = F.when(F.col("x.cut") & (F.col("x.dur") > max_sec), F.col("x.start") + max_sec).otherwise(F.col("x.end"))
    return best.select("video_id", "speaker_id", F.col("x.start").alias("ref_start"), end.alias("ref_end"))


def prompt_texts(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """refs with prompt_text: the texts of overlapping segments by start; none: the one with the nearest middle.

    Segments at one start keep their order. An inner interval join finds the overlaps; only
    references without any are held against all segments of their video.
    """
    s = segments.select("video_id", "idx", "start", "end", T.normalize_spaces(F.col("text_src")).alias("said"))
    key = ["video_id", "speaker_id"]
    over = overlapping(refs.select(*key, F.col("ref_start").alias("a0"), F.col("ref_end").alias("a1")), s.select("video_id", "idx", F.col("start").alias("b0"), F.col("end").alias("b1"), "said"))
    over = over.select(*key, F.col("b0").alias("start"), "idx", "said").groupBy(*key)
    joined = over.agg(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("start", "idx", "said"))), lambda x: x["said"]), lambda x: x != ""), " ").alias("joined"))
    rest = refs.join(joined, key, "left_anti").select(*key, ((F.col("ref_start") + F.col("ref_end")) / 2).alias("mid"))
    near = rest.join(s, "video_id").groupBy(*key).agg(F.min_by("said", F.struct(F.round(F.abs((F.col("start") + F.col("end")) / 2 - F.col("mid")), 9), "idx")).alias("near"))
    return refs.join(joined, key, "left").join(near, key, "left").withColumn("prompt_text", F.coalesce("joined", "near", F.lit(""))).drop("joined", "near")


def speaker_refs(turns: DataFrame, segments: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Best clips with prompt texts; a clip's own transcript (video_id, speaker_id, transcript) comes first if it is not blank."""
    refs = prompt_texts(best_references(turns), segments)
    if transcripts is None:
        return refs
    said = F.when(~T.is_blank(F.col("transcript")), F.col("transcript"))
    return refs.join(transcripts, ["video_id", "speaker_id"], "left").withColumn("prompt_text", F.coalesce(said, "prompt_text")).drop("transcript")


def segment_refs(segments: DataFrame, least: float = params.REF_SEGMENT_SEC, max_sec: float = params.REF_MAX_SEC) -> DataFrame:
    """(video_id, segno, ref_start, ref_end, prompt_text): each segment's own clip, if it is long enough."""
    dur = F.col("end") - F.col("start")
    s = with_segno(segments).filter(dur >= least)
    return s.select("video_id", "segno", F.col("start").alias("ref_start"), (F.col("start") + F.least(dur, F.lit(max_sec))).alias("ref_end"), T.normalize_spaces(F.col("text_src")).alias("prompt_text"))


def choose_references(segments: DataFrame, by_segment: DataFrame, by_speaker: DataFrame) -> DataFrame:
    """Segments (with segno) and ref_start, ref_end, prompt_text, ref_level: 'segment', else 'speaker', else null."""
    names = ["ref_start", "ref_end", "prompt_text"]
    a = by_segment.select("video_id", "segno", F.struct(*names).alias("own"))
    b = by_speaker.select("video_id", "speaker_id", F.struct(*names).alias("voice"))
    both = segments.join(a, ["video_id", "segno"], "left").join(b, ["video_id", "speaker_id"], "left")
    best = F.coalesce("own", "voice")
    level: Column = F.when(F.col("own").isNotNull(), F.lit("segment")).when(F.col("voice").isNotNull(), F.lit("speaker"))
    return both.select("*", *(best[n].alias(n) for n in names), level.alias("ref_level")).drop("own", "voice")


def reference_coverage(segments: DataFrame, by_segment: DataFrame) -> DataFrame:
    """(video_id, built, total)."""
    built = by_segment.groupBy("video_id").agg(F.count("*").alias("built"))
    total = segments.groupBy("video_id").agg(F.count("*").cast("long").alias("total"))
    return total.join(built, "video_id", "left").select("video_id", F.coalesce("built", F.lit(0)).cast("long").alias("built"), "total")
