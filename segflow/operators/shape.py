"""Order-dependent grouping of segments: merging, chunking, sentence splitting, units.

All take and return segments: video_id, idx, start, end, text_src, speaker_id,
detected_lang. Order within a video is that of idx (ties: start, end, text). Greedy groups
depend on all that came before, so a video's rows stream by in order, in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from segflow import params
from segflow.functions import text as T
from segflow.operators.scan import scan
from segflow.sources.shared import stage, staged

COLUMNS = ["video_id", "idx", "start", "end", "text_src", "speaker_id", "detected_lang"]
_ORDER = ("idx", "start", "end", "text_src")
#: Groups that leave a task at once.
ROWS = 4096


def drop_blank(segments: DataFrame) -> DataFrame:
    return segments.filter(~T.is_blank(F.col("text_src")))


def drop_empty_intervals(segments: DataFrame) -> DataFrame:
    return segments.filter("end > start")


def renumber(segments: DataFrame, *order: str, block: int | None = None) -> DataFrame:
    """idx 0, 1, ... within each video in the given order; ``block``: in blocks of so many places (see scan)."""
    if block:
        numbered = scan(staged(segments.drop("idx") if "idx" not in order else segments, "scan"), order, block, __place=("count", F.lit(1)))
        return numbered.withColumn("idx", (F.col("__place") - 1).cast("int")).drop("__place")
    return segments.withColumn("idx", (F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) - 1).cast("int"))


def place_order(segments: DataFrame) -> tuple[str, ...]:
    """The columns that order a video's segments: idx, then those that break ties."""
    return tuple(c for c in _ORDER if c in segments.columns)


def with_segno(segments: DataFrame, block: int | None = None) -> DataFrame:
    """segno: place in the video, from 1; idx may have gaps. ``block``: in blocks of so many places (see scan)."""
    order = place_order(segments)
    if block:
        return scan(staged(segments, "scan"), order, block, segno=("count", F.lit(1))).withColumn("segno", F.col("segno").cast("int"))
    return segments.withColumn("segno", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)).cast("int"))


@dataclass
class _Group:
    """A group so far: its times, characters, whether its last text ends a sentence, and what it is made of."""

    start: float | None
    end: float | None
    n: int
    stop: bool
    speaker: str
    lang: str
    texts: list[str]
    count: int = 1


#: Whether the group takes in the next segment (a group of one).
_Rule = Callable[[_Group, _Group], bool]


def _within(later: float | None, earlier: float | None, limit: float) -> bool:
    """later - earlier <= limit; false where a time is missing or no number."""
    return later is not None and earlier is not None and later - earlier <= limit


def _grouped(rows: Iterator[tuple[object, _Group]], joins: _Rule) -> Iterator[tuple[object, _Group]]:
    """Greedy groups of the rows of each video, which come in order: a row joins the current group of its speaker if ``joins`` holds."""
    video, g = None, None
    for key, x in rows:
        if g is not None and key == video and g.speaker == x.speaker and joins(g, x):
            g.end, g.n, g.stop, g.lang, g.count = x.end, g.n + 1 + x.n, x.stop, g.lang or x.lang, g.count + 1
            g.texts += x.texts
            continue
        if g is not None:
            yield video, _closed(g)
        video, g = key, x
    if g is not None:
        yield video, _closed(g)


def _closed(g: _Group) -> _Group:
    g.texts, g.count = [" ".join(g.texts)], 1
    return g


def _folding(rules: list[_Rule], kind: pa.DataType) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Group]]:
        for batch in batches:
            for video, start, end, text, speaker, lang, n, stop, _ in zip(*(c.to_pylist() for c in batch.columns)):
                yield video, _Group(start, end, n, stop, speaker, lang, [text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = rows(batches)
        for joins in rules:
            stream = _grouped(stream, joins)
        kinds = [kind, pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string()]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], COLUMNS)
        out = []
        for _, of_video in groupby(stream, key=lambda x: x[0]):
            for idx, (video, g) in enumerate(of_video):
                out.append((video, idx, g.start, g.end, g.texts[0], g.speaker, g.lang))
                if len(out) == ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return run


def _folded(segments: DataFrame, clean: Callable[[Column], Column], rules: list[_Rule], order: tuple[str, ...] = _ORDER) -> DataFrame:
    """Segments grouped by the rules one after the other, in one pass over each video's rows in order.

    A window numbers the rows, which come dealt by video and sorted by it (without an exchange, if
    they were dealt so before); then they stream by, and only the group at hand is kept, so
    neither a video nor an island of it is ever held as a whole.
    """
    s = segments.select(
        "video_id",
        F.col("start").cast("double").alias("start"),
        F.col("end").cast("double").alias("end"),
        clean(F.col("text_src")).alias("text_src"),
        T.text_or_empty(F.col("speaker_id")).alias("speaker_id"),
        T.text_or_empty(F.col("detected_lang")).alias("detected_lang"),
        *(F.col(c) for c in order if c not in ("start", "end", "text_src")),
    ).filter("text_src <> ''")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(*order)).alias("place")
    rows = s.select("video_id", "start", "end", "text_src", "speaker_id", "detected_lang", F.length("text_src").alias("n"), T.ends_sentence(F.col("text_src")).alias("stop"), place)
    video_type = segments.schema["video_id"].dataType
    schema = f"video_id {video_type.simpleString()}, idx int, start double, end double, text_src string, speaker_id string, detected_lang string"
    return rows.mapInArrow(_folding(rules, to_arrow_type(video_type)), schema)


def _merge_rule(max_sec: float, max_chars: int, gap: float, very_short: float) -> _Rule:
    def joins(g: _Group, x: _Group) -> bool:
        short = _within(g.end, g.start, very_short) or _within(x.end, x.start, very_short)
        return _within(x.start, g.end, gap) and _within(x.end, g.start, max_sec) and g.n + 1 + x.n <= max_chars and (short or not g.stop)

    return joins


def _chunk_rule(max_sec: float, max_chars: int, gap: float) -> _Rule:
    return lambda g, x: _within(x.start, g.end, gap) and _within(x.end, g.start, max_sec) and g.n + 1 + x.n <= max_chars


def _unit_rule(max_sentences: int, max_chars: int, gap: float) -> _Rule:
    return lambda g, x: g.count < max_sentences and _within(x.start, g.end, gap) and g.n + 1 + x.n <= max_chars


def merge_segments(
    segments: DataFrame,
    max_sec: float = params.MERGE_MAX_SEC,
    max_chars: int = params.MERGE_MAX_CHARS,
    gap: float = params.MERGE_GAP_SEC,
    very_short: float = params.MERGE_VERY_SHORT_SEC,
) -> DataFrame:
    """Merge fragments of one speaker until a sentence ends; very short ones merge anyway."""
    return _folded(segments, T.strip, [_merge_rule(max_sec, max_chars, gap, very_short)])


def chunk_segments(segments: DataFrame, max_sec: float = params.CHUNK_MAX_SEC, max_chars: int = params.CHUNK_MAX_CHARS, gap: float = params.CHUNK_GAP_SEC) -> DataFrame:
    """Chunks of one speaker for sentence splitting."""
    return _folded(segments, T.strip, [_chunk_rule(max_sec, max_chars, gap)])


def merge_sentence_units(segments: DataFrame, max_sentences: int = params.UNIT_MAX_SENTENCES, max_chars: int = params.UNIT_MAX_CHARS, gap: float = params.UNIT_GAP_SEC) -> DataFrame:
    """Translation units of a few sentences; texts are space-normalised."""
    return _folded(segments, T.normalize_spaces, [_unit_rule(max_sentences, max_chars, gap)])


def split_sentences(segments: DataFrame, splitter: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """One row for each sentence, with its share of the segment's time by length.

    ``splitter`` maps a text to its sentences (array<string>); a pandas_udf works, too. A
    segment of one sentence or of no duration stays one row.
    """
    return renumber(_sentences(segments, splitter).withColumn("idx", F.lit(0)), "old", "k").select(*COLUMNS)


def _sentences(segments: DataFrame, splitter: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """The rows of split_sentences with ``old`` and ``k``, their order in a video, in place of idx."""
    s = segments.select("video_id", "idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text_src", "speaker_id", "detected_lang")
    s = drop_blank(s).withColumn("parts", splitter(F.col("text_src")))
    one = (F.size("parts") <= 1) | (T.duration(F.col("start"), F.col("end")) <= 0)
    s = s.withColumn("parts", F.when(one, F.array(F.col("text_src"))).otherwise(F.col("parts")))
    weighed = s.withColumn("weights", F.transform("parts", lambda x: T.time_weight(x).cast("double")))
    ends = F.aggregate("weights", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    each = weighed.withColumn("upto", ends).select("video_id", "idx", "start", "end", "speaker_id", "detected_lang", "upto", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "sentence"))
    total = F.element_at("upto", -1)
    at = lambda k: F.col("start") + T.duration(F.col("start"), F.col("end")) * (F.get("upto", k) / total)
    clamp = lambda lo, x: F.greatest(lo, F.least(x, F.col("end")))
    begin = F.when(F.col("n") == 1, F.col("start")).otherwise(clamp(F.col("start"), at(F.col("k"))))
    raw_end = F.when(F.col("k") == F.col("n") - 1, F.col("end")).otherwise(at(F.col("k") + 1))
    timed = each.select("video_id", "idx", "k", "n", "end", begin.alias("begin"), raw_end.alias("raw_end"), "sentence", "speaker_id", "detected_lang")
    return timed.select(
        "video_id",
        F.col("idx").alias("old"),
        "k",
        F.col("begin").alias("start"),
        F.when(F.col("n") == 1, F.col("end")).otherwise(clamp(F.col("begin"), F.col("raw_end"))).alias("end"),
        T.normalize_spaces(F.col("sentence")).alias("text_src"),
        "speaker_id",
        "detected_lang",
    )


def shape(segments: DataFrame) -> DataFrame:
    """Merge, chunk, split and unite: recogniser fragments to translation units."""
    merge = _merge_rule(params.MERGE_MAX_SEC, params.MERGE_MAX_CHARS, params.MERGE_GAP_SEC, params.MERGE_VERY_SHORT_SEC)
    chunk = _chunk_rule(params.CHUNK_MAX_SEC, params.CHUNK_MAX_CHARS, params.CHUNK_GAP_SEC)
    unite = _unit_rule(params.UNIT_MAX_SENTENCES, params.UNIT_MAX_CHARS, params.UNIT_GAP_SEC)
    # merging and chunking are one pass; sentences need not be numbered to be put in order
    return _folded(_sentences(_folded(segments, T.strip, [merge, chunk])), T.normalize_spaces, [unite], ("old", "k"))


def observed_shape(segments: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
    """``shape``, and the rows after each step, counted as they pass: read them (``.get["n"]``) once an action has run over the units."""
    seen: dict[str, Observation] = {}

    def counted(d: DataFrame, name: str) -> DataFrame:
        seen[name] = Observation(name)
        return d.observe(seen[name], F.count(F.lit(1)).alias("n"))

    merged = counted(merge_segments(counted(segments, "raw")), "merged")
    split = counted(_sentences(counted(chunk_segments(merged), "chunked")), "split")
    units = _folded(split, T.normalize_spaces, [_unit_rule(params.UNIT_MAX_SENTENCES, params.UNIT_MAX_CHARS, params.UNIT_GAP_SEC)], ("old", "k"))
    return counted(units, "units"), seen


def stage_funnel(segments: DataFrame) -> DataFrame:
    """(video_id, stage, n): rows after each step of ``shape``; each step is staged, so that none runs twice."""
    merged = stage(merge_segments(segments), "merged")
    chunked = stage(chunk_segments(merged), "chunked")
    split = stage(split_sentences(chunked), "split")
    stages = {"raw": segments, "merged": merged, "chunked": chunked, "split": split, "units": merge_sentence_units(split)}
    out = None
    for name, d in stages.items():
        n = d.groupBy("video_id").agg(F.count("*").cast("long").alias("n")).select("video_id", F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def plan_chunks(media: DataFrame, available_gb: float = params.CHUNK_REFERENCE_GB) -> DataFrame:
    """(video_id, chunk_sec, chunk_no, n_chunks, start_sec, end_sec): windows of media time that fit in memory.

    ``media``: video_id, video_dur. Media within one chunk stay whole.
    """
    hop = params.HOP_SAMPLES / params.SAMPLE_RATE
    raw = params.CHUNK_REFERENCE_SEC * (available_gb / params.CHUNK_REFERENCE_GB) * params.CHUNK_SAFETY
    seconds = max(params.CHUNK_MIN_SEC, min(params.CHUNK_LIMIT_SEC, int(int(raw / hop) * hop)))
    size = seconds * params.SAMPLE_RATE // params.HOP_SAMPLES * params.HOP_SAMPLES
    samples = F.rint(F.col("video_dur") * params.SAMPLE_RATE).cast("long")
    whole = samples / params.SAMPLE_RATE <= seconds
    n = F.when(whole, F.lit(1).cast("long")).otherwise(F.ceil(samples / size))
    m = media.select("video_id", samples.alias("samples"), n.alias("n_chunks"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_no"))
    end = F.when(F.col("n_chunks") == 1, F.col("samples")).otherwise(F.least((F.col("chunk_no") + 1) * size, F.col("samples")))
    return m.select("video_id", F.lit(seconds).alias("chunk_sec"), "chunk_no", "n_chunks", (F.col("chunk_no") * size / params.SAMPLE_RATE).alias("start_sec"), (end / params.SAMPLE_RATE).alias("end_sec"))
