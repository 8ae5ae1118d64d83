"""Selecting, preparing and checking translations around a model that plugs in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow import params
from segflow.functions import text as T
from segflow.operators import language
from segflow.operators.shape import with_segno
from segflow.sources.shared import stage

#: Characters (padded) and texts that go to a model at once.
BATCH_CHARS, BATCH_TEXTS = 8192, 64
#: (texts: DataFrame with text, source, target, engine) -> the same with ``out`` and, where a call may fail, ``error`` (null: none)
Translator = Callable[[DataFrame], DataFrame]


def needs_translation(text_tgt: Column) -> Column:
    """Blank, a failure mark, or a glitch."""
    return T.is_blank(text_tgt) | T.is_error_placeholder(text_tgt) | T.is_glitch(text_tgt)


def resume_translations(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Source segments with segno and the text_tgt stored for them.

    A video's stored rows count only if they are as many as its source rows; they join by place.
    """
    s, old = with_segno(source), with_segno(stored)
    n_new = s.groupBy("video_id").agg(F.count("*").alias("n"))
    n_old = old.groupBy("video_id").agg(F.count("*").alias("n"))
    same = n_new.join(n_old, ["video_id", "n"]).select("video_id")
    kept = old.join(same, "video_id").select("video_id", "segno", F.col("text_tgt").alias("kept"))
    return s.drop("text_tgt").join(kept, ["video_id", "segno"], "left").withColumn("text_tgt", T.text_or_empty(F.col("kept"))).drop("kept")


def split_long_text(texts: DataFrame, key: list[str], column: str = "text_src", most: int = params.LONG_TEXT_CHARS) -> DataFrame:
    """(key, part_no, part, long): texts over ``most`` characters in sentences, others whole."""
    t = texts.select(*key, T.strip(F.col(column)).alias("__t"))
    parts = F.when(F.length("__t") > most, T.sentences(F.col("__t"))).otherwise(F.array("__t"))
    return t.withColumn("long", F.length("__t") > most).select(*key, "long", F.posexplode(parts).alias("part_no", "part"))


def source_language(segments: DataFrame, videos: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Segments with ``source``: their own detected_lang, else the video's (video_id, video_lang), else that of the text by ``profiles``, else 'en'."""
    named = lambda c: F.when(T.text_or_empty(c) != "", c)
    choices = [named(F.col("detected_lang"))]
    if videos is not None:
        segments = segments.join(videos.select("video_id", F.col("video_lang").alias("__video_lang")), "video_id", "left")
        choices.append(named(F.col("__video_lang")))
    if profiles is not None:
        # only texts that no label tells are detected
        unknown = F.coalesce(*choices).isNull()
        choices.append(named(language.detected_language(F.when(unknown, F.col("text_src")), profiles)))
    return segments.withColumn("source", F.coalesce(*choices, F.lit("en"))).drop("__video_lang")


def translate_segments(segments: DataFrame, translator: Translator, target: str = "ja", videos: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Segments (video_id, segno, text_src, text_tgt, detected_lang) with pending texts translated, and ``error``.

    Only texts that need it reach ``translator``, each distinct text once, dealt by engine so
    that a worker loads one model; it gets (text, source, target, engine) and adds ``out``.
    Repetitive inputs and glitches become marks. Long texts are translated by sentence. The
    source language is that of source_language. Where a call failed, the segment keeps its
    text_tgt and has the ``error`` (null elsewhere), for ledger.video_errors; others go on.
    """
    key = ["video_id", "segno"]
    need = needs_translation(F.col("text_tgt"))
    pending = stage(source_language(segments.filter(need), videos, profiles).withColumn("__again", T.is_repetitive_input(F.col("text_src"))), "pending")
    parts = split_long_text(pending.filter(~F.col("__again")), key).join(pending.select(*key, "source"), key)
    # joined by a hash first: texts may be long
    parts = stage(parts.withColumn("at", F.xxhash64("part", "source")).withColumn("again", T.is_repetitive_input(F.col("part"))), "parts")
    asked = parts.filter(~F.col("again")).select("at", F.col("part").alias("text"), "source", F.lit(target).alias("target")).distinct()
    asked = asked.drop("at").withColumn("engine", T.select_engine(F.col("source"), F.col("target")))
    told = translator(asked)
    error = F.col("error") if "error" in told.columns else F.lit(None).cast("string")
    answers = told.select(F.xxhash64("text", "source").alias("at"), F.col("text").alias("part"), "source", T.strip(F.col("out")).alias("out"), error.alias("error"))
    made = parts.join(answers, ["at", "part", "source"], "left")
    one = F.when(F.col("again"), F.lit(params.REPETITIVE_PART_MARK)).when(T.is_glitch(F.col("out")), F.lit(params.ERROR_MARK)).otherwise(T.text_or_empty(F.col("out")))
    joined = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "one"))), lambda x: x["one"]), lambda x: x != ""), " ")
    made = pending.join(made.withColumn("one", one).groupBy(*key).agg(joined.alias("joined"), F.min("error").alias("error")), key, "left")
    new = (
        F.when(F.col("error").isNotNull(), F.col("text_tgt"))
        .when(T.is_blank(F.col("text_src")), F.lit(""))
        .when(F.col("__again"), F.lit(params.REPETITIVE_INPUT_MARK))
        .when(T.is_glitch(F.col("joined")), F.lit(params.ERROR_MARK))
        .otherwise(T.text_or_empty(F.col("joined")))
    )
    done = segments.filter(~need).withColumn("error", F.lit(None).cast("string"))
    return done.unionByName(made.withColumn("text_tgt", new).drop("joined", "source", "__again"))


def column_translator(body: Callable[[Column], Column]) -> Translator:
    """A translator from a Column function, such as a pandas_udf over texts."""
    return lambda asked: asked.withColumn("out", body(F.col("text")))


def model_translator(load: Callable[[str], Callable[[str, str, str], str]], retries: int = params.TRANSLATE_RETRIES, backoff_sec: float = params.TRANSLATE_BACKOFF_SEC, partitions: int | None = None) -> Translator:
    """A translator around models that take one text: ``load(engine)`` gives (text, source, target) -> text. See batch_translator."""

    def load_one(engine: str) -> Callable[[list[str], str, str], list[str]]:
        model = load(engine)
        return lambda texts, source, target: [model(x, source, target) for x in texts]

    return batch_translator(load_one, retries, backoff_sec, partitions, most=1)


def batch_translator(
    load: Callable[[str], Callable[[list[str], str, str], list[str]]],
    retries: int = params.TRANSLATE_RETRIES,
    backoff_sec: float = params.TRANSLATE_BACKOFF_SEC,
    partitions: int | None = None,
    budget: int = BATCH_CHARS,
    most: int = BATCH_TEXTS,
) -> Translator:
    """A translator around models that take many texts: ``load(engine)`` gives (texts, source, target) -> texts, once for each task and engine.

    A task's texts of one engine, source and target go to the model in order of their length, as
    many at once as stay below ``budget`` characters when each is padded to the longest, ``most`` at
    most. If such a call fails, or answers with another number of texts, its texts are tried
    one by one. A single text is tried ``retries`` times with a growing wait in between; its last failure becomes
    its ``error``, and stops no other. A model that does not load fails the task, which Spark then repeats elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Callable] = {}

        def ask(engine: str, source: str, target: str, texts: list[str]) -> list[tuple[str | None, str | None]]:
            if engine not in models:
                models.clear()  # one model at a time fits in memory
                models[engine] = load(engine)
            error = None
            for attempt in range(1, (retries if len(texts) == 1 else 1) + 1):
                try:
                    said = list(models[engine](texts, source, target))
                    if len(said) != len(texts):
                        raise ValueError(f"{len(said)} answers to {len(texts)} texts")
                    return [(x, None) for x in said]
                except Exception as e:  # one text must not stop the others
                    error = f"{type(e).__name__}: {e}"
                    if len(texts) == 1 and attempt < retries:
                        time.sleep(backoff_sec * attempt)
            return [(None, error)] if len(texts) == 1 else [x for t in texts for x in ask(engine, source, target, [t])]

        def answered(kind: tuple[str, str, str], texts: list[str]) -> pa.RecordBatch:
            source, target, engine = kind
            out = ask(engine, source, target, texts)
            columns = [texts, [source] * len(texts), [target] * len(texts), [engine] * len(texts), [x for x, _ in out], [e for _, e in out]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["text", "source", "target", "engine", "out", "error"])

        kind, texts = None, []
        for batch in batches:
            for text, *now in zip(*(c.to_pylist() for c in batch.columns)):
                # texts come by length, so the new one is the longest
                if texts and (tuple(now) != kind or len(texts) == most or len(text) * (len(texts) + 1) > budget):
                    yield answered(kind, texts)
                    texts = []
                kind = tuple(now)
                texts.append(text)
        if texts:
            yield answered(kind, texts)

    def translator(asked: DataFrame) -> DataFrame:
        columns = ["engine", F.pmod(F.xxhash64("text"), F.lit(64))]
        dealt = asked.repartition(partitions, *columns) if partitions else asked.repartition(*columns)
        dealt = dealt.sortWithinPartitions("engine", "source", "target", F.length("text"))
        return dealt.select("text", "source", "target", "engine").mapInArrow(run, "text string, source string, target string, engine string, out string, error string")

    return translator
