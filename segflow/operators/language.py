"""Languages: detection by character trigrams, majority per video, filling in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow.functions import text as T

#: Rows whose trigrams a task holds at once; rows of all profiles that go with a function (some 250 languages).
ROWS, PROFILE_ROWS = 512, 100_000


def _padded(text: str) -> str:
    """White space collapsed (the characters that T.strip knows), and a space at either end: what trigrams are taken from."""
    return f" {' '.join(text.split())} "


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each trigram of each text as one integer (21 bits a character), and its text's place."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.array([len(x) for x in texts], np.int64)
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    row = np.repeat(np.arange(len(texts)), n)
    inside = row[:-2] == row[2:]
    return keys[inside], row[:-2][inside]


def _gram(key: int) -> str:
    return "".join(chr(key >> k & 0x1FFFFF) for k in (42, 21, 0))


def _key(gram: str) -> int:
    return sum(ord(c) << k for c, k in zip(gram, (42, 21, 0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) from (lang, text in lower case), summed over some rows at a time."""
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            langs, texts = (batch.column(i).slice(lo, ROWS).to_pylist() for i in (0, 1))
            keys, row = _trigrams([*map(_padded, texts)])
            names, at = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
            lang, gram, n = [], [], []
            for k, name in enumerate(names.tolist()):
                own, count = np.unique(keys[at[row] == k], return_counts=True)
                lang += [name] * len(own)
                gram += map(_gram, own.tolist())
                n += count.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def train_profiles(labelled: DataFrame, most: int = 400) -> DataFrame:
    """(lang, gram, logp) from (text, lang): the ``most`` frequent trigrams of each language, with a floor row (gram '').

    At most ``most`` + 1 rows for each language, so the profiles are small.
    """
    texts = labelled.filter(F.col("lang").isNotNull() & ~T.is_blank(F.col("text"))).select(T.normalize_lang_code(F.col("lang")).alias("lang"), F.lower("text").alias("text"))
    counts = texts.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= most)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = top.join(total, "lang").select("lang", "gram", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * most)).alias("logp"))
    floor = total.select("lang", F.lit("").alias("gram"), F.log(F.lit(0.5) / (F.col("total") + 0.5 * most)).alias("logp"))
    return kept.unionByName(floor)


def detected_language(c: Column, profiles: DataFrame) -> Column:
    """The language whose trigram profile makes the text likeliest (ties: the first by name); '' under 3 characters or without a known trigram.

    The profiles, some hundred rows for each language, come to the driver and go with the
    function; a text is scored in its own row, without a shuffle. Profiles of over PROFILE_ROWS
    rows are an error: so many languages are labels gone wrong.
    """
    rows = profiles.limit(PROFILE_ROWS + 1).collect()
    if len(rows) > PROFILE_ROWS:
        raise ValueError(f"language profiles of over {PROFILE_ROWS} rows; are the labels languages?")
    floors = {r.lang: r.logp for r in rows if not r.gram}
    langs = sorted(floors)
    grams = sorted({_key(r.gram) for r in rows if r.gram})
    keys, place = np.array(grams, np.uint64), {g: k for k, g in enumerate(grams)}
    gain, known = np.zeros((len(langs), len(grams))), np.zeros((len(langs), len(grams)), bool)
    for r in rows:
        if r.gram:
            gain[langs.index(r.lang), place[_key(r.gram)]] = r.logp - floors[r.lang]
            known[langs.index(r.lang), place[_key(r.gram)]] = True

    def scored(texts: list[str | None]) -> list[str]:
        full = ["" if x is None else _padded(x) for x in texts]
        found, row = _trigrams(full)
        if not len(keys) or not len(found):
            return [""] * len(texts)
        size = np.bincount(row, minlength=len(full))
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        at, row = at[hit], row[hit]
        score = np.full((len(langs), len(full)), -np.inf)
        for k, lang in enumerate(langs):
            seen = np.bincount(row, known[k][at], len(full)) > 0
            score[k][seen] = np.round(np.bincount(row, gain[k][at], len(full)) + size * floors[lang], 6)[seen]
        best, some = score.argmax(0), np.isfinite(score).any(0)
        return [langs[b] if s and x is not None else "" for b, s, x in zip(best.tolist(), some.tolist(), texts)]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([x for i in range(0, len(column), ROWS) for x in scored(column.slice(i, ROWS).to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(F.when(F.length(T.strip(c)) >= 3, F.lower(c)))


def detect_language(texts: DataFrame, profiles: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """(key, detected) for each row."""
    return texts.select(key, detected_language(F.col(column), profiles).alias("detected"))


def language_counts(detected: DataFrame) -> DataFrame:
    """(video_id, lang, n, first_idx) of non-blank detections (video_id, idx, detected)."""
    return detected.filter("detected <> ''").groupBy("video_id", F.col("detected").alias("lang")).agg(F.count("*").cast("long").alias("n"), F.min("idx").alias("first_idx"))


def majority_language(detected: DataFrame, input_lang: str = "auto") -> DataFrame:
    """(video_id, video_lang): the stated language, else the most frequent detection (ties: seen first), else 'en'."""
    stated = (input_lang or "").strip().lower().split("-")[0]
    videos = detected.select("video_id").distinct()
    if stated and stated != "auto":
        return videos.select("video_id", F.lit(stated).alias("video_lang"))
    best = language_counts(detected).groupBy("video_id").agg(F.min_by("lang", F.struct(-F.col("n"), "first_idx")).alias("best"))
    return videos.join(best, "video_id", "left").select("video_id", F.coalesce("best", F.lit("en")).alias("video_lang"))


def language_breakdown(detected: DataFrame) -> DataFrame:
    """(video_id, breakdown): 'lang=n' by falling n (ties: seen first), comma-joined."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_idx", F.concat_ws("=", "lang", F.col("n").cast("string")).alias("said"))))
    return language_counts(detected).groupBy("video_id").agg(F.array_join(F.transform(rows, lambda x: x["said"]), ", ").alias("breakdown"))


def fill_language(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Blank detected_lang becomes the video's language (video_id, video_lang)."""
    own = F.when(T.text_or_empty(F.col("detected_lang")) != "", F.col("detected_lang"))
    return segments.join(videos, "video_id", "left").withColumn("detected_lang", F.coalesce(own, "video_lang", F.lit(""))).drop("video_lang")
