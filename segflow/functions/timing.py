"""Scalar functions of times, speeds and durations as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflow import params
from segflow.functions.text import normalize_spaces, strip


def _steps(x: Column) -> Column:
    """How often x (below 2 ** 65) can be halved while it is over 2."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(64)), lambda k: x > F.pow(F.lit(2.0), (k + 1).cast("double"))))


def tempo_chain(speed: Column) -> Column:
    """``atempo`` filters whose factors lie in [0.5, 2] and multiply to ``speed``; speed <= 0 is an error."""
    s = F.when(speed > 0, speed).otherwise(F.raise_error(F.concat(F.lit("bad speed: "), speed.cast("string"))))
    up, down = _steps(s), _steps(1 / s)
    # halving and doubling are exact, so the remainder is that of step-by-step division
    rest = s * F.pow(F.lit(2.0), (down - up).cast("double"))
    chain = F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(rest))
    # as C's %.6f: the exact binary value decides, and only a true tie goes to even; format_string rounds the shortest decimal half up
    fixed = lambda x: F.when(x < 1e9, F.translate(F.format_number(x, 6), ",", "")).otherwise(F.format_string("%.6f", x))
    return F.array_join(F.transform(chain, lambda x: F.concat(F.lit("atempo="), fixed(x))), ",")


def safe_trim(start: Column, end: Column, least: float = params.MIN_TRIM_SEC) -> Column:
    """struct<start, end> of at least ``least`` seconds, not negative."""
    s = F.greatest(F.lit(0.0), start)
    e = F.greatest(s, end)
    return F.struct(s.alias("start"), F.when(e - s < least, s + least).otherwise(e).alias("end"))


def safe_speed(speed: Column) -> Column:
    return F.greatest(F.lit(params.MIN_SPEED), speed)


def target_duration(dur: Column, scale: float = params.DURATION_SCALE) -> Column:
    return F.greatest(dur * scale, F.lit(params.MIN_TARGET_SEC))


def quality_reason(audio_sec: Column, target_sec: Column, text: Column, tolerance: float = params.DURATION_TOLERANCE) -> Column:
    """Null if a synthesised clip passes, else why not: 'empty_text', 'no_audio' or 'duration'."""
    return (
        F.when(strip(text) == "", F.lit("empty_text"))
        .when(F.coalesce(audio_sec, F.lit(0.0)) <= 0, F.lit("no_audio"))
        .when((target_sec > 0) & (F.abs(audio_sec - target_sec) / F.when(target_sec > 0, target_sec) > tolerance), F.lit("duration"))
    )


def tts_eligible(start: Column, end: Column, text_tgt: Column, least: float = params.MIN_SEGMENT_SEC) -> Column:
    return (F.greatest(F.lit(0.0), end - start) >= least) & (normalize_spaces(text_tgt) != "")
