"""Scalar text functions as Columns.

White space is Unicode white space plus U+001C-U+001F. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflow import params
from segflow.functions.languages import NAME_OF_CODE, CODE_OF_NAME

_WS = r"[\s\x1c-\x1f]"
# The same characters one by one.
_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_CUT = rf"(?U)(?<=[.!?]){_WS}+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(text_or_empty(c), F.lit(_WS_CHARS))


def normalize_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"(?U){_WS}+", " ")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end - start)


def normalize_lang_code(c: Column) -> Column:
    return F.substring_index(F.lower(strip(c)), "-", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A lookup in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def lang_name(c: Column) -> Column:
    """English name of a language code; an unknown code in title case; none: 'Unknown'."""
    code = normalize_lang_code(c)
    return F.coalesce(_lookup(NAME_OF_CODE, code), F.when(code == "", F.lit("Unknown")).otherwise(F.initcap(code)))


def lang_name_to_code(c: Column) -> Column:
    """Code of a language's full name; of an unknown one its first two characters, if it has two."""
    name = F.lower(strip(c))
    return F.coalesce(_lookup(CODE_OF_NAME, name), F.when(F.length(name) >= 2, F.substring(name, 1, 2)).otherwise(F.lit("")))


def is_ja_en_pair(source: Column, target: Column) -> Column:
    s, t = normalize_lang_code(source), normalize_lang_code(target)
    return ((s == "ja") & (t == "en")) | ((s == "en") & (t == "ja"))


def select_engine(source: Column, target: Column) -> Column:
    return F.when(is_ja_en_pair(source, target), F.lit("cat_translate")).otherwise(F.lit("translategemma"))


def ends_sentence(c: Column) -> Column:
    return strip(c).rlike(r"[.!?。！？]\z")


def is_non_speech(c: Column) -> Column:
    """One bracketed remark on one line, such as [music]."""
    return strip(c).rlike(r"(?d)\A\[.*\]\z")


def speaker_label(c: Column) -> Column:
    return F.format_string("SPEAKER_%02d", F.coalesce(F.expr("cast(null as int)") if c is None else c.try_cast("int"), F.lit(0)))


def srt_timestamp(sec: Column) -> Column:
    """HH:MM:SS,mmm; negative: 0; milliseconds round half to even."""
    ms = F.rint(F.greatest(sec, F.lit(0.0)) * 1000.0).cast("long")
    part = lambda unit, most: F.pmod(F.floor(ms / unit), F.lit(most)).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)).cast("int"))


def time_weight(c: Column, least: int = params.MIN_WEIGHT) -> Column:
    return F.greatest(F.lit(least), F.length(F.regexp_replace(text_or_empty(c), rf"(?U){_WS}+", "")))


def has_consecutive_repeats(items: Column, n: int) -> Column:
    """Whether some element of an array (bound once: it is used often) occurs n times or more in a row."""
    same = lambda i: F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.get(items, i).eqNullSafe(F.get(items, i + k)))
    return F.when(F.size(items) >= n, F.lit(n < 2) | F.exists(F.sequence(F.lit(0), F.size(items) - n), same)).otherwise(F.lit(False))


def is_glitch(c: Column, n: int = params.OUTPUT_REPEATS) -> Column:
    """A phrase of two characters or more that comes n times in a row."""
    phrases = F.filter(F.split(strip(c), rf"(?U)[。、！？!?,.\s\x1c-\x1f]+"), lambda x: F.length(x) >= 2)  # no phrase holds white space
    return let(phrases, lambda p: has_consecutive_repeats(p, n))


def sentences(c: Column) -> Column:
    """Non-blank sentences, stripped: cut at white space after . ! or ?"""
    return F.filter(F.split(strip(c), SENTENCE_CUT), lambda x: x != "")


def is_repetitive_input(c: Column, n: int = params.INPUT_REPEATS) -> Column:
    """Blank, or the same quoted phrase (or, without quotes, sentence) n times in a row."""
    quoted = lambda t: F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1))
    lower = lambda p: F.transform(p, lambda x: F.lower(strip(x)))
    again = lambda p: (F.size(p) > 2) & let(F.when(F.size(p) >= n, lower(p)).otherwise(F.array().cast("array<string>")), lambda q: has_consecutive_repeats(q, n))
    judged = lambda t: (t == "") | let(let(F.when(t.contains('"'), quoted(t)).otherwise(F.array().cast("array<string>")), lambda q: F.when(F.size(q) > 0, q).otherwise(sentences(t))), again)
    return let(strip(c), judged)


def is_error_placeholder(c: Column) -> Column:
    return strip(c).isin(params.ERROR_MARK, params.REPETITIVE_INPUT_MARK, params.REPETITIVE_PART_MARK)


def cat_prompt(text: Column, source: Column, target: Column) -> Column:
    s, t = normalize_lang_code(source), normalize_lang_code(target)
    ask = (
        F.when((s == "en") & (t == "ja"), F.lit("Translate the following English text into Japanese.\n\n"))
        .when((s == "ja") & (t == "en"), F.lit("Translate the following Japanese text into English.\n\n"))
        .otherwise(F.lit("Translate the following text.\n\n"))
    )
    # fixed value: the model's chat template
    return F.concat(F.lit("<s><|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n"), ask, strip(text), F.lit("<|im_end|>\n<|im_start|>assistant\n"))


# Fixed value: the model's instruction; S and T are the languages' names, s and t their codes.
_GEMMA = (
    "You are a professional {S} ({s}) to {T} ({t}) translator. Your goal is to accurately convey the meaning and nuances of the original {S} text "
    "while adhering to {T} grammar, vocabulary, and cultural sensitivities.\n"
    "Produce only the {T} translation, without any additional explanations or commentary. Please translate the following {S} text into {T}:\n\n\n"
)


def gemma_prompt(text: Column, source: Column, target: Column) -> Column:
    values = {"S": lang_name(source), "T": lang_name(target), "s": text_or_empty(source), "t": text_or_empty(target)}
    parts: list[Column] = [F.lit("<start_of_turn>user\n")]
    for k, piece in enumerate(_GEMMA.replace("}", "{").split("{")):
        parts.append(values[piece] if k % 2 else F.lit(piece))
    return F.concat(*parts, strip(text), F.lit("<end_of_turn>\n<start_of_turn>model\n"))


# Control tokens that models may leave in their output.
CAT_TOKENS, GEMMA_TOKENS = ("<|im_end|>", "<|im_start|>"), ("<end_of_turn>", "<start_of_turn>")


def clean_model_output(text: Column, tokens: tuple[str, ...]) -> Column:
    out = text_or_empty(text)
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(""))
    return strip(out)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)(?<=.)\.[^.]*\z", "")


def output_name(path: Column, suffix: str = params.OUTPUT_SUFFIX) -> Column:
    return F.concat(stem(path), F.lit(suffix))


def work_partition(path: Column, separated: Column) -> Column:
    """Results with and without audio separation never share a partition."""
    return F.concat(stem(path), F.when(separated, F.lit("")).otherwise(F.lit("_rawaudio")))


def normalize_tts_engine(c: Column) -> Column:
    name = F.lower(strip(c))
    return F.when(name == "voxcpm2", name).when(name.isin("irodori", "irodori-tts", "irodori_tts"), F.lit("irodori")).otherwise(F.lit("omnivoice"))


def concat_line(path: Column) -> Column:
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def pair_error(engine: Column, target: Column) -> Column:
    """Null for a valid pair: one engine speaks Japanese only."""
    return F.when((normalize_tts_engine(engine) == "irodori") & (target != "ja"), F.concat(F.lit("irodori speaks ja only, not "), target))


def case_id(asr: Column, separated: Column, tts: Column) -> Column:
    mode = F.when(separated == "true", F.lit("separated")).otherwise(F.lit("rawaudio"))
    return F.format_string("asr-%s__audio-%s__tts-%s", asr, mode, tts)


def synthesis_request(text: Column, ref_wav: Column, model: str = "irodori-tts", response_format: str = "wav", speed: float = 1.0, num_steps: int = 8, mode: str = "sway", coeff: float = -1.0) -> Column:
    """The request body of a synthesis server, as JSON."""
    inner = F.struct(ref_wav.alias("ref_wav"), F.lit(num_steps).alias("num_steps"), F.lit(mode).alias("t_schedule_mode"), F.lit(coeff).alias("sway_coeff"))
    return F.to_json(F.struct(F.lit(model).alias("model"), text.alias("input"), F.lit(response_format).alias("response_format"), F.lit(speed).alias("speed"), inner.alias("irodori")))
