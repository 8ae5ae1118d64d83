"""Scalar functions on the values where engines differ."""

import pytest
from pyspark.sql import functions as F

from segflow import params
from segflow.functions import text as T
from segflow.functions import timing


def values(spark, rows, column, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　"


def test_white_space_is_unicode(spark):
    rows = [f"{SPACES}a{SPACES}b{SPACES}", SPACES, "", None, "x"]
    assert values(spark, rows, T.strip) == [f"a{SPACES}b", "", "", "", "x"]
    assert values(spark, rows, T.normalize_spaces) == ["a b", "", "", "", "x"]
    assert values(spark, rows, T.time_weight) == [2, 1, 1, 1, 1]


def test_languages(spark):
    assert values(spark, ["EN-us", " zh-Hans ", "", None, "xx", "ja"], T.lang_name) == ["English", "Chinese", "Unknown", "Unknown", "Xx", "Japanese"]
    assert values(spark, ["English", " HAITIAN creole", "klingon", "q", "", None], T.lang_name_to_code) == ["en", "ht", "kl", "", "", ""]
    assert values(spark, ["ja", "EN", "fr"], lambda c: T.select_engine(c, F.lit("en-GB"))) == ["cat_translate", "translategemma", "translategemma"]


def test_sentences_and_remarks(spark):
    assert values(spark, ["a.", "b。 ", "c", "d.)", "", None, "e!　"], T.ends_sentence) == [True, True, False, False, False, False, True]
    assert values(spark, ["[music]", " [a] hi [b] ", "[a\nb]", "x [y]", None], T.is_non_speech) == [True, True, False, False, False]
    assert values(spark, ["One. Two!　Three? four", "no", " "], T.sentences) == [["One.", "Two!", "Three?", "four"], ["no"], []]
    assert values(spark, ["7", " 12 ", "x", None, "123"], T.speaker_label) == ["SPEAKER_07", "SPEAKER_12", "SPEAKER_00", "SPEAKER_00", "SPEAKER_123"]


def test_srt_times_round_half_to_even(spark):
    got = values(spark, [0.0005, 0.0015, -3.0, 3661.5, 360000.0], T.srt_timestamp, "double")
    assert got == ["00:00:00,000", "00:00:00,002", "00:00:00,000", "01:01:01,500", "100:00:00,000"]


def test_repeats(spark):
    rows = ["the a the a the a", "xx xx xx", "xx, xx. yy xx", "Xx xx xx", "ありますありますあります", "", None, "aa！aa、aa"]
    assert values(spark, rows, T.is_glitch) == [True, True, False, False, False, False, False, True]
    rows = ["", None, '"a" "A" "a" "a"', "Go. Go. Go. go.", "Go. Go. Go.", '"x" "x"', "a b"]
    assert values(spark, rows, T.is_repetitive_input) == [True, True, True, True, False, False, False]
    assert values(spark, [f" {params.ERROR_MARK} ", "x", None], T.is_error_placeholder) == [True, False, False]


def brute_tempo(x):
    out = []
    while x > 2.0:
        out.append(2.0)
        x /= 2.0
    while x < 0.5:
        out.append(0.5)
        x /= 0.5
    return ",".join(f"atempo={f:.6f}" for f in [*out, x])


def test_tempo_chains(spark):
    speeds = [0.5, 2.0, 4.0, 8.0, 0.25, 0.125, 1e-6, 1.0, 3.3, 0.6703125, 1000.0] + [0.013 * k for k in range(1, 300)]
    assert values(spark, speeds, timing.tempo_chain, "double") == [brute_tempo(x) for x in speeds]
    with pytest.raises(Exception, match="bad speed"):
        values(spark, [0.0], timing.tempo_chain, "double")


def test_trims_and_quality(spark):
    trim = lambda c: timing.safe_trim(c, c + 0.01)
    assert [tuple(r) for r in values(spark, [-1.0, 2.0], trim, "double")] == [(0.0, 0.05), (2.0, 2.05)]
    reason = lambda c: timing.quality_reason(c, F.lit(2.0), F.lit("hi"))
    assert values(spark, [1.0, 3.0, 3.1, 0.0, None], reason, "double") == [None, None, "duration", "no_audio", "no_audio"]
    assert values(spark, ["hi", " "], lambda c: timing.tts_eligible(F.lit(0.0), F.lit(0.35), c)) == [True, False]


def test_names(spark):
    assert values(spark, ["a/b.c/My.Video.mp4", "x", ".hid"], T.stem) == ["My.Video", "x", ".hid"]
    assert values(spark, ["it's"], T.concat_line) == ["file 'it'\\''s'"]
    assert values(spark, ["Irodori", "voxcpm2 ", "zz"], T.normalize_tts_engine) == ["irodori", "voxcpm2", "omnivoice"]
    prompt = values(spark, [" hi "], lambda c: T.gemma_prompt(c, F.lit("fr"), F.lit("ja")))[0]
    assert prompt.startswith("<start_of_turn>user\nYou are a professional French (fr) to Japanese (ja) translator.") and prompt.endswith("Japanese:\n\n\nhi<end_of_turn>\n<start_of_turn>model\n")


def test_control_tokens_of_both_models_go(spark):
    d = spark.createDataFrame([("<start_of_turn>model\n Hallo <end_of_turn>\n", "<|im_start|>Hi<|im_end|> <end_of_turn>"), (None, " ")], "g string, c string")
    got = d.select(T.clean_model_output(F.col("g"), T.GEMMA_TOKENS), T.clean_model_output(F.col("c"), T.CAT_TOKENS)).collect()
    assert [tuple(r) for r in got] == [("model\n Hallo", "Hi <end_of_turn>"), ("", "")]


def near_ties():
    """Speeds of whole milliseconds over 3.2 s and its like: halves in the seventh decimal, a little above or below in binary."""
    return [(a / 1000 + n / 1000 - a / 1000) / (m / 1000) for a in (8895, 7389, 27252, 5) for n in range(1601, 6400, 6) for m in (3200, 640, 1600)]


def test_tempo_near_ties_is_written_as_c_does(spark):
    speeds = near_ties()
    assert values(spark, speeds, timing.tempo_chain, "double") == [brute_tempo(x) for x in speeds]


def test_query_decimals_equal_those_of_sql(spark):
    import duckdb

    from segflow.plans.queries import _r

    rows = [*near_ties(), 0.0, -1.0059375, -0.0000005, 1.7e12, 1700000000.1234565, float("inf"), float("nan"), None]
    got = _r(spark.createDataFrame(list(enumerate(rows)), "i int, x double"), "x").orderBy("i").collect()
    con = duckdb.connect()
    want = [con.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in rows]
    assert [str(r.x) for r in got] == [str(x) for x in want]
