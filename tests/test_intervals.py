"""Interval joins against all pairs, at any length of interval."""

import math
import random

import pytest
from pyspark.sql import functions as F

from segflow.operators import intervals, speakers

A, B = "video_id int, i int, a0 double, a1 double", "video_id int, j int, b0 double, b1 double"
ENDS = [0.0, 0.5, 30.0, 59.9, 60.0, 60.1, 480.0, 481.0, 3600.0, 86_400.0, 1.7e9, 1.7e12, 1e15, 2e15, 1e300, math.inf]


def table(seed, n, videos):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = r.choice([0.0, 59.0, 60.0, -30.0, 1000.0, 1e6, 1.7e9, -math.inf, math.nan, None, r.uniform(0, 5000)])
        end = r.choice([math.nan, None, math.inf, -5.0]) if r.random() < 0.1 else None if start is None else start + r.choice(ENDS)
        rows.append((r.randrange(videos), k, start, end))
    return rows


def brute(a, b):
    whole = lambda x: x[2] is not None and x[3] is not None and x[3] > x[2]  # noqa: E731 - false for NaN
    return sorted((i, j) for v, i, s, e in filter(whole, a) for w, j, t, f in b if v == w and whole((w, j, t, f)) and min(e, f) > max(s, t))


@pytest.mark.parametrize("bin_sec,factor", [(60.0, 8), (1.0, 2)])
def test_pairs_of_any_length(spark, bin_sec, factor):
    a, b = table(1, 500, 3), table(2, 400, 3)
    got = intervals.overlapping(spark.createDataFrame(a, A), spark.createDataFrame(b, B), bin_sec, factor)
    assert got.columns == ["video_id", "i", "a0", "a1", "j", "b0", "b1"]
    assert sorted((r.i, r.j) for r in got.collect()) == brute(a, b)


def test_no_rows(spark):
    a, b = spark.createDataFrame([], A), spark.createDataFrame([(1, 1, 0.0, 1.0)], B)
    assert intervals.overlapping(a, b).count() == intervals.overlapping(b.toDF("video_id", "j", "a0", "a1"), a.toDF("video_id", "i", "b0", "b1")).count() == 0


def test_one_endless_segment_beside_a_thousand_videos(spark):
    """Rows of the join stay few, and the results are those of all pairs."""
    r = random.Random(3)
    a = [(v, 10 * v + k, t := r.uniform(0, 900), t + r.uniform(0.1, 9)) for v in range(1000) for k in range(3)]
    b = [(v, 10 * v + k, t := r.uniform(0, 900), t + r.uniform(0.1, 90)) for v in range(1000) for k in range(3)]
    a += [(0, -1, 0.0, math.inf), (1, -2, 5.0, 1e12), (2, -3, 5.0, 6e8)]
    left, right = spark.createDataFrame(a, A), spark.createDataFrame(b, B)
    assert sorted((x.i, x.j) for x in intervals.overlapping(left, right).collect()) == brute(a, b)
    own = left.withColumn("__own", intervals._own_level("a0", "a1", 60.0, 8))
    used = [x[0] for x in own.select("__own").distinct().collect()]
    assert intervals._spread(own, "a0", "a1", F.lit(sum(1 << k for k in used)), False, 60.0, 8).count() <= 2 * len(used) * len(a)


def test_speakers_and_references_of_endless_segments(spark):
    segs = spark.createDataFrame([("v", 0, 0.0, math.inf, "one"), ("v", 1, 5.0, math.nan, "two"), ("v", 2, 2.0, 1.7e12, "three"), ("w", 0, math.nan, 1.0, "four")], "video_id string, idx int, start double, end double, text_src string")
    segs = segs.withColumns({c: F.lit("") for c in ("text_tgt", "speaker_id", "detected_lang")})
    turns = spark.createDataFrame([("v", 0, 0.0, 4.0, "A"), ("v", 1, 4.0, math.inf, "B"), ("v", 2, 9.0, math.nan, "C"), ("w", 0, 8.0, 9.0, "D")], "video_id string, turn_no int, start double, end double, speaker string")
    named = {(r.video_id, r.idx): r.speaker_id for r in speakers.assign_speakers(segs, turns).collect()}
    assert named == {("v", 0): "B", ("v", 1): "B", ("v", 2): "B", ("w", 0): "D"}
    refs = {(r.video_id, r.speaker_id): (r.ref_start, r.ref_end, r.prompt_text) for r in speakers.speaker_refs(turns, segs).collect()}
    assert refs == {("v", "A"): (0.0, 4.0, "one three"), ("v", "B"): (4.0, 19.0, "one three"), ("w", "D"): (8.0, 9.0, "four")}
