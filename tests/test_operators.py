"""Operators against plain loops over random videos, and on hand-made edges."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.operators import language, ledger, scan, shape, speakers, synth, timeline, translate
from segflow.plans import queries
from segflow.sources import shared

SEGMENTS = "video_id int, idx int, start double, end double, text_src string, speaker_id string, detected_lang string"


def videos(seed, n=12):
    r = random.Random(seed)
    rows = []
    for v in range(n):
        t = 0.0
        for i in range(r.randint(0, 25)):
            t += r.choice([-0.5, 0.0, 0.2, 0.85, 1.0, 1.3])
            d = r.choice([0.0, 0.3, 0.7, 1.5, 6.0])
            text = " ".join(r.choice(["hi", "there.", "you", "ok!", "longer words"]) for _ in range(r.randint(0, 30)))
            rows.append((v, i * 2, round(t, 3), round(t + d, 3), r.choice(["", " 　"]) + text, r.choice(["A", "A", "A", "B"]), r.choice(["", "en", "fr"])))
            t += d
    return rows


def loop(rows, kind):
    out = []
    for v in sorted({r[0] for r in rows}):
        groups = []
        for _, _, a, b, text, who, lang in sorted(r for r in rows if r[0] == v):
            text = " ".join(text.split()) if kind == "units" else text.strip()
            if not text:
                continue
            g = groups[-1] if groups else None
            ok = False
            if g:
                gap, n, dur = max(0.0, a - g["b"]), len(g["t"]) + 1 + len(text), max(0.0, b - g["a"])
                stop = g["t"][-1] in ".!?"
                ok = g["w"] == who and {
                    "merge": gap <= 0.85 and dur <= 12 and n <= 320 and (max(0, g["b"] - g["a"]) <= 0.7 or max(0, b - a) <= 0.7 or not stop),
                    "chunk": gap <= 1.0 and dur <= 18 and n <= 1100,
                    "units": g["c"] < 2 and gap <= 1.2 and n <= 300,
                }[kind]
            if ok:
                g.update(b=b, t=g["t"] + " " + text, l=g["l"] or lang, c=g["c"] + 1)
            else:
                groups.append({"a": a, "b": b, "t": text, "w": who, "l": lang, "c": 1})
        out += [(v, i, g["a"], g["b"], g["t"], g["w"], g["l"]) for i, g in enumerate(groups)]
    return out


@pytest.mark.parametrize("kind,fold", [("merge", shape.merge_segments), ("chunk", shape.chunk_segments), ("units", shape.merge_sentence_units)])
def test_folds_match_a_loop(spark, kind, fold):
    rows = videos(hash(kind) % 1000)
    got = sorted(tuple(r) for r in fold(spark.createDataFrame(rows, SEGMENTS)).collect())
    assert got == loop(rows, kind)


def test_shape_keeps_the_text(spark):
    rows = videos(4)
    units = shape.shape(spark.createDataFrame(rows, SEGMENTS)).collect()
    for v in range(12):
        said = " ".join(" ".join(r[4].split()) for r in sorted(rows) if r[0] == v and r[4].strip())
        assert " ".join(u.text_src for u in sorted(u for u in units if u.video_id == v)) == said


def test_sentence_times(spark):
    rows = [(1, 0, 10.0, 20.0, "Abcd. Ef! Ghij klmn.", "A", ""), (1, 1, 20.0, 20.0, "Two. Parts.", "A", ""), (1, 2, 21.0, 22.0, " ", "A", "")]
    got = [(r.idx, round(r.start, 6), round(r.end, 6), r.text_src) for r in shape.split_sentences(spark.createDataFrame(rows, SEGMENTS)).orderBy("idx").collect()]
    assert got == [(0, 10.0, 12.941176, "Abcd."), (1, 12.941176, 14.705882, "Ef!"), (2, 14.705882, 20.0, "Ghij klmn."), (3, 20.0, 20.0, "Two. Parts.")]


def test_speakers_follow_their_definition(spark):
    """Of a segment's overlaps none is greater than its speaker's; without any, the last speaker holds, or the nearest turn at the start."""
    r = random.Random(7)
    segs, turns = [], []
    for v in range(40):
        far = r.choice([0, 0, 1000])  # several bins of time
        segs += [(v, i, s := round(i * 2 + far * (i % 3) + r.random(), 3), round(s + r.choice([0.5, 1.5, 3.0, 90.0]), 3), "x", "", "") for i in range(r.randint(1, 8))]
        turns += [(v, k, s := round(r.choice([0, far]) + r.uniform(-1, 16), 3), round(s + r.choice([-0.1, 0.0, 0.4, 2.0, 70.0]), 3), r.choice("AB")) for k in range(r.choice([0, 1, 3, 6]))]
    got = speakers.assign_speakers(spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(turns, "video_id int, turn_no int, start double, end double, speaker string"))
    named = {(x.video_id, x.idx): x.speaker_id for x in got.collect()}
    assert named.keys() == {(v, i) for v, i, *_ in segs}
    for v, i, a, b, *_ in segs:
        own = [t for t in turns if t[0] == v]
        shared = {w: round(sum(max(0.0, min(b, y) - max(a, x)) for _, _, x, y, who in own if who == w and y > x), 6) for w in "AB"}
        if max(shared.values()) > 0:
            assert shared[named[v, i]] == max(shared.values())
        elif i:
            before = named[v, i - 1]
            assert named[v, i] == before
        elif own:
            gap = lambda t: min(abs(t[2] - (a + b) / 2), abs(t[3] - (a + b) / 2))  # noqa: B023, E731
            assert named[v, i] in {t[4] for t in own if gap(t) == min(map(gap, own))}
        else:
            assert named[v, i] == "UNKNOWN"


def test_a_long_video_meets_by_bins_of_time(spark):
    segs = spark.range(0, 20_000).selectExpr("1 as video_id", "cast(id as int) as idx", "cast(id * 2 as double) as start", "cast(id * 2 + 1 as double) as end", "'x' as text_src", "'' as speaker_id", "'' as detected_lang")
    turns = segs.selectExpr("video_id", "idx as turn_no", "start - 0.5 as start", "end - 0.5 as end", "if(idx % 2 = 0, 'A', 'B') as speaker")
    assert speakers.assign_speakers(segs, turns).filter("speaker_id <> if(idx % 2 = 0, 'A', 'B')").count() == 0


def test_a_long_island_streams_by(spark):
    """One video without a gap: merging makes groups of ten seconds, as a loop does, across Arrow batches."""
    n = 60_000
    rows = spark.range(n).selectExpr("1 as video_id", "cast(id as int) as idx", "cast(id as double) as start", "id + 0.9d as end", "if(id % 50 = 0, 'Stop.', 'word') as text_src", "'A' as speaker_id", "'' as detected_lang")
    got = shape.merge_segments(rows.repartition(8)).orderBy("idx").collect()
    loose = [(1, i, float(i), i + 0.9, "Stop." if i % 50 == 0 else "word", "A", "") for i in range(n)]
    assert [tuple(r) for r in got] == loop(loose, "merge")


def test_steps_are_counted_as_they_pass(spark):
    segs = spark.createDataFrame(videos(5), SEGMENTS)
    units, seen = shape.observed_shape(segs)
    want = {r.stage: r.n for r in shape.stage_funnel(segs).groupBy("stage").agg(F.sum("n").alias("n")).collect()}
    assert sorted(map(tuple, units.collect())) == sorted(map(tuple, shape.shape(segs).collect()))
    assert {name: o.get["n"] for name, o in seen.items()} == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_values_in_blocks(spark, block):
    r = random.Random(block)
    rows = [(v, None if r.random() < 0.03 else r.randint(-20, 40), k, r.choice([None, float(r.randint(-9, 9))])) for v in (1, 2, None) for k in range(60)]
    d = spark.createDataFrame(rows, "video_id int, idx int, k int, x double")
    got = scan.scan(d, ("idx", "k"), block, place=("count", F.lit(1)), total=("sum", F.col("x")), most=("max", F.col("x")), held=("last", F.col("x")))
    w = Window.partitionBy("video_id").orderBy("idx", "k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = d.select("*", F.row_number().over(w).alias("place"), F.coalesce(F.sum("x").over(before), F.lit(0.0)).alias("total"), F.max("x").over(before).alias("most"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_operators_in_blocks_equal_those_by_video(spark):
    segs = spark.createDataFrame(videos(9), SEGMENTS)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    turns = segs.filter("idx % 6 = 2").selectExpr("video_id", "idx as turn_no", "start", "end", "speaker_id as speaker")
    assert same(speakers.assign_speakers(segs, turns, 4), speakers.assign_speakers(segs, turns))
    assert same(shape.with_segno(segs, 4), shape.with_segno(segs))
    assert same(shape.renumber(segs, "idx", "start", "end", block=4), shape.renumber(segs, "idx", "start", "end"))
    long = segs.groupBy("video_id").agg(F.max("end").alias("video_dur"))
    assert same(timeline.accepted_segments(segs, long, 4), timeline.accepted_segments(segs, long))


def test_folds_of_times_that_are_missing(spark):
    rows = [(1, 0, None, 1.0, "a", "A", ""), (1, 1, 1.0, float("nan"), "b", "A", "en"), (1, 2, 1.0, 1.5, "c", "A", ""), (1, 3, 1.6, 2.0, "d", None, None), (1, 4, 2.1, 2.2, "e", "", "fr"), (None, 0, 0.0, 1.0, "x", "A", ""), (None, 1, 1.0, 2.0, "y", "A", "de")]
    got = {(r.video_id, r.idx): (r.text_src, r.detected_lang) for r in shape.merge_segments(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert got == {(1, 0): ("a", ""), (1, 1): ("b", "en"), (1, 2): ("c", ""), (1, 3): ("d e", "fr"), (None, 0): ("x y", "de")}


def test_chunks_of_a_long_island(spark):
    rows = [(1, i, i * 1.0, i + 0.9, "word" if i % 50 else "Stop.", "A", "") for i in range(3000)]
    got = shape.chunk_segments(spark.createDataFrame(rows, SEGMENTS), max_sec=10.0).orderBy("idx").collect()
    assert [(r.start, r.end) for r in got] == [(k * 10.0, k * 10 + 9.9) for k in range(300)]


def test_references(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 4.0, "A"), (1, 1, 10.0, 17.0, "A"), (1, 2, 20.0, 29.0, "A"), (1, 3, 30.0, 60.0, "B"), (1, 4, 70.0, 71.5, "C"), (1, 5, 80.0, 80.5, "D")], "video_id int, turn_no int, start double, end double, speaker string")
    segs = spark.createDataFrame([(1, 0, 11.0, 12.0, " one ", "A", ""), (1, 1, 16.0, 18.0, "two", "A", ""), (1, 2, 90.0, 91.0, "far", "C", "")], SEGMENTS)
    got = {r.speaker_id: (r.ref_start, r.ref_end, r.prompt_text) for r in speakers.speaker_refs(turns, segs).collect()}
    assert got == {"A": (10.0, 17.0, "one two"), "B": (30.0, 45.0, "two"), "C": (70.0, 71.5, "far")}
    said = spark.createDataFrame([(1, "A", "heard"), (1, "B", " ")], "video_id int, speaker_id string, transcript string")
    assert {r.speaker_id: r.prompt_text for r in speakers.speaker_refs(turns, segs, said).collect()} == {"A": "heard", "B": "two", "C": "far"}


# segments (start, end), clips {segno: seconds}, length of the video, and the parts worked out by hand:
# kind, from, to, seconds on the new timeline, speed, segno
PARTS = [
    ([(1, 2), (3, 4)], {1: 0.5}, 5, [("gap", 0, 1, 1, 1, 0), ("speech", 1, 2, 0.5, 2, 1), ("gap", 2, 3, 1, 1, 0), ("speech", 3, 4, 1, 1, 2), ("tail", 4, 5, 1, 1, 0)]),
    ([(0.1, 1.1)], {}, 1.2, [("speech", 0, 1.2, 1, 1.2, 1)]),  # a short gap and a short tail belong to the speech
    ([(0.1, 1.1)], {1: 2.0}, 2.1, [("speech", 0, 1.1, 2, 0.55, 1), ("tail", 1.1, 2.1, 1, 1, 0)]),
    ([(0.15, 1.15)], {}, 1.31, [("gap", 0, 0.15, 0.15, 1, 0), ("speech", 0.15, 1.15, 1, 1, 1), ("tail", 1.15, 1.31, 0.16, 1, 0)]),  # at the limit it stays
    ([(0, 2), (1, 3)], {}, 3, [("speech", 0, 2, 2, 1, 1), ("speech", 1, 3, 2, 1, 2)]),  # overlapping speech is played again
    ([(0, 3), (1, 2)], {2: 9.0}, 3, [("speech", 0, 3, 3, 1, 1)]),  # nothing new in the second
    ([(-1, 0.5)], {1: 0.0}, 1, [("speech", 0, 0.5, 0.5, 1, 1), ("tail", 0.5, 1, 0.5, 1, 0)]),  # an empty clip is none
    ([(0, 0.5), (2, 3)], {}, 1, [("speech", 0, 0.5, 0.5, 1, 1), ("gap", 0.5, 1, 0.5, 1, 0), ("speech", 1, 1, 0.001, 1, 2)]),  # past the end
    ([], {}, 2, [("tail", 0, 2, 2, 1, 0)]),
    ([(0, 1)], {}, 0, []),
]


def laid_out(spark, cases):
    segs = [(v, i, float(a), float(b), "x", "", "") for v, (own, *_) in enumerate(cases) for i, (a, b) in enumerate(own)]
    meta = [(v, k, "f", d) for v, (_, have, _) in enumerate(cases) for k, d in have.items()]
    durs = [(v, float(vd)) for v, (*_, vd) in enumerate(cases)]
    got = timeline.layout(spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(meta, "video_id int, segno int, flac_path string, duration_sec double"), spark.createDataFrame(durs, "video_id int, video_dur double"))
    out = {v: [] for v in range(len(cases))}
    for x in got.orderBy("video_id", "part_no").collect():
        out[x.video_id].append((x.kind, x.orig_start, x.orig_end, x.out_duration, x.speed, x.segno))
    return out


def test_parts_worked_out_by_hand(spark):
    got = laid_out(spark, [c[:3] for c in PARTS])
    for v, (*_, want) in enumerate(PARTS):
        assert [p[0] for p in got[v]] == [p[0] for p in want] and [p[5] for p in got[v]] == [p[5] for p in want], v
        for p, q in zip(got[v], want):
            assert p[1:5] == pytest.approx(q[1:5], abs=1e-6), v


def test_parts_tile_the_video(spark):
    """Without overlaps the parts follow each other from 0 to the end, none is a short silence beside speech, and speeds are lengths by lengths."""
    r = random.Random(11)
    cases = []
    for _ in range(60):
        t, own = 0.0, []
        for _ in range(r.randint(0, 8)):
            t += r.choice([0.0, 0.05, 0.15, 0.149, 0.5])
            own.append((round(t, 3), round(t + r.choice([0.0, 0.4, 2.0]), 3)))
            t = own[-1][1]
        cases.append((own, {k: r.choice([0.5, 1.7]) for k in range(1, len(own) + 1) if r.random() < 0.7}, round(max(0.0, t + r.choice([0.0, 0.1, 0.15, 3.0])), 3)))
    for v, parts in laid_out(spark, cases).items():
        own, have, vd = cases[v]
        assert bool(parts) == (vd > 0)
        ends = [0.0, *(p[2] for p in parts)]
        assert [p[1] for p in parts] == pytest.approx(ends[:-1], abs=2e-6) and (not parts or ends[-1] == pytest.approx(vd, abs=2e-6))
        speech = [p for p in parts if p[0] == "speech"]
        assert [p[5] for p in speech] == sorted({p[5] for p in speech})
        for kind, a, b, out, speed, no in parts:
            if kind == "speech":
                assert out == pytest.approx(have.get(no) or max(0.001, own[no - 1][1] - own[no - 1][0])) and speed == pytest.approx(max(0.001, b - a) / out)
            else:
                assert (b - a >= 0.15 - 1e-9 or not speech) and out == pytest.approx(b - a) and speed == 1 and no == 0


def test_languages_by_vote(spark):
    det = spark.createDataFrame([(1, 0, "fr"), (1, 1, "en"), (1, 2, "en"), (1, 3, "fr"), (2, 0, "")], "video_id int, idx int, detected string")
    assert {r.video_id: r.video_lang for r in language.majority_language(det).collect()} == {1: "fr", 2: "en"}
    assert {r.video_lang for r in language.majority_language(det, "DE-at").collect()} == {"de"}
    assert [r.breakdown for r in language.language_breakdown(det).collect()] == ["fr=2, en=2"]


def test_language_detection_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    train, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and length(text) > 100")
    got = language.detect_language(rest, language.train_profiles(train), "doc_id").join(rest, "doc_id")
    assert got.filter("detected = lang").count() >= 0.95 * got.count()
    short = spark.createDataFrame([(1, "ab"), (2, None), (3, " ")], "doc_id int, text string")
    assert {r.detected for r in language.detect_language(short, language.train_profiles(train), "doc_id").collect()} == {""}


def test_labels_that_are_no_languages_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(f"text number {i}", f"l{i}") for i in range(40)], "text string, lang string")
    profiles = language.train_profiles(docs)
    monkeypatch.setattr(language, "PROFILE_ROWS", profiles.count() - 1)
    with pytest.raises(ValueError, match="labels"):
        language.detected_language(F.col("text"), profiles)


def test_translation_states(spark):
    long = "Say it. " * 3 + "End. " * 500
    rows = [(1, 1, "hello", "", "en"), (1, 2, "hello", "done", "en"), (1, 3, "hello", params.ERROR_MARK, "en"), (1, 4, "x. X. x. x.", "", "en"), (1, 5, "make glitch", "", ""), (1, 6, " ", "", "en"), (1, 7, "One two. " + "Word goes on. Other words. " * 100, "", "en")]
    s = spark.createDataFrame(rows, "video_id int, segno int, text_src string, text_tgt string, detected_lang string")
    body = lambda c: F.when(c.contains("glitch"), F.lit("no no no")).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    got = {r.segno: r.text_tgt for r in translate.translate_segments(s, translate.column_translator(body)).collect()}
    assert got[1] == "<hello>" and got[2] == "done" and got[3] == "<hello>" and got[4] == params.REPETITIVE_INPUT_MARK and got[5] == params.ERROR_MARK and got[6] == ""
    assert got[7].startswith("<One two.> <Word goes on.> <Other words.>") and long


def test_model_translator_retries(spark, tmp_path):
    def load(engine):
        calls = []

        def model(text, source, target):
            calls.append(text)
            if len(calls) == 1:
                raise RuntimeError("warming up")
            return f"{engine}:{text}"

        return model

    s = spark.createDataFrame([(1, 1, "hallo", "", "fr"), (1, 2, "hi", "", "en")], "video_id int, segno int, text_src string, text_tgt string, detected_lang string")
    got = {r.segno: r.text_tgt for r in translate.translate_segments(s, translate.model_translator(load, backoff_sec=0.0)).collect()}
    assert got == {1: "translategemma:hallo", 2: "cat_translate:hi"}


def test_a_failing_text_stops_no_other(spark):
    def load(engine):
        def model(text, source, target):
            if "bad" in text:
                raise RuntimeError("no words")
            return text.upper()

        return model

    s = spark.createDataFrame([(1, 1, "good", "", "en"), (1, 2, "bad", "", "en"), (2, 1, "fine", "", "en"), (3, 1, "bad luck", "old old old", "en")], "video_id int, segno int, text_src string, text_tgt string, detected_lang string")
    out = translate.translate_segments(s, translate.model_translator(load, backoff_sec=0.0))
    got = {(r.video_id, r.segno): (r.text_tgt, r.error) for r in out.collect()}
    assert got == {(1, 1): ("GOOD", None), (1, 2): ("", "RuntimeError: no words"), (2, 1): ("FINE", None), (3, 1): ("old old old", "RuntimeError: no words")}
    files = spark.createDataFrame([("4", "not a list"), ("5", None)], "video_id string, error string")
    errors = ledger.video_errors(out, files)
    assert sorted(map(tuple, errors.collect())) == [("1", "RuntimeError: no words"), ("3", "RuntimeError: no words"), ("4", "not a list")]


def test_models_are_called_by_batches(spark, tmp_path):
    """Texts alike in length go together; a batch that fails is tried text by text, and only what fails alone has an error."""
    log = str(tmp_path / "calls")

    def load(engine):
        def model(texts, source, target):
            with open(log, "a") as f:
                f.write(f"{len(texts)} {max(map(len, texts)) * len(texts)}\n")
            if any("bad" in x for x in texts):
                raise RuntimeError("boom")
            return [f"{source}-{target}:{x}" for x in texts if x != "odd"]

        return model

    texts = [f"t{i} " + "x" * (i * 7 % 300) for i in range(400)] + ["bad one", "odd", ""]
    asked = spark.createDataFrame([(x, s, "ja", "e" + s) for x in texts for s in ("en", "fr")], "text string, source string, target string, engine string")
    got = {(r.text, r.source): (r.out, r.error) for r in translate.batch_translator(load, retries=2, backoff_sec=0, partitions=2, budget=4000, most=32)(asked).collect()}
    assert len(got) == 2 * len(texts)
    for (text, source), (out, error) in got.items():
        want = "RuntimeError: boom" if text == "bad one" else "ValueError: 0 answers to 1 texts" if text == "odd" else None
        assert error == want and out == (None if want else f"{source}-ja:{text}")
    calls = [tuple(map(int, line.split())) for line in open(log)]
    whole = [c for c in calls if c[0] > 1]
    assert all(n <= 32 and size <= 4000 for n, size in whole)
    assert len(whole) <= 2 * len(texts) / 8


def test_source_language_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = language.train_profiles(docs)
    told = docs.filter("lang = 'de' and length(text) > 300").first()
    rows = [(1, 1, "hello", "", "fr"), (1, 2, "hello", "", ""), (2, 1, told.text, "", None), (2, 2, "", "", "")]
    s = spark.createDataFrame(rows, "video_id int, segno int, text_src string, text_tgt string, detected_lang string")
    videos = spark.createDataFrame([(1, "es"), (2, "")], "video_id int, video_lang string")
    chain = lambda *a: {(r.video_id, r.segno): r.source for r in translate.source_language(s, *a).collect()}
    assert chain() == {(1, 1): "fr", (1, 2): "en", (2, 1): "en", (2, 2): "en"}
    assert chain(videos, profiles) == {(1, 1): "fr", (1, 2): "es", (2, 1): "de", (2, 2): "en"}


def test_long_texts_are_split_past_the_limit(spark):
    s = spark.createDataFrame([(1, "A b. " * 400 + "x" * 0), (2, "A b. " * 399 + "A bcd."), (3, "x" * 2001)], "doc_id int, text_src string")
    n = {r.doc_id: r["count"] for r in translate.split_long_text(s, ["doc_id"]).groupBy("doc_id").count().collect()}
    assert [len(x) for x in ("A b. " * 399 + "A b.", "A b. " * 399 + "A bcd.")] == [1999, 2001] and n == {1: 1, 2: 400, 3: 1}


def test_reconciled_attempts(spark):
    plan = spark.createDataFrame([(1, k, "hi", 2.0) for k in (1, 2, 3)], "video_id int, segno int, text string, target_sec double")
    tries = spark.createDataFrame([(1, 1, 1, "a", 9.0), (1, 1, 2, "b", 2.1), (1, 2, 1, "a", 9.0), (1, 2, 2, "b", 8.0), (1, 2, 3, "c", 2.0), (1, 3, 1, "a", 0.0)], "video_id int, segno int, attempt int, flac_path string, duration_sec double")
    got = {r.segno: (r.flac_path, r.attempts, r.quality_reason) for r in synth.reconcile(plan, tries).collect()}
    assert got == {1: ("b", 2, None), 2: ("b", 2, "duration")}


def test_without_a_check_the_first_attempt_counts(spark):
    plan = spark.createDataFrame([("v", 1, "hi", 1.0), ("v", 2, "", 1.0), ("v", 3, "x", 1.0)], "video_id string, segno int, text string, target_sec double")
    tries = spark.createDataFrame([("v", 1, 1, "a", 9.0), ("v", 1, 2, "b", 1.0), ("v", 2, 1, "c", 1.0), ("v", 3, 1, "d", 0.0), ("v", 3, 2, "e", 1.0)], "video_id string, segno int, attempt int, flac_path string, duration_sec double")
    got = {r.segno: (r.flac_path, r.attempts, r.quality_reason) for r in synth.reconcile(plan, tries, check=False).collect()}
    assert got == {1: ("a", 1, None), 2: ("c", 1, None)}


def test_ledger_entries(spark):
    docs = spark.createDataFrame([("1", {"a": "x", "b": "y"}), ("2", None)], "video_id string, steps map<string,string>")
    new = spark.createDataFrame([("1", {"b": "z", "c": "w"}), ("2", {"q": "r"})], "video_id string, entries map<string,string>")
    assert {r.video_id: r.steps for r in ledger.set_entries(docs, new, "steps").collect()} == {"1": {"a": "x", "b": "z", "c": "w"}, "2": {"q": "r"}}


def test_every_failure_is_listed(spark):
    results = spark.range(3000).select(F.col("id").cast("string").alias("video_id"), F.when(F.col("id") % 2 == 0, F.lit("decode")).alias("error"))
    assert [tuple(r) for r in ledger.batch_outcome(results).collect()] == [(3000, 1500)]
    assert sorted((int(r.video_id), r.error) for r in ledger.failed_videos(results).collect()) == [(i, "decode") for i in range(0, 3000, 2)]
    assert ledger.failed_videos(results.limit(0)).collect() == []


def test_case_grid(spark):
    rows = ledger.case_grid(spark).orderBy("case_no").collect()
    assert len(rows) == 12 and rows[0].case_id == "asr-vibevoice__audio-separated__tts-omnivoice" and rows[11].case_id == "asr-whisper__audio-rawaudio__tts-irodori"


def test_chunks_tile_the_media(spark):
    m = spark.createDataFrame([(1, 480.0), (2, 480.5), (3, 1500.25)], "video_id int, video_dur double")
    got = {}
    for r in shape.plan_chunks(m).orderBy("video_id", "chunk_no").collect():
        got.setdefault(r.video_id, []).append((r.start_sec, r.end_sec))
    assert got == {1: [(0.0, 480.0)], 2: [(0.0, 480.0), (480.0, 480.5)], 3: [(0.0, 480.0), (480.0, 960.0), (960.0, 1440.0), (1440.0, 1500.25)]}


def tables_staged(query, spark, sf):
    """The columns of each table that a query stages."""
    kept, write = [], shared.stage

    def stage(df, label):
        kept.append(set(df.columns))
        return write(df, label)

    with pytest.MonkeyPatch.context() as m:
        for module in (shared, scan, speakers, queries):
            m.setattr(module, "stage", stage, raising=False)
        query(spark, sf)
    return kept


def test_cursor_in_blocks_stages_times_once(spark, sf):
    assert tables_staged(queries.w3_blocked_cursor, spark, sf) == [{"video_id", "idx", "start", "end"}]
    assert tables_staged(queries.w8_blocked_places, spark, sf) == [{"video_id", "idx"}]


def test_a_scan_exchanges_its_rows_once(spark, tmp_path):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "video_id string, idx long, x double")
    d.write.parquet(f"{tmp_path}/rows")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = scan.scan(spark.read.parquet(f"{tmp_path}/rows"), ("idx",), 7, most=("max", F.col("x")))
        # rows by block; totals by block, by video, and by block again
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        assert {(r.idx, r.most) for r in got.collect()} == {(i, float(i - 1) if i else None) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_cursor_in_blocks_on_odd_times(spark):
    r = random.Random(4)
    odd = [None, float("nan"), float("inf"), -3.0]
    rows = [(v, i * 3, *(r.choice(odd) if r.random() < 0.1 else i + r.random() * 4 for _ in "ab")) for v in ("a", "b", "c", "d", None) for i in range(40)]
    segs = spark.createDataFrame(rows, "video_id string, idx long, start double, end double")
    long = spark.createDataFrame([("a", 30.0), ("b", None), ("c", -2.0), (None, 9.0), ("e", 5.0)], "video_id string, video_dur double")
    got, want = timeline.accepted_segments(segs, long, 4), timeline.accepted_segments(segs, long)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_speakers_in_blocks_stage_no_text(spark, sf):
    assert tables_staged(queries.w1_blocked_speakers, spark, sf) == [{"video_id", "idx", "start", "end", "speaker_id"}, {"video_id", "idx", "best"}]


def test_speakers_in_blocks_on_odd_rows(spark):
    rows = [(v, i * 2 if i else None, i * 1.0, i + 0.9, f"t{i}", "X") for v in ("a", "b", "c", "d", None) for i in range(30)]
    segs = spark.createDataFrame(rows, "video_id string, idx long, start double, end double, text_src string, speaker_id string")
    turns = [("a", 0, 5.0, 5.5, "A"), ("a", 1, 12.0, 12.5, None), ("a", 2, 20.0, 20.5, "B"), ("b", 0, 90.0, 91.0, "C"), ("b", 1, 60.0, 61.0, "D"), ("c", 0, 1.0, 2.0, None), ("c", 1, 0.0, 0.5, "E"), (None, 0, 3.0, 4.0, "F")]
    turns = spark.createDataFrame(turns, "video_id string, turn_no int, start double, end double, speaker string")
    got, want = speakers.assign_speakers(segs, turns, 4), speakers.assign_speakers(segs, turns)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_placement_in_blocks_numbers_and_places_in_one_pass(spark, sf):
    assert tables_staged(queries.w6_blocked_placement, spark, sf) == [{"video_id", "idx", "out_duration"}]
    parts = spark.createDataFrame([(v, i * 5, float(i % 7)) for v in ("a", "b") for i in range(40)], "video_id string, idx long, out_duration double")
    got = timeline.place(parts, 4, ("idx",))
    assert sorted(map(tuple, got.select("video_id", "part_no", "out_start").collect())) == sorted((v, i + 1, float(sum(k % 7 for k in range(i)))) for v in ("a", "b") for i in range(40))
    assert sorted(map(str, timeline.place(parts, None, ("idx",)).select("video_id", "part_no", "out_start").collect())) == sorted(map(str, got.select("video_id", F.col("part_no").cast("long").alias("part_no"), "out_start").collect()))
