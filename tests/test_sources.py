"""Readers and writers on files, and resumed runs."""

import json
import math
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segflow.operators import ledger, shape
from segflow.plans import queries
from segflow.sources import io, keyed, ledger_log, tables
from segflow.streaming import resume


def test_media_scan(spark, tmp_path):
    for name in ("b/x.MP4", "a.mkv", "c.txt", "d.webm.part"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"123")
    got = io.scan_media(spark, str(tmp_path / "in"))
    assert [(r.video_id, r.size) for r in got.collect()] == [("a", 3), ("x", 3)]
    assert io.scan_media(spark, str(tmp_path / "none")).collect() == []


def test_whisper_files(spark, tmp_path):
    doc = {"result": {"language": "german"}, "transcription": [{"offsets": {"from": 0, "to": 1500}, "text": " Hallo "}, {"offsets": {"from": 5, "to": 5}, "text": "x"}, {"offsets": {"from": 1500, "to": 2000}, "text": " "}, {"offsets": {"from": "2000", "to": 2500.0}, "text": "du"}]}
    (tmp_path / "v1.json").write_text(json.dumps(doc, indent=1))
    got = [(r.video_id, r.idx, r.start, r.end, r.text_src, r.detected_lang) for r in io.read_whisper_json(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [("v1", 0, 0.0, 1.5, "Hallo", "de"), ("v1", 1, 2.0, 2.5, "du", "de")]


def test_stored_segments(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps([{"idx": 5, "start": 1, "end": 2.5, "text_src": "a", "speaker_id": "S"}, "junk", {"text_en": "b", "text_src": "", "text_ja": "c"}]))
    got = [(r.idx, r.start, r.end, r.text_src, r.text_tgt, r.speaker_id, r.detected_lang) for r in io.read_segments(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == [(2, 0.0, 0.0, "b", "c", "", ""), (5, 1.0, 2.5, "a", "", "S", "")]
    (tmp_path / "bad.json").write_text("{}")
    (tmp_path / "quoted.json").write_text(json.dumps([{"idx": "7", "start": "1.5", "end": 2, "text_src": "q"}, {"idx": 3.0, "start": None, "end": "x", "text_src": "r"}]))
    got = {r.text_src: (r.video_id, r.idx, r.start, r.end) for r in io.read_segments(spark, str(tmp_path)).collect()}
    assert got == {"a": ("v", 5, 1.0, 2.5), "b": ("v", 2, 0.0, 0.0), "q": ("quoted", 7, 1.5, 2.0), "r": ("quoted", 3, 0.0, 0.0)}
    assert [tuple(r) for r in io.document_errors(keyed.read_documents(spark, str(tmp_path))).collect()] == [("bad", "not a list")]


def test_srt(spark, tmp_path):
    rows = [("v", 0, 0.0, 1.0, " hi \n you ", "", "", ""), ("v", 1, 3.0, 2.0, "x", "", "", ""), ("v", 2, 4.0, 5.0, " ", "", "", ""), ("w", 0, 0.0, 1.0, "", "", "", "")]
    s = spark.createDataFrame(rows, "video_id string, idx int, start double, end double, text_src string, text_tgt string, speaker_id string, detected_lang string")
    want = "1\n00:00:00,000 --> 00:00:01,000\nhi you\n\n2\n00:00:03,000 --> 00:00:03,000\nx\n"
    assert {r.video_id: r.srt_text for r in io.to_srt(s).collect()} == {"v": want, "w": "\n"}
    io.write_srt(s, str(tmp_path / "srt"))
    assert {p.stem: p.read_text() for p in (tmp_path / "srt").glob("*/*/*.srt")} == {"v": want, "w": "\n"}
    io.write_segments(s, str(tmp_path / "seg"), partition_by=("video_id",))
    assert spark.read.parquet(str(tmp_path / "seg")).count() == 4


def test_tts_meta_files(spark, tmp_path):
    rows = [{"segno": 2, "flac_path": "a", "duration_sec": 1.0}, {"segno": 0, "flac_path": "b", "duration_sec": 1.0}, 3, {"segno": 2, "flac_path": "c", "duration_sec": 2.0}, {"segno": 4, "flac_path": "", "duration_sec": 1.0}]
    (tmp_path / "v.json").write_text(json.dumps(rows))
    meta = io.read_tts_meta(spark, str(tmp_path))
    assert [tuple(r) for r in meta.collect()] == [("v", 2, "c", 2.0)]
    io.write_tts_meta(meta, str(tmp_path / "out"))
    assert [tuple(r) for r in io.read_tts_meta(spark, str(tmp_path / "out")).collect()] == [("v", 2, "c", 2.0)]


def test_ledger_round_trip(spark, sf, tmp_path):
    from segflow.plans import fixtures

    docs = fixtures.ledger_documents(spark, sf)
    io.write_ledger(docs, str(tmp_path / "book"))
    assert sorted(map(str, io.read_ledger(spark, str(tmp_path / "book")).select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    states = {r.state for r in ledger.changed_inputs(fixtures.media(spark, sf), docs).collect()}
    assert states == {"new", "changed", "resume"}


def test_resumed_runs(spark, sf):
    rows = queries.t1_resumed_runs(spark, sf).collect()
    assert len(rows) == len({r.video_id for r in rows}) and {r.asr_done for r in rows} == {"true"}


def test_a_batch_repeated_after_a_crash_leaves_the_same_tables(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("in", "out", "book", "check")}
    schema = "video_id string, path string, size bigint, mtime timestamp, text string"

    def run():
        resume.run_available(spark, at["in"], schema, at["out"], at["book"], at["check"], lambda rows: rows.groupBy("video_id").count())

    def state():
        results = resume.read_results(spark, at["out"], "video_id string, count bigint", at["book"])
        return sorted(map(tuple, results.collect())), sorted(map(str, io.read_ledger(spark, at["book"]).collect()))

    def arrive(*rows):
        spark.createDataFrame([(v, f"{v}.mp4", size, None, text) for v, size, text in rows], schema).coalesce(1).write.mode("append").parquet(at["in"])

    arrive(("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"))
    run()
    arrive(("a", 2, "x"), ("c", 1, "y"))
    run()
    done = state()
    assert done[0] == [("a", 1), ("b", 1), ("c", 1)]
    # the last batch wrote results and ledger, but the stream did not come to note that it ended
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    run()
    assert state() == done


SEGMENTS = "video_id string, idx int, start double, end double, text_src string, text_tgt string, speaker_id string, detected_lang string"


def test_segments_come_back_from_their_files(spark, tmp_path):
    ids = ["a", "b/c", "d e", "é+%", "x.y", "a%20b", "..", "current-1", "_h", ".h"]
    rows = [(v, i, i * 1.5, math.inf if i == 2 else i * 1.5 + 0.1 + 0.2, f'say "{v}"\n{i} \\ 🙂', "", "S", "") for v in ids for i in (0, 1, 2, 10)]
    s = spark.createDataFrame(rows, SEGMENTS).repartition(3)
    path = str(tmp_path / "seg")
    io.write_segments(s, path, "json", folders=4)
    back = lambda: sorted(map(tuple, io.read_segments(spark, path).select(*s.columns).collect()))
    assert back() == sorted(rows)
    assert len(list((tmp_path / "seg").glob("run-*/*"))) <= 4
    io.write_segments(s.filter("video_id = 'b/c' and idx < 2"), path, "json", folders=4, update=True)
    rows = [r for r in rows if r[0] != "b/c" or r[1] < 2]
    assert back() == sorted(rows)
    assert json.loads(next((tmp_path / "seg").glob("run-*/*/d%20e.json")).read_text())[1]["idx"] == 1
    keyed.compact_documents(spark, path, ".json", folders=4)
    assert back() == sorted(rows) and len(list((tmp_path / "seg").glob("run-*"))) == 1
    io.write_segments(s.limit(0), path, "json")
    assert back() == []


def test_many_videos_make_few_folders(spark, tmp_path):
    rows = spark.range(3000).selectExpr("cast(id as string) video_id", "cast(id as string) chunk")
    keyed.write_documents(rows, str(tmp_path / "t"), ".txt", "", "", "", [], folders=16)
    assert len(list((tmp_path / "t").glob("run-*/*"))) == 16 and len(list((tmp_path / "t").glob("run-*/*/*.txt"))) == 3000
    assert keyed.read_documents(spark, str(tmp_path / "t")).filter("video_id = doc").count() == 3000


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", "1"), ("b", "2")], "video_id string, chunk string")
    keyed.write_documents(good, path, ".txt", "", "", "", [])
    bad = good.selectExpr("video_id", "if(video_id = 'b', raise_error('boom'), 'x') chunk")
    for rows in (bad, spark.createDataFrame([(None, "1"), ("c", "3")], "video_id string, chunk string")):
        with pytest.raises(PySparkException):
            keyed.write_documents(rows, path, ".txt", "", "", "", [])
        assert sorted(map(tuple, keyed.read_documents(spark, path).collect())) == [("a", "1"), ("b", "2")]
        assert len(list((tmp_path / "t").glob("run-*"))) == 1


def test_attempts_that_do_not_commit_are_not_seen(tmp_path):
    """A lost executor leaves an attempt behind; its task is run again elsewhere."""
    options = {"path": str(tmp_path), "run": "run-" + "0" * 32, "suffix": ".txt", "head": "", "between": "", "tail": "", "update": "false"}
    w = keyed.KeyedWriter(options)
    for attempt, text in (("lost", "half"), ("good", "whole")):
        folder = tmp_path / options["run"] / f".attempt-{attempt}" / "0001"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(text)
    w.commit([keyed.Moved(f"{options['run']}/.attempt-good", ["0001"]), None])
    assert [p.read_text() for p in tmp_path.rglob("a.txt")] == ["whole"]


def test_broken_recogniser_files(spark, tmp_path):
    good = {"transcription": [{"offsets": {"from": 0, "to": 1500}, "text": "a"}]}
    docs = {
        "good": json.dumps(good, indent=2) + "\n",
        "extra": json.dumps(good | {"more": [1]}),
        "cut": json.dumps(good)[:-3],
        "tail": json.dumps(good) + " x",
        "two": json.dumps(good) + "," + json.dumps(good),
        "list": json.dumps([good]),
        "text": '"{}"',
        "blank": "  \n",
        "number": json.dumps({"transcription": 3}),
        "object": json.dumps({"transcription": {"a": 1}}),
        "words": json.dumps({"transcription": ["{a}"]}),
        "null": json.dumps({"transcription": None}),
        "none": json.dumps({"transcription": [None]}),
        "offsets": json.dumps({"transcription": [{"offsets": [1, 2], "text": "a"}]}),
        "junk": json.dumps({"transcription": [{"offsets": {"from": "x", "to": 2}, "text": "a"}]}),
        "silent": json.dumps({"transcription": [{"offsets": {"from": 5, "to": 5}, "text": "a"}]}),
        "empty": "{}",
    }
    table = spark.createDataFrame(list(docs.items()), "video_id string, doc string")
    errors = {r.video_id: r.error for r in io.whisper_errors(table).collect()}
    assert errors == {
        "cut": "not JSON", "tail": "not JSON", "two": "not JSON", "list": "not an object", "text": "not an object", "blank": "empty file",
        "number": "unexpected types", "object": "unexpected types", "words": "unexpected types", "null": "no segments", "none": "an entry that is no object",
        "offsets": "unexpected types", "junk": "an offset that is no number", "silent": "no segments", "empty": "no segments",
    }
    assert {r.video_id for r in io.whisper_segments(table).collect()} == {"good", "extra"}
    failed = ledger.video_errors(io.whisper_errors(table), io.document_errors(table.filter("video_id = 'good'")))
    assert {r.video_id: r.error for r in failed.collect()} == errors | {"good": "not a list"}


def documents(spark, rows):
    media = spark.createDataFrame([(v, path, 1, None) for v, path, _ in rows], "video_id string, path string, size bigint, mtime timestamp")
    return ledger.finished(media, "asr_done", F.timestamp_millis(F.lit(rows[0][2])))


def test_a_ledger_of_many_writes_stays_few_files(spark, tmp_path):
    path = str(tmp_path / "book")
    want = {}
    for k in range(9):
        rows = [(f"v{i}", f"{i}-{k}", k) for i in range(k % 4, 6)]
        ledger_log.write_part(documents(spark, rows), path)
        ledger_log.compact(spark, path, after=2, buckets=2)
        want |= {v: p for v, p, _ in rows}
        assert {r.video_id: r.video.path for r in ledger_log.read(spark, path).collect()} == want
        base, parts = ledger_log._tables(spark, path)
        assert len(parts) <= 2 and len(list((tmp_path / "book" / "snapshots").glob("*/part-*"))) <= 2
    assert ledger_log.read(spark, str(tmp_path / "none")).collect() == []


def test_a_compaction_that_stops_half_way_changes_nothing(spark, tmp_path):
    """Snapshots that were not renamed are not seen; parts that were not deleted yet do not count again."""
    path = tmp_path / "book"
    for k in range(3):
        ledger_log.write_part(documents(spark, [("a", f"a{k}", 5), (f"b{k}", "b", 5)]), str(path))
    read = lambda: {r.video_id: r.video.path for r in ledger_log.read(spark, str(path)).collect()}
    want = {"a": "a2", "b0": "b", "b1": "b", "b2": "b"}  # of equal times the later part counts
    assert read() == want
    documents(spark, [("a", "half", 9)]).write.parquet(str(path / ".made-x"))
    shutil.copytree(path / "parts", tmp_path / "kept")
    ledger_log.compact(spark, str(path))
    assert read() == want
    shutil.rmtree(path / "parts")
    shutil.copytree(tmp_path / "kept", path / "parts")
    assert read() == want
    ledger_log.write_part(documents(spark, [("a", "late", 5)]), str(path))
    assert read() == want | {"a": "late"}


def test_a_run_knows_its_videos_without_the_ledger(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("in put", "out", "book", "check")}
    schema = "video_id string, path string, size bigint, mtime timestamp, text string"

    def run(*rows):
        spark.createDataFrame([(v, f"{v}.mp4", size, None, text) for v, size, text in rows], schema).coalesce(1).write.mode("append").parquet(at["in put"])
        resume.run_available(spark, at["in put"], schema, at["out"], at["book"], at["check"], lambda rows: rows.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("texts")))
        batch = max(int(p.name.removeprefix("batch=")) for p in (tmp_path / "out").glob("batch=*"))
        return sorted(map(tuple, spark.read.parquet(f"{at['out']}/batch={batch}").collect()))

    assert run(("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "lost")) == [("a", "xy"), ("b", "z")]
    shutil.rmtree(at["book"])
    assert run(("a", 1, "x"), ("b", 2, "w"), ("c", 1, "v")) == [("b", "w"), ("c", "v")]
    # two states of a video at once: the newest counts
    assert run(("d", 3, "old"), ("d", 5, "new"), ("d", 5, "er"), ("c", 1, "v")) == [("d", "ernew")]
    assert run(("d", 5, "again"), ("d", 3, "older")) == [("d", "older")]


def test_tables_by_video_need_no_exchange(spark, tmp_path):
    rows = [(f"v{i % 7}", (i * 31) % 50, float(i), i + 0.5, "word", "", "S", "") for i in range(350)]
    table = tables.save_by_video(spark.createDataFrame(rows, SEGMENTS), "by_video", str(tmp_path / "t"), ("idx",), 4)
    try:
        assert sorted(map(tuple, table.collect())) == sorted(rows)
        assert len(list((tmp_path / "t").glob("part-*"))) <= 4
        assert {r.n for r in tables.out_of_order(table, ("idx",)).collect()} == {0}
        assert any(r.n for r in tables.out_of_order(table, ("text_tgt", "start")).collect())
        for d in (shape.merge_segments(table), shape.with_segno(table), table.groupBy("video_id").count(), table.join(table.select("video_id", F.col("idx").alias("j")).hint("merge"), "video_id")):
            assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in shape.with_segno(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.drop(spark, "by_video")
