"""Registered queries of the transcript engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow import params
from segflow.functions import text as T
from segflow.functions import timing
from segflow.operators import language, ledger, shape, speakers, synth, timeline, translate
from segflow.plans import fixtures as X
from segflow.plans import sql as S
from segflow.sources import io, keyed, ledger_log, tables
from segflow.sources.shared import shared_path, stage
from segflow.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals by the rule of SQL's round: the product with a million goes to the nearest whole number. F.round would round the shortest decimal, which differs near ties."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in columns})


_SEG = f'video_id, idx, {S.rounded("start")}, round("end", 6) AS "end", text_src, speaker_id, detected_lang'


def _segments(df: DataFrame) -> DataFrame:
    return _r(df.withColumn("idx", F.col("idx").cast("long")).select(*shape.COLUMNS), "start", "end")


# grouping


@query(f"WITH RECURSIVE {S.F1}, {S.G1} SELECT {_SEG} FROM g1")
def g1_merge_segments(spark, d):
    return _segments(shape.merge_segments(X.segments(spark, d)))


@query(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2} SELECT {_SEG} FROM g2")
def g2_chunk_segments(spark, d):
    return _segments(shape.chunk_segments(shape.merge_segments(X.segments(spark, d))))


@query(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2}, {S.E1} SELECT {_SEG} FROM e1")
def e1_split_sentences(spark, d):
    return _segments(shape.split_sentences(shape.chunk_segments(shape.merge_segments(X.segments(spark, d)))))


@query(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2}, {S.E1}, {S.G3} SELECT {_SEG} FROM g3")
def g3_sentence_units(spark, d):
    return _segments(shape.shape(X.segments(spark, d)))


@query(f"WITH RECURSIVE {S.F3}, {S.G1.replace('FROM f1', 'FROM f3').replace('FROM f1)', 'FROM f3)')} SELECT {_SEG} FROM g1")
def g1_merge_long_segments(spark, d):
    return _segments(shape.merge_segments(X.long_segments(spark, d)))


_FUNNEL = " UNION ALL ".join(f"SELECT video_id, '{n}' AS stage, count(*) AS n FROM {t} GROUP BY video_id" for n, t in (("raw", "f1"), ("merged", "g1"), ("chunked", "g2"), ("split", "e1"), ("units", "g3")))


@query(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2}, {S.E1}, {S.G3} {_FUNNEL}")
def a7_stage_funnel(spark, d):
    return shape.stage_funnel(X.segments(spark, d))


@query(f"WITH {S.F1}, k AS (SELECT * FROM f1 WHERE {S.strip('text_src')} <> '' AND \"end\" > start) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS segno FROM k")
def w8_renumber(spark, d):
    kept = shape.drop_empty_intervals(shape.drop_blank(X.segments(spark, d)))
    out = shape.renumber(shape.with_segno(kept), "segno")
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), F.col("segno").cast("long").alias("segno"))


@query(
    """SELECT doc_id AS video_id, 480 AS chunk_sec, k AS chunk_no, n AS n_chunks, CAST(k * 11520000 AS DOUBLE) / 24000 AS start_sec,
       CAST(CASE WHEN n = 1 THEN samples ELSE least((k + 1) * 11520000, samples) END AS DOUBLE) / 24000 AS end_sec
FROM (SELECT doc_id, samples, n, unnest(range(0, n)) AS k FROM (
  SELECT doc_id, n_chars * 24000 AS samples, CASE WHEN n_chars <= 480 THEN 1 ELSE (n_chars * 24000 + 11519999) // 11520000 END AS n FROM documents WHERE n_chars IS NOT NULL))"""
)
def e2_chunk_plan(spark, d):
    media = X.read(spark, d, "documents").filter("n_chars is not null").select(F.col("doc_id").alias("video_id"), F.col("n_chars").cast("double").alias("video_dur"))
    return shape.plan_chunks(media)


# speakers


@query(
    f"""WITH {S.F2}, {S.OVERLAP},
best AS (SELECT video_id, idx, arg_min(speaker, row(-overlap, first_turn)) AS best FROM ov GROUP BY 1, 2),
held AS (SELECT s.*, last_value(best IGNORE NULLS) OVER (PARTITION BY s.video_id ORDER BY s.idx) AS held FROM f1 s LEFT JOIN best USING (video_id, idx)),
near AS (SELECT f.video_id, arg_min(t.speaker, row(least(abs(t.start - f.mid), abs(t."end" - f.mid)), t.turn_no)) AS nearest
         FROM (SELECT video_id, (start + "end") / 2 AS mid FROM f1 WHERE idx = 0) f JOIN f2 t USING (video_id) GROUP BY 1)
SELECT video_id, idx, coalesce(held, nearest, 'UNKNOWN') AS speaker_id FROM held LEFT JOIN near USING (video_id)"""
)
def j1_assign_speakers(spark, d):
    out = speakers.assign_speakers(X.segments(spark, d), X.turns(spark, d))
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), "speaker_id")


@query(f"WITH {S.F2}, {S.OVERLAP} SELECT video_id, idx, speaker, overlap, first_turn FROM ov")
def a4_overlap_totals(spark, d):
    out = speakers.overlap_totals(X.segments(spark, d), X.turns(spark, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("idx", "first_turn")})


@query(f"WITH {S.F1} SELECT video_id, count(DISTINCT speaker_id) AS n_speakers, array_to_string(list_sort(list(DISTINCT speaker_id)), ',') AS speakers FROM f1 GROUP BY video_id")
def a3_speaker_inventory(spark, d):
    return speakers.speaker_inventory(X.segments(spark, d)).withColumn("speakers", F.array_join("speakers", ","))


@query(f"WITH {S.F2} SELECT video_id, speaker, count(*) AS n_turns, round(sum(\"end\" - start), 6) AS total_sec, min(turn_no) AS first_turn FROM f2 GROUP BY 1, 2")
def a6_turns_by_speaker(spark, d):
    return speakers.turns_by_speaker(X.turns(spark, d)).withColumn("first_turn", F.col("first_turn").cast("long"))


_BEST = """
cand AS (SELECT * FROM (SELECT *, round("end" - start, 9) AS dur FROM f2) WHERE NOT isnan(dur)),
pick AS (SELECT video_id, speaker AS speaker_id, arg_min(row(start, "end", dur), row(CASE WHEN dur >= 3 THEN 0 ELSE 1 END, CASE WHEN dur >= 3 THEN round(abs(least(dur, 15) - 8), 9) ELSE -dur END, turn_no)) AS x FROM cand GROUP BY 1, 2),
refs AS (SELECT video_id, speaker_id, x[1] AS ref_start, CASE WHEN x[3] > 15 THEN x[1] + 15 ELSE x[2] END AS ref_end FROM pick WHERE x[3] >= 1)"""


@query(f"WITH {S.F2}, {_BEST} SELECT video_id, speaker_id, {S.rounded('ref_start', 'ref_end')} FROM refs")
def w7_best_references(spark, d):
    return _r(speakers.best_references(X.turns(spark, d)), "ref_start", "ref_end")


_PROMPT = f"""
said AS (SELECT video_id, idx, start, "end", {S.spaces('text_src')} AS said FROM f1),
lap AS (SELECT r.video_id, r.speaker_id, string_agg(said, ' ' ORDER BY s.start, idx) FILTER (said <> '') AS joined FROM refs r JOIN said s ON r.video_id = s.video_id AND least(ref_end, "end") > greatest(ref_start, start) AND NOT isnan(s."end") GROUP BY 1, 2),
nea AS (SELECT r.video_id, r.speaker_id, arg_min(said, row(round(abs((start + "end") / 2 - (ref_start + ref_end) / 2), 9), idx)) AS near FROM refs r JOIN said s ON r.video_id = s.video_id GROUP BY 1, 2),
voice AS (SELECT refs.*, coalesce(joined, near, '') AS prompt_text FROM refs LEFT JOIN lap USING (video_id, speaker_id) LEFT JOIN nea USING (video_id, speaker_id))"""


@query(f"WITH {S.F2}, {_BEST}, {_PROMPT} SELECT video_id, speaker_id, {S.rounded('ref_start', 'ref_end')}, prompt_text FROM voice")
def m5_speaker_refs(spark, d):
    return _r(speakers.speaker_refs(X.turns(spark, d), X.segments(spark, d)), "ref_start", "ref_end")


_OWN = f"own AS (SELECT video_id, segno, start AS ref_start, start + least(\"end\" - start, 15) AS ref_end, {S.spaces('text_src')} AS prompt_text FROM n1 WHERE \"end\" - start >= 0.3)"


@query(f"WITH {S.F1}, {S.NUMBERED}, {_OWN} SELECT video_id, segno, {S.rounded('ref_start', 'ref_end')}, prompt_text FROM own")
def m4_segment_refs(spark, d):
    return _r(speakers.segment_refs(X.segments(spark, d)).withColumn("segno", F.col("segno").cast("long")), "ref_start", "ref_end")


def _references(spark, d):
    """Every third segment has no clip of its own."""
    return speakers.segment_refs(X.segments(spark, d)).filter("segno % 3 <> 0"), speakers.speaker_refs(X.turns(spark, d), X.segments(spark, d))


_CHOICE = "picked AS (SELECT * FROM own WHERE segno % 3 <> 0)"


@query(
    f"""WITH {S.F2}, {S.NUMBERED}, {_OWN}, {_CHOICE}, {_BEST}, {_PROMPT}
SELECT n1.video_id, n1.segno, CASE WHEN o.segno IS NOT NULL THEN 'segment' WHEN v.speaker_id IS NOT NULL THEN 'speaker' END AS ref_level, coalesce(o.prompt_text, v.prompt_text) AS prompt_text
FROM n1 LEFT JOIN picked o USING (video_id, segno) LEFT JOIN voice v ON v.video_id = n1.video_id AND v.speaker_id = n1.speaker_id"""
)
def j5_reference_choice(spark, d):
    own, voice = _references(spark, d)
    out = speakers.choose_references(shape.with_segno(X.segments(spark, d)), own, voice)
    return out.select("video_id", F.col("segno").cast("long").alias("segno"), "ref_level", "prompt_text")


@query(f"WITH {S.F1}, {S.NUMBERED}, {_OWN}, {_CHOICE} SELECT n1.video_id, count(picked.segno) AS built, count(*) AS total FROM n1 LEFT JOIN picked USING (video_id, segno) GROUP BY 1")
def a11_reference_coverage(spark, d):
    own, _ = _references(spark, d)
    return speakers.reference_coverage(X.segments(spark, d), own)


# timeline

_PART = f"video_id, part_no, kind, {S.rounded('orig_start', 'orig_end', 'out_duration', 'speed')}, segno"


def _parts(spark, d, absorb=True):
    return timeline.layout(X.segments(spark, d), X.tts_meta(spark, d), X.durations(spark, d), absorb)


def _part_columns(p):
    return _r(p.withColumns({c: F.col(c).cast("long") for c in ("part_no", "segno")}), "orig_start", "orig_end", "out_duration", "speed")


@query(f"WITH {S.F4}, {S.ACCEPTED} SELECT video_id, segno, {S.rounded('start')}, round(\"end\", 6) AS \"end\", round(cur, 6) AS cursor FROM acc")
def w3_cursor_sweep(spark, d):
    out = timeline.accepted_segments(X.segments(spark, d), X.durations(spark, d))
    return _r(out.select("video_id", F.col("segno").cast("long").alias("segno"), "start", "end", "cursor"), "start", "end", "cursor")


@query(f"WITH {S.F4}, {S.parts(False)} SELECT {_PART} FROM pt")
def w4_part_layout(spark, d):
    return _part_columns(_parts(spark, d, absorb=False))


@query(f"WITH {S.F4}, {S.parts(True)} SELECT {_PART} FROM pt")
def w5_retime_parts(spark, d):
    return _part_columns(_parts(spark, d))


@query(f"WITH {S.F4}, {S.parts(True)} SELECT video_id, count(*) AS n_parts, round(sum(out_duration), 6) AS total_out FROM pt GROUP BY 1")
def a5_retimed_totals(spark, d):
    return timeline.retimed_totals(_parts(spark, d))


@query(f"WITH {S.F4}, {S.parts(True)} SELECT video_id, part_no, round(coalesce(sum(out_duration) OVER (PARTITION BY video_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS out_start FROM pt")
def w6_placement(spark, d):
    return _r(timeline.place(_parts(spark, d)).select("video_id", F.col("part_no").cast("long").alias("part_no"), "out_start"), "out_start")


_STEPS = "list_filter(range(0, 65), lambda k: {0} > pow(2.0, k + 1))"


@query(
    f"""WITH {S.F4}, {S.parts(True)},
r0 AS (SELECT pt.*, flac_path, segno % 8 <> 1 AS there, greatest(1e-6, speed) AS s, greatest(0, orig_start) AS a FROM pt LEFT JOIN f4 USING (video_id, segno)),
r1 AS (SELECT *, CASE WHEN kind <> 'speech' THEN 'silence' WHEN flac_path IS NOT NULL AND there THEN 'file' ELSE 'missing' END AS source, greatest(a, orig_end) AS b, len({_STEPS.format('s')}) AS up, len({_STEPS.format('1 / s')}) AS down FROM r0)
SELECT video_id, part_no, kind, round(a, 6) AS trim_start, round(CASE WHEN b - a < 0.05 THEN a + 0.05 ELSE b END, 6) AS trim_end, round(s, 6) AS speed,
       repeat('atempo=2.000000,', up) || repeat('atempo=0.500000,', down) || 'atempo=' || printf('%.6f', s * pow(2.0, down - up)) AS tempo, source,
       'file ''' || CASE source WHEN 'file' THEN flac_path WHEN 'silence' THEN 'dub_' || lpad(CAST(part_no AS VARCHAR), 5, '0') || '_sil.flac' ELSE 'dub_' || lpad(CAST(part_no AS VARCHAR), 5, '0') || '_missing.flac' END || '''' AS concat_line
FROM r1"""
)
def m6_render_plan(spark, d):
    outputs = X.tts_meta(spark, d).withColumn("file_exists", F.col("segno") % 8 != 1)
    plan = timeline.render_plan(_parts(spark, d), outputs).withColumn("part_no", F.col("part_no").cast("long")).drop("out_start", "out_duration")
    return _r(plan, "trim_start", "trim_end", "speed")


# one video for each source, in blocks (F10)

_F10 = f"""{S.F3}, f10 AS (SELECT coalesce(source, '') AS video_id, video_id * 100000 + idx AS idx, start + CAST(video_id * 100000 AS DOUBLE) AS start, "end" + CAST(video_id * 100000 AS DOUBLE) AS "end", text_src, speaker_id FROM f3 JOIN documents ON doc_id = video_id)"""
_BLOCK = 4096


@query(f"WITH {_F10} SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS segno FROM f10")
def w8_blocked_places(spark, d):
    return shape.with_segno(X.source_segments(spark, d).select("video_id", "idx"), _BLOCK).select("video_id", "idx", F.col("segno").cast("long").alias("segno"))


@query(
    f"""WITH {_F10}, n1 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS segno FROM f10), dur AS (SELECT video_id, max("end") - 30 AS video_dur FROM f10 GROUP BY 1), {S.ACCEPTED}
SELECT video_id, segno, {S.rounded('start')}, round("end", 6) AS "end", round(cur, 6) AS cursor FROM acc"""
)
def w3_blocked_cursor(spark, d):
    s = stage(X.source_segments(spark, d).select("video_id", "idx", "start", "end"), "by_source")
    out = timeline.accepted_segments(s, s.groupBy("video_id").agg((F.max("end") - 30).alias("video_dur")), _BLOCK)
    return _r(out.select("video_id", F.col("segno").cast("long").alias("segno"), "start", "end", "cursor"), "start", "end", "cursor")


@query(
    f"""WITH {_F10}, p AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS part_no, round(("end" - start) * 1000) AS out_duration FROM f10)
SELECT video_id, part_no, CAST(coalesce(sum(out_duration) OVER (PARTITION BY video_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM p"""
)
def w6_blocked_placement(spark, d):
    """Durations in whole milliseconds, so that sums do not depend on their order."""
    parts = X.source_segments(spark, d).select("video_id", "idx", F.round((F.col("end") - F.col("start")) * 1000).alias("out_duration"))
    return timeline.place(parts, _BLOCK, ("idx",)).select("video_id", F.col("part_no").cast("long").alias("part_no"), F.col("out_start").cast("long").alias("out_start"))


@query(
    f"""WITH {_F10}, f2 AS (SELECT video_id, idx AS turn_no, start - 0.3 AS start, "end" - 0.2 AS "end", speaker_id AS speaker FROM f10 WHERE idx % 50 < 3), {S.OVERLAP.replace('FROM f1 s', 'FROM f10 s')},
best AS (SELECT video_id, idx, arg_min(speaker, row(-overlap, first_turn)) AS best FROM ov GROUP BY 1, 2)
SELECT video_id, idx, coalesce(last_value(best IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY idx), 'UNKNOWN') AS speaker_id FROM f10 LEFT JOIN best USING (video_id, idx)"""
)
def w1_blocked_speakers(spark, d):
    """Three of fifty segments have a turn, the first of each document among them; the others carry on across blocks."""
    s = stage(X.source_segments(spark, d).select("video_id", "idx", "start", "end", "speaker_id"), "by_source")
    turns = s.filter("idx % 50 < 3").select("video_id", F.col("idx").alias("turn_no"), (F.col("start") - 0.3).alias("start"), (F.col("end") - 0.2).alias("end"), F.col("speaker_id").alias("speaker"))
    return speakers.assign_speakers(s, turns, _BLOCK).select("video_id", "idx", "speaker_id")


# the same on awkward rows (F8)


def _edge_rounded(df):
    return df.withColumn("segno", F.col("segno").cast("long"))


@query(S.edges(f"WITH RECURSIVE {S.F1}, {S.G1} SELECT {_SEG} FROM g1"))
def g1_merge_edge_segments(spark, d):
    return _segments(shape.merge_segments(X.edge_segments(spark, d)))


@query(S.edges(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2}, {S.E1}, {S.G3} SELECT {_SEG} FROM g3"))
def g3_edge_units(spark, d):
    return _segments(shape.shape(X.edge_segments(spark, d)))


@query(S.edges(ORACLE_SQL["w8_renumber"]))
def w8_renumber_edges(spark, d):
    kept = shape.drop_empty_intervals(shape.drop_blank(X.edge_segments(spark, d)))
    out = shape.renumber(shape.with_segno(kept), "segno")
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), F.col("segno").cast("long").alias("segno"))


@query(S.edges(ORACLE_SQL["j1_assign_speakers"]))
def j1_assign_edge_speakers(spark, d):
    out = speakers.assign_speakers(X.edge_segments(spark, d), X.turns(spark, d, X.edge_segments))
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), "speaker_id")


@query(S.edges(ORACLE_SQL["m4_segment_refs"]))
def m4_edge_refs(spark, d):
    return _r(_edge_rounded(speakers.segment_refs(X.edge_segments(spark, d))), "ref_start", "ref_end")


@query(S.edges(ORACLE_SQL["w3_cursor_sweep"]))
def w3_edge_cursor(spark, d):
    out = timeline.accepted_segments(X.edge_segments(spark, d), X.durations(spark, d, X.edge_segments))
    return _r(_edge_rounded(out.select("video_id", "segno", "start", "end", "cursor")), "start", "end", "cursor")


def _edge_parts(spark, d, absorb):
    e = X.edge_segments
    return _part_columns(timeline.layout(e(spark, d), X.tts_meta(spark, d, e), X.durations(spark, d, e), absorb))


@query(S.edges(ORACLE_SQL["w4_part_layout"]))
def w4_edge_layout(spark, d):
    return _edge_parts(spark, d, False)


@query(S.edges(ORACLE_SQL["w5_retime_parts"]))
def w5_edge_parts(spark, d):
    return _edge_parts(spark, d, True)


# intervals of any length (F9)


@query(S.wild(ORACLE_SQL["j1_assign_speakers"]))
def j1_assign_wild_speakers(spark, d):
    out = speakers.assign_speakers(X.wild_segments(spark, d), X.turns(spark, d, X.wild_segments))
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), "speaker_id")


@query(S.wild(f"WITH {S.F2}, {S.OVERLAP} SELECT video_id, idx, speaker, isinf(overlap) AS endless, first_turn FROM ov"))
def a4_wild_overlaps(spark, d):
    out = speakers.overlap_totals(X.wild_segments(spark, d), X.turns(spark, d, X.wild_segments))
    return out.select("video_id", F.col("idx").cast("long").alias("idx"), "speaker", (F.col("overlap") == float("inf")).alias("endless"), F.col("first_turn").cast("long").alias("first_turn"))


@query(S.wild(ORACLE_SQL["m5_speaker_refs"]))
def m5_wild_refs(spark, d):
    return _r(speakers.speaker_refs(X.turns(spark, d, X.wild_segments), X.wild_segments(spark, d)), "ref_start", "ref_end")


# languages


def _detections(spark, d):
    """Documents as the segments of their source, with the language detected from their text."""
    docs = X.read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    detected = language.detected_language(F.col("text"), stage(language.train_profiles(docs), "profiles"))
    return stage(docs.select(F.coalesce("source", F.lit("")).alias("video_id"), F.col("doc_id").alias("idx"), detected.alias("detected")), "detected")


_M3 = rf"""t AS (SELECT doc_id, lower(coalesce(lang, '')) AS lang, {S.strip('text')} AS s, ' ' || lower({S.spaces('text')}) || ' ' AS x FROM documents),
g AS (SELECT doc_id, lang, substring(x, i, 3) AS gram, length(s) AS n_s FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM t WHERE s <> '')),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang <> '' GROUP BY 1, 2),
p AS (SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 400),
tot AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
d AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE n_s >= 3 GROUP BY 1, 2),
gain AS (SELECT doc_id, p.lang, sum(d.n * (ln((p.n + 0.5) / (total + 200.0)) - ln(0.5 / (total + 200.0)))) AS gain FROM d JOIN p USING (gram) JOIN tot ON tot.lang = p.lang GROUP BY 1, 2),
sz AS (SELECT doc_id, sum(n) AS size FROM d GROUP BY 1),
sc AS (SELECT doc_id, gain.lang, round(gain + size * ln(0.5 / (total + 200.0)), 6) AS score FROM gain JOIN sz USING (doc_id) JOIN tot ON tot.lang = gain.lang),
best AS (SELECT doc_id, arg_min(lang, row(-score, lang)) AS detected FROM sc GROUP BY 1)"""

_DET = _M3 + ", det AS (SELECT coalesce(source, '') AS video_id, coalesce(detected, '') AS lang, doc_id AS idx FROM documents LEFT JOIN best USING (doc_id)), cnt AS (SELECT video_id, lang, count(*) AS n, min(idx) AS f FROM det WHERE lang <> '' GROUP BY 1, 2)"


@query(f"WITH {_DET} SELECT v.video_id, coalesce(arg_min(lang, row(-n, f)), 'en') AS video_lang FROM (SELECT DISTINCT video_id FROM det) v LEFT JOIN cnt USING (video_id) GROUP BY 1")
def a1_majority_language(spark, d):
    return language.majority_language(_detections(spark, d))


@query(f"WITH {_DET} SELECT video_id, string_agg(lang || '=' || n, ', ' ORDER BY -n, f) AS breakdown FROM cnt GROUP BY 1")
def a2_language_breakdown(spark, d):
    return language.language_breakdown(_detections(spark, d))


@query(
    f"""WITH {_DET}, vid AS (SELECT v.video_id, coalesce(arg_min(lang, row(-n, f)), 'en') AS video_lang FROM (SELECT DISTINCT video_id FROM det) v LEFT JOIN cnt USING (video_id) GROUP BY 1)
SELECT det.video_id, idx, CASE WHEN idx % 4 = 0 OR lang = '' THEN video_lang ELSE lang END AS detected_lang FROM det JOIN vid USING (video_id)"""
)
def w9_fill_language(spark, d):
    det = _detections(spark, d)
    some = det.select("video_id", "idx", F.when(F.col("idx") % 4 == 0, F.lit("")).otherwise(F.col("detected")).alias("detected_lang"))
    return language.fill_language(some, language.majority_language(det)).select("video_id", "idx", "detected_lang")


@query(f"WITH {_M3} SELECT doc_id, coalesce(detected, '') AS detected FROM documents LEFT JOIN best USING (doc_id)")
def m3_detect_language(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id", "text", "lang")
    return language.detect_language(docs, stage(language.train_profiles(docs), "profiles"), "doc_id")


# scalar functions over segments, languages and documents


@query(
    f"""WITH {S.F1}
SELECT video_id, idx, {S.spaces('text_src')} AS normal, {S.strip("' ' || text_src || chr(10)")} AS stripped, round(greatest(0, "end" - start), 6) AS duration, {S.stops('text_src')} AS ends,
       greatest(1, length(regexp_replace(text_src, '{S.WS}', '', 'g'))) AS weight, regexp_matches('[' || text_src || ']', '^\\[.*\\]$') AS remark,
       printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, printf('SPEAKER_%02d', CASE WHEN idx % 3 = 0 THEN 0 ELSE idx END) AS label
FROM (SELECT *, CAST(round_even(start * 1000, 0) AS BIGINT) AS ms FROM f1)"""
)
def p1_segment_text(spark, d):
    s = X.segments(spark, d)
    raw = F.when(F.col("idx") % 3 == 0, F.lit("x")).otherwise(F.col("idx").cast("string"))
    t = F.col("text_src")
    return s.select(
        "video_id",
        F.col("idx").cast("long").alias("idx"),
        T.normalize_spaces(t).alias("normal"),
        T.strip(F.concat(F.lit(" "), t, F.lit("\n"))).alias("stripped"),
        F.round(T.duration(F.col("start"), F.col("end")), 6).alias("duration"),
        T.ends_sentence(t).alias("ends"),
        T.time_weight(t).cast("long").alias("weight"),
        T.is_non_speech(F.concat(F.lit("["), t, F.lit("]"))).alias("remark"),
        T.srt_timestamp(F.col("start")).alias("stamp"),
        T.speaker_label(raw).alias("label"),
    )


@query(
    """WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || upper(lang) || '-XX' WHEN 1 THEN lang WHEN 2 THEN 'ja' ELSE 'q' || doc_id END AS code, CASE doc_id % 3 WHEN 0 THEN 'ja' ELSE 'EN-us' END AS target FROM documents),
n AS (SELECT *, string_split(lower(trim(code)), '-')[1] AS norm FROM l),
m AS (SELECT *, CASE norm WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'ja' THEN 'Japanese' ELSE upper(norm[1]) || norm[2:] END AS name FROM n)
SELECT doc_id, norm, name, CASE WHEN norm IN ('en', 'fr', 'de', 'es', 'ja') THEN norm ELSE lower(name)[1:2] END AS back,
       CASE WHEN (norm = 'ja' AND target = 'EN-us') OR (norm = 'en' AND target = 'ja') THEN 'cat_translate' ELSE 'translategemma' END AS engine FROM m"""
)
def p4_language_codes(spark, d):
    c = F.col("doc_id") % 4
    code = F.when(c == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("-XX"))).when(c == 1, F.col("lang")).when(c == 2, F.lit("ja")).otherwise(F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    target = F.when(F.col("doc_id") % 3 == 0, F.lit("ja")).otherwise(F.lit("EN-us"))
    docs = X.read(spark, d, "documents").select("doc_id", code.alias("code"), target.alias("target"))
    name = T.lang_name(F.col("code"))
    return docs.select("doc_id", T.normalize_lang_code(F.col("code")).alias("norm"), name.alias("name"), T.lang_name_to_code(name).alias("back"), T.select_engine(F.col("code"), F.col("target")).alias("engine"))


_PHRASES = rf"list_filter(string_split_regex({S.strip('text')}, '[。、！？!?,.\x20\x09-\x0D]+'), lambda x: length(x) >= 2)"


@query(
    rf"""WITH t AS (SELECT doc_id, {S.strip('text')} AS s, {_PHRASES} AS p, regexp_extract_all({S.strip('text')}, '"([^"]+)"', 1) AS q, {S.sentences('text')} AS z FROM documents),
u AS (SELECT *, list_transform(CASE WHEN len(q) > 0 THEN q ELSE z END, lambda x: lower({S.strip('x')})) AS y FROM t)
SELECT doc_id, {S.repeats('p', 3)} AS glitch, s = '' OR (len(y) > 2 AND {S.repeats('y', 4)}) AS repetitive FROM u"""
)
def p14_glitch_flags(spark, d):
    docs = X.read(spark, d, "documents")
    return docs.select("doc_id", T.is_glitch(F.col("text")).alias("glitch"), T.is_repetitive_input(F.col("text")).alias("repetitive"))


@query(
    f"""WITH {S.F5}, s AS (SELECT *, {S.strip('text_src')} AS t, CASE segno % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'fr' END AS src, CASE segno % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Japanese' ELSE 'French' END AS nm FROM f5)
SELECT video_id, segno, {S.strip('text_tgt')} IN ('翻訳エラー', '（繰り返し音声）', '繰り返し音声エラー') AS failed,
  '<s><|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) ||
  CASE WHEN src = 'en' THEN 'Translate the following English text into Japanese.' ELSE 'Translate the following text.' END || chr(10) || chr(10) || t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS cat,
  '<start_of_turn>user' || chr(10) || 'You are a professional ' || nm || ' (' || src || ') to Japanese (ja) translator. Your goal is to accurately convey the meaning and nuances of the original ' || nm ||
  ' text while adhering to Japanese grammar, vocabulary, and cultural sensitivities.' || chr(10) || 'Produce only the Japanese translation, without any additional explanations or commentary. Please translate the following ' || nm ||
  ' text into Japanese:' || chr(10) || chr(10) || chr(10) || t || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS gemma, t AS cleaned
FROM s"""
)
def p17_prompts(spark, d):
    k = F.col("segno") % 3
    s = X.translated(spark, d).withColumn("src", F.when(k == 0, F.lit("en")).when(k == 1, F.lit("ja")).otherwise(F.lit("fr")))
    t, ja = F.col("text_src"), F.lit("ja")
    noisy = F.concat(F.lit("<|im_start|> "), t, F.lit("<|im_end|>\n"))
    return s.select(
        "video_id",
        F.col("segno").cast("long").alias("segno"),
        T.is_error_placeholder(F.col("text_tgt")).alias("failed"),
        T.cat_prompt(t, F.col("src"), ja).alias("cat"),
        T.gemma_prompt(t, F.col("src"), ja).alias("gemma"),
        T.clean_model_output(noisy, T.CAT_TOKENS).alias("cleaned"),
    )


@query(
    f"""WITH {S.F7}, e AS (SELECT *, CASE secs % 4 WHEN 0 THEN ' VoxCPM2 ' WHEN 1 THEN 'irodori_tts' WHEN 2 THEN 'Irodori-TTS' ELSE 'other' END AS raw, secs % 2 = 0 AS sep, CASE secs % 3 WHEN 0 THEN 'en' ELSE 'ja' END AS tgt FROM media),
x AS (SELECT *, CASE secs % 4 WHEN 0 THEN 'voxcpm2' WHEN 3 THEN 'omnivoice' ELSE 'irodori' END AS engine FROM e)
SELECT video_id, 'v' || secs || '_xlDub.mp4' AS output, 'v' || secs || CASE WHEN sep THEN '' ELSE '_rawaudio' END AS work, engine, CASE WHEN engine = 'irodori' AND tgt <> 'ja' THEN 'irodori speaks ja only, not ' || tgt END AS error,
       'file ''it''\\''''s ' || path || '''' AS line,
       '{{"model":"irodori-tts","input":"say ' || secs || '","response_format":"wav","speed":1.0,"irodori":{{"ref_wav":"' || path || '","num_steps":8,"t_schedule_mode":"sway","sway_coeff":-1.0}}}}' AS request FROM x"""
)
def p25_media_names(spark, d):
    n = F.col("video_id").cast("long")
    raw = F.when(n % 4 == 0, F.lit(" VoxCPM2 ")).when(n % 4 == 1, F.lit("irodori_tts")).when(n % 4 == 2, F.lit("Irodori-TTS")).otherwise(F.lit("other"))
    target = F.when(n % 3 == 0, F.lit("en")).otherwise(F.lit("ja"))
    return X.media(spark, d).select(
        "video_id",
        T.output_name(F.col("path")).alias("output"),
        T.work_partition(F.col("path"), n % 2 == 0).alias("work"),
        T.normalize_tts_engine(raw).alias("engine"),
        T.pair_error(raw, target).alias("error"),
        T.concat_line(F.concat(F.lit("it's "), "path")).alias("line"),
        T.synthesis_request(F.concat(F.lit("say "), "video_id"), F.col("path")).alias("request"),
    )


# translation

_PENDING = f"({S.strip('text_tgt')} = '' OR {S.strip('text_tgt')} IN ('翻訳エラー', '（繰り返し音声）', '繰り返し音声エラー') OR {S.repeats('p', 3)})"
_F5P = f"{S.F5}, f5p AS (SELECT *, {_PHRASES.replace('text', 'text_tgt')} AS p FROM f5)"


@query(f"WITH {_F5P} SELECT video_id, segno FROM f5p WHERE {_PENDING}")
def f3_pending_translation(spark, d):
    out = X.translated(spark, d).filter(translate.needs_translation(F.col("text_tgt")))
    return out.select("video_id", F.col("segno").cast("long").alias("segno"))


_SAID = f"(src || ':' || lower({S.strip('text_src')}))"
_AGAIN = f"({S.repeats('y', 4)} AND len(y) > 2)"


_M1 = f"""m_a AS (SELECT *, regexp_extract_all({S.strip('text_src')}, '"([^"]+)"', 1) AS q, {S.sentences('text_src')} AS z, {_PHRASES.replace('text', _SAID)} AS pu FROM l),
m_b AS (SELECT *, list_transform(CASE WHEN len(q) > 0 THEN q ELSE z END, lambda x: lower({S.strip('x')})) AS y FROM m_a),
m_c AS (SELECT *, {_PENDING} AND NOT {_AGAIN} AND length({S.strip('text_src')}) % 17 = 0 AS failed FROM m_b)
SELECT video_id, segno, CASE WHEN NOT {_PENDING} OR failed THEN text_tgt WHEN {_AGAIN} THEN '（繰り返し音声）' WHEN {S.repeats('pu', 3)} THEN '翻訳エラー' ELSE {_SAID} END AS text_tgt, CASE WHEN failed THEN 'boom' END AS error FROM m_c"""


@query(f"WITH {_F5P}, l AS (SELECT *, CASE WHEN segno % 5 = 0 THEN 'fr' WHEN video_id % 3 = 0 THEN 'de' ELSE 'en' END AS src FROM f5p), {_M1}")
def m1_translate_segments(spark, d):
    """Every fifth segment and every third video has a language; each seventeenth length of a text fails."""
    return _translated(spark, d, None)


def _translated(spark, d, profiles):
    def translator(asked):
        bad = F.length("text") % 17 == 0
        return asked.withColumn("out", F.when(~bad, F.concat("source", F.lit(":"), F.lower("text")))).withColumn("error", F.when(bad, F.lit("boom")))

    s = X.translated(spark, d).withColumn("detected_lang", F.when(F.col("segno") % 5 == 0, F.lit("fr")).otherwise(F.lit("")))
    videos = s.filter("video_id % 3 = 0").select("video_id", F.lit("de").alias("video_lang")).distinct()
    out = translate.translate_segments(s, translator, videos=videos, profiles=profiles)
    return out.select("video_id", F.col("segno").cast("long").alias("segno"), "text_tgt", "error")


@query(
    f"""WITH {_F5P}, {_M3},
sq AS (SELECT video_id, segno, {S.strip('text_src')} AS s, ' ' || lower({S.spaces('text_src')}) || ' ' AS x FROM f5p),
sg AS (SELECT video_id, segno, substring(x, i, 3) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM sq WHERE length(s) >= 3) GROUP BY 1, 2, 3),
sgain AS (SELECT video_id, segno, p.lang, sum(sg.n * (ln((p.n + 0.5) / (total + 200.0)) - ln(0.5 / (total + 200.0)))) AS gain FROM sg JOIN p USING (gram) JOIN tot ON tot.lang = p.lang GROUP BY 1, 2, 3),
ssz AS (SELECT video_id, segno, sum(n) AS size FROM sg GROUP BY 1, 2),
ssc AS (SELECT video_id, segno, sgain.lang, round(gain + size * ln(0.5 / (total + 200.0)), 6) AS score FROM sgain JOIN ssz USING (video_id, segno) JOIN tot ON tot.lang = sgain.lang),
sbest AS (SELECT video_id, segno, arg_min(lang, row(-score, lang)) AS told FROM ssc GROUP BY 1, 2),
l AS (SELECT f5p.*, CASE WHEN segno % 5 = 0 THEN 'fr' WHEN video_id % 3 = 0 THEN 'de' ELSE coalesce(told, 'en') END AS src FROM f5p LEFT JOIN sbest USING (video_id, segno)), {_M1}"""
)
def m1_translate_detected(spark, d):
    """As m1_translate_segments, but the language of a text that no label tells is detected, by profiles trained on documents."""
    docs = X.read(spark, d, "documents").select("doc_id", "text", "lang")
    return _translated(spark, d, stage(language.train_profiles(docs), "profiles"))


_AT_LIMIT = f"rpad({S.strip('text')}, 1999 + CAST(doc_id % 3 AS INTEGER), 'abc. ') || 'z'"


@query(
    f"""WITH x AS (SELECT doc_id, {_AT_LIMIT} AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, k - 1 AS part_no, parts[k] AS part, "long" FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, length(s) > 2000 AS "long", CASE WHEN length(s) > 2000 THEN z ELSE [s] END AS parts
  FROM (SELECT doc_id, {S.strip('text')} AS s, {S.sentences('text')} AS z FROM x)))"""
)
def e3_split_at_limit(spark, d):
    """Texts of exactly 2,000, 2,001 and 2,002 characters."""
    docs = X.read(spark, d, "documents").filter("text is not null")
    text = F.concat(F.rpad(T.strip(F.col("text")), (F.col("doc_id") % 3 + 1999).cast("int"), F.lit("abc. ")), F.lit("z"))
    out = translate.split_long_text(docs.select("doc_id", text.alias("text")), ["doc_id"], "text")
    return out.select("doc_id", F.col("part_no").cast("long").alias("part_no"), "part", "long")


@query(f"SELECT doc_id, k - 1 AS part_no, parts[k] AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, CASE WHEN length(s) > 2000 THEN z ELSE [s] END AS parts FROM (SELECT doc_id, {S.strip('text')} AS s, {S.sentences('text')} AS z FROM documents)))")
def e3_split_long_text(spark, d):
    out = translate.split_long_text(X.read(spark, d, "documents"), ["doc_id"], "text")
    return out.select("doc_id", F.col("part_no").cast("long").alias("part_no"), "part")


@query(
    f"""WITH {S.F5}, old AS (SELECT * FROM f5 WHERE NOT (video_id % 3 = 0 AND segno = 1)), n AS (SELECT video_id FROM (SELECT video_id, count(*) AS n FROM f1 GROUP BY 1) JOIN (SELECT video_id, count(*) AS n FROM old GROUP BY 1) USING (video_id, n))
SELECT n1.video_id, n1.segno, coalesce(o.text_tgt, '') AS text_tgt FROM n1 LEFT JOIN (SELECT old.* FROM old JOIN n USING (video_id)) o USING (video_id, segno)"""
)
def j10_resume_translations(spark, d):
    stored = X.translated(spark, d).filter("not (video_id % 3 = 0 and segno = 1)").drop("segno")
    out = translate.resume_translations(X.segments(spark, d), stored)
    return out.select("video_id", F.col("segno").cast("long").alias("segno"), "text_tgt")


# synthesis


def _outputs(spark, d):
    s = F.col("segno")
    return X.tts_meta(spark, d).select("video_id", "segno", (s % 5 != 0).alias("file_exists"), F.when(s % 3 != 0, F.col("duration_sec")).otherwise(0.0).alias("duration_sec"), (s % 2 == 0).alias("in_meta"))


_ELIGIBLE = f"greatest(0, \"end\" - start) >= 0.35 AND {S.strip('text_tgt')} <> ''"


@query(f"WITH {S.F5}, f4 AS (SELECT * FROM n1 WHERE segno % 4 <> 0) SELECT video_id, segno FROM f5 WHERE {_ELIGIBLE} AND NOT (segno % 4 <> 0 AND segno % 5 <> 0 AND (segno % 2 = 0 OR segno % 3 <> 0))")
def f4_pending_synthesis(spark, d):
    return synth.pending_synthesis(X.translated(spark, d), _outputs(spark, d)).select("video_id", F.col("segno").cast("long").alias("segno"))


def _plan(spark, d):
    own, voice = _references(spark, d)
    return synth.synthesis_plan(X.translated(spark, d), own, voice)


_PLAN = f"""{S.F2}, {S.NUMBERED}, f5 AS (SELECT * REPLACE (CASE segno % 7 WHEN 0 THEN '' WHEN 1 THEN '翻訳エラー' WHEN 2 THEN 'xx xx xx' ELSE lower(text_src) END AS text_tgt) FROM n1), {_OWN}, {_CHOICE}, {_BEST}, {_PROMPT},
plan AS (SELECT f5.video_id, f5.segno, {S.spaces('text_tgt')} AS text, CASE WHEN o.segno IS NOT NULL THEN 'segment' ELSE 'speaker' END AS ref_level, coalesce(o.prompt_text, v.prompt_text) AS prompt_text, greatest(("end" - start) * 1.15, 0.5) AS target_sec
  FROM f5 LEFT JOIN picked o USING (video_id, segno) LEFT JOIN voice v ON v.video_id = f5.video_id AND v.speaker_id = f5.speaker_id WHERE {_ELIGIBLE} AND (o.segno IS NOT NULL OR v.speaker_id IS NOT NULL))"""


@query(f"WITH {_PLAN} SELECT video_id, segno, text, ref_level, prompt_text, {S.rounded('target_sec')} FROM plan")
def m2_synthesis_plan(spark, d):
    out = _plan(spark, d).select("video_id", F.col("segno").cast("long").alias("segno"), "text", "ref_level", "prompt_text", "target_sec")
    return _r(out, "target_sec")


def _attempts(plan):
    a = plan.select("video_id", "segno", "target_sec", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    k = (F.col("segno") + F.col("attempt") * 3) % 5
    dur = F.when(k == 0, F.lit(0.0)).when(k == 1, F.col("target_sec") * 2).otherwise(F.col("target_sec") * 1.1)
    return a.select("video_id", "segno", "attempt", F.format_string("a%d.flac", "attempt").alias("flac_path"), dur.alias("duration_sec"))


_RECONCILED = """
att AS (SELECT video_id, segno, a AS attempt, 'a' || a || '.flac' AS flac_path, CASE (segno + a * 3) % 5 WHEN 0 THEN 0 WHEN 1 THEN target_sec * 2 ELSE target_sec * 1.1 END AS duration_sec, target_sec, text FROM plan, (SELECT unnest([1, 2]) AS a)),
chk AS (SELECT *, CASE WHEN text = '' THEN 'empty_text' WHEN duration_sec <= 0 THEN 'no_audio' WHEN target_sec > 0 AND abs(duration_sec - target_sec) / target_sec > 0.5 THEN 'duration' END AS reason FROM att),
acc AS (SELECT video_id, segno, arg_min(row(flac_path, duration_sec, attempt, reason), row(CASE WHEN reason IS NULL THEN 0 ELSE 1 END, CASE WHEN reason IS NULL THEN attempt ELSE -attempt END)) AS x FROM chk GROUP BY 1, 2),
got AS (SELECT video_id, segno, x[1] AS flac_path, x[2] AS duration_sec, x[3] AS attempts, x[4] AS quality_reason FROM acc WHERE x[2] > 0)"""


@query(f"WITH {_PLAN}, {_RECONCILED} SELECT video_id, segno, flac_path, {S.rounded('duration_sec')}, attempts, quality_reason FROM got")
def m2_reconcile(spark, d):
    plan = stage(_plan(spark, d), "plan")
    out = synth.reconcile(plan, _attempts(plan)).withColumn("segno", F.col("segno").cast("long"))
    return _r(out, "duration_sec")


_USABLE = "(f5.segno % 4 <> 0 AND f5.segno % 5 <> 0 AND (f5.segno % 2 = 0 OR f5.segno % 3 <> 0))"
_LEFT = f"plan.segno IS NOT NULL AND NOT {_USABLE}"


@query(
    f"""WITH {_PLAN} SELECT f5.video_id, count(*) AS total, count(*) FILTER (NOT ({_LEFT} AND f5.segno % 11 = 4)) AS done_count,
count(*) FILTER ({_LEFT} AND f5.segno % 11 <> 4 AND f5.segno % 13 = 5) AS failed FROM f5 LEFT JOIN plan USING (video_id, segno) GROUP BY 1"""
)
def a8_synthesis_progress(spark, d):
    """A run that goes on: some planned segments were not tried yet, some clips came out empty, some are from an earlier run."""
    plan = stage(_plan(spark, d), "plan")
    empty = F.col("segno") % 13 == 5
    tries = _attempts(plan).filter("segno % 11 <> 4").withColumn("duration_sec", F.when(empty, F.lit(0.0)).otherwise(F.col("duration_sec")))
    return synth.synthesis_progress(X.translated(spark, d), _outputs(spark, d), plan, tries, synth.reconcile(plan, tries))


# sources and sinks


def _written(c):
    """Quoted numbers: whole ones, and for some rows with a fraction."""
    return F.when(F.col("idx") % 4 == 1, c.cast("decimal(18,1)").cast("string")).otherwise(c.cast("long").cast("string"))


def _whisper_docs(spark, d):
    """One recogniser document for each conversation."""
    s = X.segments(spark, d).withColumn("text", F.when(F.col("idx") % 9 == 4, F.lit(" ")).otherwise(F.concat(F.lit(" "), "text_src")))
    item = F.struct("idx", F.struct(_written(F.rint(F.col("start") * 1000)).alias("from"), F.when(F.col("idx") % 11 == 5, F.lit("0")).otherwise(_written(F.rint(F.col("end") * 1000))).alias("to")).alias("offsets"), "text")
    docs = s.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    lang = F.when(F.col("video_id") % 3 == 0, F.lit("German")).when(F.col("video_id") % 3 == 1, F.lit("klingon")).otherwise(F.lit(""))
    body = F.struct(F.struct(lang.alias("language")).alias("result"), F.transform("x", lambda x: F.struct(x["offsets"].alias("offsets"), x["text"].alias("text"))).alias("transcription"))
    return docs.select("video_id", F.to_json(body).alias("doc"))


@query("SELECT conv_id % 16 AS folder, CAST(33 * count(*) AS BIGINT) AS size FROM conversations GROUP BY 1")
def s1_scan_media(spark, d):
    """Bytes of media below each folder: a line of 33 for each turn, in files of two kinds, of which only one is media."""
    path = shared_path(spark, "media")
    lines = X.read(spark, d, "conversations").select((F.col("conv_id") % 16).alias("folder"), F.md5(F.coalesce("text", F.lit(""))).alias("line"))
    lines.write.partitionBy("folder").option("extension", "mkv").csv(f"{path}/in")
    lines.write.partitionBy("folder").text(f"{path}/in/notes")
    media = io.scan_media(spark, path).withColumn("folder", F.regexp_extract("path", r"/folder=(-?\d+)/", 1).try_cast("long"))
    return media.groupBy("folder").agg(F.sum("size").alias("size"))


@query(f"WITH {S.F7} SELECT 'v' || video_id AS video_id, true AS in_order FROM media")
def o1_media_order(spark, d):
    """Whether each listed file comes after the one before it, by path; one file for each video."""
    path = shared_path(spark, "media")
    m = X.media(spark, d).select(F.concat(F.lit("v"), "video_id").alias("video_id"), "path")
    keyed.write_documents(m.withColumnRenamed("path", "chunk"), path, ".mp4", "", "", "", [], folders=8)
    listed = stage(io.scan_media(spark, path).select("video_id", "path", F.monotonically_increasing_id().alias("at")), "listed")
    # places within each of the listing's partitions, and the last path of those before
    listed = listed.withColumn("part", F.shiftright("at", 33))
    ends = listed.groupBy("part").agg(F.max("path").alias("most")).withColumn("before", F.max("most").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    last = F.coalesce(F.lag("path").over(Window.partitionBy("part").orderBy("at")), "before", F.lit(""))
    return listed.join(ends, "part").select("video_id", (F.col("path") > last).alias("in_order"))


@query(
    f"""WITH {S.F1} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS idx, {S.rounded('start')}, round("end", 6) AS "end", {S.strip('text_src')} AS text_src,
CASE video_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'kl' ELSE '' END AS detected_lang FROM f1 WHERE idx % 9 <> 4 AND idx % 11 <> 5"""
)
def s2_whisper_json(spark, d):
    out = io.whisper_segments(_whisper_docs(spark, d))
    return _r(out.select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end", "text_src", "detected_lang"), "start", "end")


@query(
    f"""WITH {S.F1} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS turn_no, {S.rounded('start')}, round("end", 6) AS "end", printf('SPEAKER_%02d', CASE WHEN idx % 5 = 0 THEN 0 ELSE idx % 5 END) AS speaker
FROM f1 WHERE idx % 7 <> 3 AND idx % 8 <> 5"""
)
def s3_diarized_rows(spark, d):
    _, turns = io.read_diarized(_diarized(spark, d))
    return _r(turns.withColumn("turn_no", F.col("turn_no").cast("long")), "start", "end")


@query(
    f"""WITH {S.F1} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS idx, {S.rounded('start')}, round("end", 6) AS "end", {S.strip('text_src')} AS text_src, '' AS text_tgt,
printf('SPEAKER_%02d', CASE WHEN idx % 5 = 0 THEN 0 ELSE idx % 5 END) AS speaker_id, '' AS detected_lang FROM f1 WHERE idx % 7 <> 3 AND idx % 8 <> 5"""
)
def s3_diarized_segments(spark, d):
    segments, _ = io.read_diarized(_diarized(spark, d))
    return _r(segments.withColumn("idx", F.col("idx").cast("long")), "start", "end")


def _diarized(spark, d):
    """Recogniser rows with remarks, missing speakers and speakers that are no numbers."""
    k = F.col("idx")
    return X.segments(spark, d).select(
        "video_id",
        k.alias("pos"),
        F.when(k % 7 == 3, F.lit(" [music] ")).otherwise(F.col("text_src")).alias("text"),
        F.when(k % 8 == 5, F.lit(None).cast("string")).when(k % 5 == 0, F.lit("who")).otherwise((k % 5).cast("string")).alias("speaker_id"),
        "start",
        "end",
    )


@query(f"WITH RECURSIVE {S.F1}, {S.G1} SELECT video_id, idx, text_src, (SELECT CAST(0 AS BIGINT)) AS late FROM g1")
def o1_bucketed_merge(spark, d):
    """Segments stored by video and order, merged without an exchange, beside the stored rows that are out of order."""
    name = f"segments_{uuid.uuid4().hex}"
    table = tables.save_by_video(X.segments(spark, d), name, shared_path(spark, "bucketed"), ("idx",), 8)
    late = tables.out_of_order(table, ("idx",)).agg(F.sum("n").alias("late"))  # one row
    return shape.merge_segments(table).select("video_id", F.col("idx").cast("long").alias("idx"), "text_src").crossJoin(F.broadcast(late))


@query(f"WITH RECURSIVE {S.F1}, {S.G1}, {S.G2}, {S.E1}, {S.G3} SELECT stage, CAST(sum(n) AS BIGINT) AS n FROM ({_FUNNEL}) GROUP BY stage")
def a7_observed_funnel(spark, d):
    """Counts of all steps from one run over the units, which are written; one row a step."""
    units, seen = shape.observed_shape(X.segments(spark, d))
    stage(units, "units")
    return spark.createDataFrame([(name, o.get["n"]) for name, o in seen.items()], "stage string, n bigint")


@query(
    f"""WITH {S.F1} SELECT CAST(video_id AS VARCHAR) AS video_id, idx, {S.rounded('start')}, round("end", 6) AS "end", text_src, CASE WHEN idx % 2 = 0 THEN '' ELSE 't' || idx END AS text_tgt, speaker_id FROM f1"""
)
def s4_stored_segments(spark, d):
    """Written as JSON documents, a file for each video, and read again; even rows use the older column."""
    s = X.segments(spark, d)
    old = F.col("idx") % 2 == 0
    item = F.struct("idx", "start", "end", F.when(~old, F.col("text_src")).alias("text_src"), F.when(old, F.col("text_src")).alias("text_en"), F.when(~old, F.concat(F.lit("t"), F.col("idx").cast("string"))).otherwise(F.lit("")).alias("text_tgt"), "speaker_id")
    docs = s.groupBy("video_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("doc"))
    # in some videos every number is quoted; a document that is no list gives no rows
    quoted = F.regexp_replace("doc", r'"(idx|start|end)":([-0-9.E]+)', r'"$1":"$2"')
    docs = docs.select(F.col("video_id").cast("string").alias("video_id"), F.when(F.col("video_id") % 3 == 1, quoted).otherwise(F.col("doc")).alias("doc"))
    out = io.stored_segments(docs.unionByName(docs.select(F.concat(F.lit("x"), "video_id").alias("video_id"), F.lit("{}").alias("doc"))))
    return _r(out.select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end", "text_src", "text_tgt", "speaker_id"), "start", "end")


@query(f"WITH {S.F1} SELECT video_id, idx, {S.rounded('start')}, round(\"end\", 6) AS \"end\", text_src, text_tgt, speaker_id, detected_lang FROM f1")
def s5_write_segments(spark, d):
    path = shared_path(spark, "segments")
    io.write_segments(X.segments(spark, d), path)
    return _r(spark.read.parquet(path).withColumn("idx", F.col("idx").cast("long")), "start", "end")


@query(f"WITH {S.F1} SELECT CAST(video_id AS VARCHAR) AS video_id, idx, {S.rounded('start')}, round(\"end\", 6) AS \"end\", text_src, text_tgt, speaker_id, detected_lang FROM f1")
def s5_segment_documents(spark, d):
    """Written as a document for each video, the second third of the videos as an update, and read by the reader of S4."""
    path, s = shared_path(spark, "segments"), X.segments(spark, d)
    late = F.col("video_id") % 3 == 1
    io.write_segments(s.withColumn("text_src", F.when(late, F.lit("early")).otherwise(F.col("text_src"))), path, "json")
    io.write_segments(s.filter(late), path, "json", update=True)
    return _r(io.read_segments(spark, path).withColumn("idx", F.col("idx").cast("long")), "start", "end")


_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(
    f"""WITH {S.F1}, c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n, CAST(round_even(start * 1000, 0) AS BIGINT) AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) AS b, {S.spaces('text_src')} AS t FROM f1)
SELECT video_id, string_agg(n || chr(10) || {_STAMP.format('a')} || ' --> ' || {_STAMP.format('b')} || chr(10) || t, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt_text FROM c GROUP BY video_id"""
)
def s6_srt(spark, d):
    return io.to_srt(X.segments(spark, d))


@query(ORACLE_SQL["s6_srt"].replace("SELECT video_id, string_agg", "SELECT CAST(video_id AS VARCHAR) AS video_id, string_agg"))
def s6_srt_files(spark, d):
    path = shared_path(spark, "srt")
    io.write_srt(X.segments(spark, d), path)
    return keyed.read_documents(spark, path).withColumnRenamed("doc", "srt_text")


@query(f"WITH {S.F4} SELECT CAST(video_id AS VARCHAR) AS video_id, segno, flac_path, {S.rounded('duration_sec')} FROM f4")
def s7_tts_meta_files(spark, d):
    path = shared_path(spark, "meta")
    io.write_tts_meta(X.tts_meta(spark, d), path)
    return _r(io.read_tts_meta(spark, path).withColumn("segno", F.col("segno").cast("long")), "duration_sec")


@query(f"WITH {S.F4} SELECT video_id, segno, CASE WHEN segno % 6 = 1 THEN 'new_' ELSE '' END || flac_path AS flac_path, {S.rounded('duration_sec')} FROM f4 WHERE segno % 10 <> 3")
def s7_tts_meta(spark, d):
    m = X.tts_meta(spark, d)
    bad = F.col("segno") % 10 == 3
    rows = m.select("video_id", F.lit(0).alias("pos"), "segno", "flac_path", F.when(bad, F.lit(0.0)).otherwise(F.col("duration_sec")).alias("duration_sec"))
    again = m.filter("segno % 6 = 1 and segno % 10 <> 3").select("video_id", F.lit(1).alias("pos"), "segno", F.concat(F.lit("new_"), "flac_path").alias("flac_path"), "duration_sec")
    return _r(io.valid_tts_meta(rows.unionByName(again)).withColumn("segno", F.col("segno").cast("long")), "duration_sec")


@query(f"WITH {S.F1}, {S.NUMBERED}, {_OWN} SELECT video_id, segno, CASE WHEN segno % 4 = 0 THEN 'new' ELSE prompt_text END AS prompt_text FROM own WHERE segno % 9 <> 8")
def s8_upsert_ref_meta(spark, d):
    own = speakers.segment_refs(X.segments(spark, d)).withColumn("key", F.when(F.col("segno") % 9 == 8, F.lit("seg")).otherwise(F.col("segno").cast("string"))).drop("segno")
    own = own.dropDuplicates(["video_id", "key"])
    new = own.filter(F.col("key").try_cast("int") % 4 == 0).withColumn("prompt_text", F.lit("new"))
    out = io.segment_keys(io.upsert_ref_meta(own, new))
    return out.select("video_id", F.col("segno").cast("long").alias("segno"), "prompt_text")


@query(f"WITH {S.F2} SELECT CAST(video_id AS VARCHAR) AS video_id, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM f2 GROUP BY 1")
def s9_turns(spark, d):
    path = shared_path(spark, "turns")
    X.turns(spark, d).withColumn("video_id", F.col("video_id").cast("string")).write.parquet(path)
    return io.turn_counts(io.read_turns(spark, path))


# progress


@query(f"WITH {S.F7} SELECT m.video_id, m.path, m.size, CASE WHEN l.video_id IS NULL THEN 'new' WHEN l.size = m.size THEN 'resume' ELSE 'changed' END AS state FROM media m LEFT JOIN led l USING (video_id)")
def j7_changed_inputs(spark, d):
    return ledger.changed_inputs(X.media(spark, d), X.ledger_documents(spark, d)).drop("mtime")


@query(
    f"""WITH {S.F7} SELECT m.video_id, CASE WHEN l.size = m.size THEN 'true' ELSE 'false' END AS asr_done, CASE WHEN m.secs % 2 = 0 THEN 'true' WHEN l.size = m.size THEN NULL ELSE 'false' END AS mux_done,
CASE WHEN l.size = m.size THEN m.video_id || '.json' END AS segments FROM media m LEFT JOIN led l USING (video_id)"""
)
def s10_ledger(spark, d):
    path = shared_path(spark, "ledger")
    io.write_ledger(X.ledger_documents(spark, d), path)
    docs = ledger.open_ledger(X.media(spark, d), io.read_ledger(spark, path))
    updates = X.media(spark, d).filter("cast(video_id as long) % 2 = 0").select("video_id", F.create_map(F.lit("mux_done"), F.lit("true")).alias("entries"))
    docs = ledger.set_entries(docs, updates, "steps")
    return docs.select("video_id", F.try_element_at("steps", F.lit("asr_done")).alias("asr_done"), F.try_element_at("steps", F.lit("mux_done")).alias("mux_done"), F.try_element_at("artifacts", F.lit("segments")).alias("segments"))


@query(f"WITH {S.F7} SELECT video_id, path || '#' || CASE WHEN secs % 5 = 0 THEN 4 ELSE secs % 5 END AS path, 'true' AS asr_done FROM media")
def s10_ledger_log(spark, d):
    """Five parts, a fifth of the videos in each of them and the others in one; a snapshot is made after the third."""
    path, m, n = shared_path(spark, "ledger"), X.media(spark, d), F.col("video_id").cast("long") % 5
    for k in range(5):
        part = m.filter((n == k) | (n == 0)).withColumn("path", F.concat("path", F.lit(f"#{k}")))
        ledger_log.write_part(ledger.finished(part, "asr_done", F.timestamp_millis(F.lit(k))), path)
        if k == 2:
            ledger_log.compact(spark, path)
    return io.read_ledger(spark, path).select("video_id", "video.path", F.try_element_at("steps", F.lit("asr_done")).alias("asr_done"))


@query(f"WITH {S.F7} SELECT video_id, path FROM media WHERE secs % 4 <> 1")
def f5_unfinished_media(spark, d):
    m = X.media(spark, d)
    outputs = m.filter("cast(video_id as long) % 4 = 1").select(F.regexp_replace("path", r"\.mp4$", params.OUTPUT_SUFFIX).alias("path"))
    return ledger.unfinished_media(m, outputs).select("video_id", "path")


@query(f"WITH {S.F7} SELECT video_id, 'decode' AS error, (SELECT count(*) FROM media) AS n_videos, (SELECT count(*) FILTER (secs % 50 = 7) FROM media) AS n_failed FROM media WHERE secs % 50 = 7")
def a9_batch_outcome(spark, d):
    """Every failed video as a row, beside the two counts."""
    results = X.media(spark, d).withColumn("error", F.when(F.col("video_id").cast("long") % 50 == 7, F.lit("decode")))
    return ledger.failed_videos(results).crossJoin(F.broadcast(ledger.batch_outcome(results)))  # one row


_FAULTS = (
    (0, "not JSON"),
    (1, "not an object"),
    (2, "unexpected types"),
    (3, "unexpected types"),
    (4, "an entry that is no object"),
    (5, "no segments"),
    (6, "not JSON"),
    (7, "empty file"),
    (8, "an offset that is no number"),
)


@query(
    f"""WITH {S.F1}, v AS (SELECT DISTINCT video_id AS v FROM f1),
e AS (SELECT CAST(v AS VARCHAR) AS video_id, CASE v % 13 {' '.join(f"WHEN {k} THEN '{e}'" for k, e in _FAULTS)} END AS w, CASE v % 7 WHEN 2 THEN 'not a list' WHEN 4 THEN 'not JSON' END AS s FROM v)
SELECT video_id, least(coalesce(w, s), coalesce(s, w)) AS error, (SELECT count(*) FROM e) AS n_videos, (SELECT count(*) FROM e WHERE coalesce(w, s) IS NOT NULL) AS n_failed FROM e WHERE coalesce(w, s) IS NOT NULL"""
)
def a9_unreadable_files(spark, d):
    """Recogniser and segment documents in files, many of them broken: the failed videos with their errors, beside the counts."""
    heard, kept = shared_path(spark, "heard"), shared_path(spark, "kept")
    docs, k = _whisper_docs(spark, d), F.col("video_id") % 13
    broken = {
        0: F.expr("substr(doc, 1, length(doc) - 5)"),
        1: F.concat(F.lit("["), "doc", F.lit("]")),
        2: F.lit('{"transcription": "x"}'),
        3: F.lit('{"transcription": ["x"]}'),
        4: F.lit('{"transcription": [null]}'),
        5: F.lit('{"transcription": []}'),
        6: F.concat("doc", F.lit(" {}")),
        7: F.lit(" "),
        8: F.lit('{"transcription": [{"offsets": {"from": "soon", "to": 9}, "text": "a"}]}'),
    }
    chunk = F.coalesce(*(F.when(k == n, c) for n, c in broken.items()), F.col("doc"))
    keyed.write_documents(docs.select("video_id", chunk.alias("chunk")), heard, ".json", "", "", "", [])
    stored = docs.select("video_id", F.when(F.col("video_id") % 7 == 2, F.lit("{}")).when(F.col("video_id") % 7 == 4, F.lit('[{"idx": 1},')).otherwise(F.lit("[]")).alias("chunk"))
    keyed.write_documents(stored, kept, ".json", "", "", "", [])
    errors = ledger.video_errors(io.whisper_errors(keyed.read_documents(spark, heard)), io.document_errors(keyed.read_documents(spark, kept)))
    results = keyed.read_documents(spark, heard).select("video_id").join(errors, "video_id", "left")
    return ledger.failed_videos(results).crossJoin(F.broadcast(ledger.batch_outcome(results)))  # one row


_CASES = """
cases AS (SELECT (a.i * 2 + b.i) * 3 + c.i AS case_no, 'asr-' || a.v || '__audio-' || b.v || '__tts-' || c.v AS case_id
  FROM (VALUES (0, 'vibevoice'), (1, 'whisper')) a(i, v), (VALUES (0, 'separated'), (1, 'rawaudio')) b(i, v), (VALUES (0, 'omnivoice'), (1, 'voxcpm2'), (2, 'irodori')) c(i, v))"""


@query(
    f"""WITH {S.F7}, {_CASES}, r AS (SELECT case_id, CASE WHEN (secs + case_no) % 7 = 0 THEN NULL ELSE (secs + case_no) % 4 END AS code, (secs + case_no) % 3 <> 0 AS there FROM media, cases)
SELECT case_id, count(*) AS total, count(*) FILTER (coalesce(code, 1) = 0 AND there) AS passed, count(*) FILTER (NOT (coalesce(code, 1) = 0 AND there)) AS failed FROM r GROUP BY 1"""
)
def a10_matrix_summary(spark, d):
    """Every configuration for every media file: the grid (J9) has twelve rows, so each file meets them by a broadcast."""
    grid = F.broadcast(ledger.case_grid(spark))
    n = F.col("video_id").cast("long") + F.col("case_no")
    results = X.media(spark, d).crossJoin(grid).select("case_id", F.when(n % 7 != 0, n % 4).alias("returncode"), (n % 3 != 0).alias("output_exists"))
    return ledger.matrix_summary(results, "case_id")


@query(f"WITH {S.F7} SELECT video_id, 'true' AS asr_done, size + CASE WHEN secs % 10 = 4 THEN 1 ELSE 0 END AS n FROM media")
def t1_resumed_runs(spark, d):
    """Two runs over an inbox that grows in between; videos that come again are processed again only if they changed."""
    inbox, out, book, check = (shared_path(spark, x) for x in ("inbox", "out", "book", "check"))
    schema = "video_id string, path string, size bigint, mtime timestamp"
    m = X.media(spark, d)
    process = lambda rows: rows.select("video_id", F.col("size").alias("n"))
    for k in (0, 1):
        # the second arrival repeats a part of the first one, and another part with a new size
        again = m.filter(f"cast(video_id as long) % 2 = {k} or cast(video_id as long) % 30 = 0")
        new = m.filter(f"{k} = 1 and cast(video_id as long) % 10 = 4").withColumn("size", F.col("size") + 1)
        again.unionByName(new).write.mode("append").parquet(inbox)
        resume.run_available(spark, inbox, schema, out, book, check, process)
    done = io.read_ledger(spark, book).select("video_id", F.try_element_at("steps", F.lit("asr_done")).alias("asr_done"))
    result = resume.read_results(spark, out, "n bigint, video_id string", book)
    return done.join(result, "video_id").select("video_id", "asr_done", "n")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Speakers assigned, fragments merged, and each video's inventory."""
    named = speakers.assign_speakers(X.segments(spark, d), X.turns(spark, d))
    return speakers.speaker_inventory(shape.merge_segments(named)).withColumn("speakers", F.array_join("speakers", ","))
