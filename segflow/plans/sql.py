"""DuckDB forms of the fixtures and of the order-dependent folds, as common table expressions."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D\x{3000}]+"


def strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^{WS}|{WS}$', '', 'g')"


def spaces(c: str) -> str:
    return rf"regexp_replace({strip(c)}, '{WS}', ' ', 'g')"


def sentences(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({strip(c)}, '([.!?]){WS}', concat('\1', chr(1)), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def stops(c: str) -> str:
    return rf"regexp_matches({strip(c)}, '[.!?。！？]$')"


def repeats(items: str, n: int) -> str:
    """Whether a list holds n equal items in a row."""
    same = " AND ".join(f"({items})[i] = ({items})[i + {k}]" for k in range(1, n))
    return f"len(list_filter(range(1, len({items}) - {n - 2}), lambda i: {same})) > 0"


def _fragments(table: str, key: str, order: str, extra: str) -> str:
    return f"""
  SELECT {key}, {extra}, k, array_to_string(ws[k * 6 + 1 : k * 6 + 6], ' ') AS t FROM (
    SELECT *, unnest(range(0, (len(ws) - 1) // 6 + 1)) AS k FROM (
      SELECT {key}, {order}, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS ws FROM {table} WHERE text IS NOT NULL
    ) WHERE len(ws) > 0)"""


def _timed(name: str, rows: str) -> str:
    return f"""
{name} AS (
  SELECT video_id, idx, CAST(c - dur AS DOUBLE) / 1000.0 AS start, CAST(c AS DOUBLE) / 1000.0 AS "end", t AS text_src, '' AS text_tgt, speaker_id, '' AS detected_lang FROM (
    SELECT *, sum(dur + (video_id * 31 + idx * 17) % 1500) OVER (PARTITION BY video_id ORDER BY idx) AS c FROM (SELECT *, 200 + 60 * length(t) AS dur FROM {rows})
  )
)"""


F1 = (
    "f1_rows AS (SELECT conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS idx, role AS speaker_id, t FROM ("
    + _fragments("conversations", "conv_id", "turn, role", "turn, role")
    + ")),"
    + _timed("f1", "f1_rows")
)
F2 = F1 + """,
f2 AS (SELECT video_id, idx AS turn_no, start - 0.3 AS start, "end" - 0.2 AS "end", speaker_id AS speaker FROM f1
       WHERE idx % 5 <> 3 AND video_id % 10 <> 7 AND NOT (video_id % 10 = 3 AND idx < 2))"""
F3 = (
    "f3_rows AS (SELECT doc_id AS video_id, k AS idx, 'S' || CAST((k // 25) % 3 AS VARCHAR) AS speaker_id, t FROM ("
    + _fragments("documents", "doc_id", "1 AS one", "one")
    + ")),"
    + _timed("f3", "f3_rows")
)
NUMBERED = "n1 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS segno FROM f1)"
F4 = F1 + f""",
{NUMBERED},
f4 AS (SELECT video_id, segno, 'seg_' || lpad(CAST(segno AS VARCHAR), 5, '0') || '.flac' AS flac_path, CAST(500 + (segno * 137 + video_id * 11) % 4000 AS DOUBLE) / 1000.0 AS duration_sec FROM n1 WHERE segno % 4 <> 0),
dur AS (SELECT video_id, max("end") + video_id % 4 * CAST(0.07 AS DOUBLE) AS video_dur FROM f1 GROUP BY video_id)"""
F5 = F1 + f""",
{NUMBERED},
f5 AS (SELECT * REPLACE (CASE segno % 7 WHEN 0 THEN '' WHEN 1 THEN '翻訳エラー' WHEN 2 THEN 'xx xx xx' ELSE lower(text_src) END AS text_tgt) FROM n1)"""
F7 = """
media AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, 'in/v' || conv_id || '.mp4' AS path, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size, conv_id AS secs FROM conversations GROUP BY conv_id),
led AS (SELECT video_id, CASE WHEN secs % 3 = 1 THEN size + 1 ELSE size END AS size, secs FROM media WHERE secs % 3 <> 0)"""


def edges(sql: str) -> str:
    """The same over F8: f1 is then made from f0."""
    return sql.replace(F1, F1.replace("\nf1 AS", "\nf0 AS") + F8)


F8 = """,
f0_lag AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY idx) AS b FROM f0),
f0_from AS (SELECT *, CASE WHEN idx % 7 = 2 THEN start - CAST(1.5 AS DOUBLE) WHEN idx % 19 = 6 AND b IS NOT NULL THEN b + CAST(0.85 AS DOUBLE) WHEN idx % 19 = 11 AND b IS NOT NULL THEN b + CAST(0.15 AS DOUBLE) ELSE start END AS a FROM f0_lag),
f1 AS (SELECT video_id, idx, a AS start,
              CASE WHEN idx % 17 = 3 THEN a WHEN idx % 17 = 8 THEN a - CAST(0.2 AS DOUBLE) WHEN idx % 11 = 1 THEN a + CAST(0.35 AS DOUBLE) WHEN idx % 11 = 5 THEN a + CAST(0.7 AS DOUBLE) ELSE greatest(a, "end") END AS "end",
              CASE WHEN idx % 13 = 4 THEN '' WHEN idx % 13 = 9 THEN ' ' || chr(12288) ELSE text_src END AS text_src, text_tgt, speaker_id, detected_lang FROM f0_from)"""


def wild(sql: str) -> str:
    """The same over F9: f1 is then made from f0."""
    return sql.replace(F1, F1.replace("\nf1 AS", "\nf0 AS") + F9)


F9 = """,
f1 AS (SELECT * REPLACE (CASE WHEN (idx + video_id) % 23 = 5 THEN "end" + 3600 WHEN (idx + video_id) % 29 = 7 THEN CAST('inf' AS DOUBLE) WHEN (idx + video_id) % 31 = 9 THEN CAST('nan' AS DOUBLE)
                              WHEN (idx + video_id) % 37 = 11 THEN CAST(1700000000 AS DOUBLE) WHEN (idx + video_id) % 41 = 13 THEN CAST(1700000000000 AS DOUBLE) ELSE "end" END AS "end") FROM f0)"""


def fold(name: str, source: str, joins: str, clean: str | None = None) -> str:
    """Greedy groups of ``source``; ``joins`` reads the state g (bs, be, n, cnt, stop) and the row s."""
    text = clean or strip("text_src")
    return f"""
{name}_s AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS pos, start, "end" AS stop_at, t, length(t) AS len, {stops('t')} AS stop, speaker_id, detected_lang
  FROM (SELECT *, {text} AS t FROM {source}) WHERE t <> ''
),
{name}_g AS (
  SELECT video_id, pos, 0 AS gid, start AS bs, stop_at AS be, len AS n, 1 AS cnt, stop, speaker_id FROM {name}_s WHERE pos = 1
  UNION ALL
  SELECT video_id, pos, CASE WHEN ok THEN gid ELSE gid + 1 END, CASE WHEN ok THEN bs ELSE start END, stop_at, CASE WHEN ok THEN n + 1 + len ELSE len END, CASE WHEN ok THEN cnt + 1 ELSE 1 END, stop, speaker_id
  FROM (SELECT s.*, g.gid, g.bs, g.n, g.cnt, g.speaker_id = s.speaker_id AND {joins} AS ok FROM {name}_g g JOIN {name}_s s ON s.video_id = g.video_id AND s.pos = g.pos + 1)
),
{name} AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY min(pos)) - 1 AS idx, arg_min(start, pos) AS start, arg_max(stop_at, pos) AS "end",
         string_agg(t, ' ' ORDER BY pos) AS text_src, any_value(s.speaker_id) AS speaker_id, coalesce(arg_min(detected_lang, pos) FILTER (detected_lang <> ''), '') AS detected_lang
  FROM {name}_s s JOIN {name}_g g USING (video_id, pos) GROUP BY video_id, gid
)"""


_GAP = "greatest(0, s.start - g.be)"
_DUR = "greatest(0, s.stop_at - g.bs)"
G1 = fold("g1", "f1", f"{_GAP} <= 0.85 AND {_DUR} <= 12 AND g.n + 1 + s.len <= 320 AND (greatest(0, g.be - g.bs) <= 0.7 OR greatest(0, s.stop_at - s.start) <= 0.7 OR NOT g.stop)")
G2 = fold("g2", "g1", f"{_GAP} <= 1.0 AND {_DUR} <= 18 AND g.n + 1 + s.len <= 1100")
E1 = f"""
e1_a AS (SELECT *, {sentences('text_src')} AS parts FROM g2),
e1_b AS (SELECT * REPLACE (CASE WHEN len(parts) <= 1 OR "end" <= start THEN [text_src] ELSE parts END AS parts) FROM e1_a),
e1_c AS (SELECT video_id, idx, start, "end", speaker_id, detected_lang, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS t FROM e1_b),
e1_d AS (SELECT *, CAST(greatest(1, length(regexp_replace(t, '{WS}', '', 'g'))) AS DOUBLE) AS w FROM e1_c),
e1_e AS (SELECT *, sum(w) OVER (PARTITION BY video_id, idx ORDER BY k) AS upto, sum(w) OVER (PARTITION BY video_id, idx) AS total FROM e1_d),
e1_f AS (SELECT *, CASE WHEN n = 1 THEN start ELSE greatest(start, least(start + ("end" - start) * ((upto - w) / total), "end")) END AS a,
                CASE WHEN n = 1 OR k = n THEN "end" ELSE start + ("end" - start) * (upto / total) END AS b FROM e1_e),
e1 AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx, k) - 1 AS idx, a AS start, CASE WHEN n = 1 THEN "end" ELSE greatest(a, least(b, "end")) END AS "end", {spaces('t')} AS text_src, speaker_id, detected_lang FROM e1_f)"""
G3 = fold("g3", "e1", f"g.cnt < 2 AND {_GAP} <= 1.20 AND g.n + 1 + s.len <= 300", spaces("text_src"))

_NUMBERS = "NOT isnan(s.start) AND NOT isnan(s.\"end\")"

OVERLAP = f"""
ov AS (SELECT s.video_id, s.idx, t.speaker, round(sum(least(s."end", t."end") - greatest(s.start, t.start)), 6) AS overlap, min(turn_no) AS first_turn
       FROM f1 s JOIN f2 t ON s.video_id = t.video_id AND least(s."end", t."end") > greatest(s.start, t.start) AND {_NUMBERS} AND NOT isnan(t.start) AND NOT isnan(t."end") GROUP BY 1, 2, 3)"""

ACCEPTED = """
acc0 AS (SELECT video_id, segno, vd, least(greatest(0, start), vd) AS start, least(greatest(greatest(0, start), "end"), vd) AS "end" FROM n1 JOIN (SELECT video_id, greatest(0, video_dur) AS vd FROM dur) USING (video_id)),
acc1 AS (SELECT *, coalesce(max("end") OVER (PARTITION BY video_id ORDER BY segno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM acc0),
acc AS (SELECT * FROM acc1 WHERE cur < vd - 1e-6 AND "end" > cur + 1e-6)"""


def parts(absorb: bool) -> str:
    tiny = (lambda c: f"coalesce({c} < 0.15, false)") if absorb else (lambda c: "false")
    return f"""{ACCEPTED},
sp0 AS (SELECT acc.*, duration_sec, coalesce(duration_sec, greatest(0.001, "end" - start)) AS out, CASE WHEN duration_sec IS NULL THEN 1.0 ELSE greatest(0.001, "end" - start) / greatest(0.001, duration_sec) END AS speed,
               CASE WHEN start > cur + 1e-6 THEN start - cur END AS gap, lead(segno) OVER (PARTITION BY video_id ORDER BY segno) AS nxt FROM acc LEFT JOIN f4 USING (video_id, segno)),
sp AS (SELECT *, CASE WHEN nxt IS NULL AND vd > "end" + 1e-6 THEN vd - "end" END AS tail FROM sp0),
pt0 AS (
  SELECT video_id, segno AS o, 0 AS k, 'gap' AS kind, cur AS orig_start, start AS orig_end, gap AS out_duration, CAST(1 AS DOUBLE) AS speed, 0 AS segno FROM sp WHERE gap IS NOT NULL AND NOT {tiny('gap')}
  UNION ALL SELECT video_id, segno, 1, 'speech', a, b, out, CASE WHEN {tiny('gap')} OR {tiny('tail')} THEN greatest(0.001, b - a) / greatest(0.001, out) ELSE speed END, segno
    FROM (SELECT *, CASE WHEN {tiny('gap')} THEN cur ELSE start END AS a, CASE WHEN {tiny('tail')} THEN vd ELSE "end" END AS b FROM sp)
  UNION ALL SELECT video_id, segno, 2, 'tail', "end", vd, tail, 1, 0 FROM sp WHERE tail IS NOT NULL AND NOT {tiny('tail')}
),
pt AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY o, k) AS part_no, kind, orig_start, orig_end, out_duration, speed, segno FROM pt0)"""


def rounded(*columns: str) -> str:
    return ", ".join(f'round({c}, 6) AS {c}' for c in columns)
