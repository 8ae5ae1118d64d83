"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.llm import chat_format, conversation_trie, hard_negatives, license_scan, line_rules, lm_score, minhash_dedup, mixing, packing, pq_dedup, quality_crf, secret_scan, substring_dedup


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.expand_replies(conversations.unionByName(extra)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_passages(_read(spark, sf_dir, "documents"), with_text=False, stored=True)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_into_pieces(_read(spark, sf_dir, "documents"), with_ids=False))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_crf.score_documents(docs, quality_crf.train(docs, _read(spark, sf_dir, "labels")))


def op7_cross_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_line_rules(_read(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", mixing.count_tokens(F.col("text")).alias("n_tokens"), "copies")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_read(spark, sf_dir, "documents")))


def op10_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find_licenses(_read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pq_near_dedup,
        op2_prefix_target_chat,
        op3_substring_dedup,
        op4_vector_best_fit,
        op5_cross_entropy_difference,
        op6_line_crf_quality,
        op7_cross_document_lines,
        op8_temperature_mixing,
        op9_secret_scan,
        op10_bayes_minhash,
        op11_conversation_trie,
        op12_hard_negatives,
        op13_license_scan,
    )
}

_ESCAPED = "replace(replace({0}, '%', '%25'), '<|', '%3C|')"

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_pq_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), c AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT c.node, e.v FROM c JOIN e ON e.u = c.reach
), m AS (
  SELECT node, min(reach) AS component_id FROM c GROUP BY node
), n AS (
  SELECT u, count(*) AS n FROM e GROUP BY u
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON u = vec_id""",
    "op7_cross_document_lines": rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 5)) AS x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, {_SPACES}, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, {_SPACES}, '') <> '') AS lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), l AS (
  SELECT doc_id, host, h, len(string_split(h, ' ')) AS n FROM (
    SELECT doc_id, host, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[ 	-
]+', ' ', 'g')) AS h FROM b
  ) WHERE h <> ''
), a AS (
  SELECT host, h FROM l JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM b GROUP BY host) USING (host) GROUP BY host, h, docs
  HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > least(0.02 * docs, 1000)
), x AS (
  SELECT doc_id, sum(n) AS gone FROM l JOIN a USING (host, h) GROUP BY doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(n_words - coalesce(gone, 0) AS BIGINT) AS words_left FROM b LEFT JOIN x USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, words_left,
       NOT base_failed AND words_left >= 10 AND 100 * words_left >= 30 * n_words AS kept
FROM f""",
    "op8_temperature_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n FROM documents
), s AS (
  SELECT coalesce(source, '') AS s, sum(n) AS tokens FROM d WHERE n > 0 GROUP BY 1
), p AS (
  SELECT list(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM s)) AS p FROM s
), b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS t, p FROM p
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN t ELSE lo END, CASE WHEN good THEN hi ELSE t END, (CASE WHEN good THEN t ELSE lo END + CASE WHEN good THEN hi ELSE t END) / 2, p
  FROM (
    SELECT *, len(p) = 1 OR ln(list_sum(list_transform(p, lambda x: pow(x, t)))) - list_sum(list_transform(p, lambda x: t * ln(x) * pow(x, t))) / list_sum(list_transform(p, lambda x: pow(x, t))) >= 0.95 * ln(len(p)) AS good FROM b
  ) WHERE i < 60
), e AS (
  SELECT lo AS t FROM b WHERE i = 60
), q AS (
  SELECT s, tokens, pow(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM s), (SELECT t FROM e)) AS raised FROM s
), w AS (
  SELECT s, tokens, raised / (SELECT sum(raised) FROM q) * (SELECT sum(tokens) FROM s) AS quota FROM q
), y AS (
  SELECT s, tokens, CAST(floor(quota / tokens + 1e-6) AS BIGINT) AS epochs, greatest(quota - floor(quota / tokens + 1e-6) * tokens - 1e-6 * tokens, 0) AS rest FROM w
), o AS (
  SELECT d.*, epochs, rest, s,
         CAST('0x' || substr(md5(concat_ws(':', '17', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) AS u
  FROM d LEFT JOIN y ON coalesce(source, '') = s
)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens,
       CASE WHEN n = 0 THEN 1 ELSE epochs + CAST(coalesce(sum(n) OVER (PARTITION BY s ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS BIGINT) END AS copies
FROM o""",
    "op2_prefix_target_chat": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         length(replace({_ESCAPED.format('role')}, chr(10), '%0A')) + length({_ESCAPED.format('text')}) + 24 AS f
  FROM c
), s AS (
  SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
FROM s GROUP BY conv_id""",
    "op3_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY md5(g)) AS first_doc FROM s
), r AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM f WHERE first_doc < doc_id GROUP BY doc_id
), k AS (
  SELECT d.doc_id, w, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op11_conversation_trie": """
WITH o AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g, chars) AS pos FROM o
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, pos, g, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE pos <= h
  UNION ALL SELECT conv_id, pos, g, chars FROM c JOIN t USING (conv_id) WHERE pos > h
), m AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS chars FROM c
  UNION ALL SELECT conv_id, row_number() OVER w, string_agg(g, '') OVER w, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, CASE WHEN depth > 0 THEN node[1 : 32 * (depth - 1)] END AS up FROM m GROUP BY node, depth
), k AS (
  SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), s AS (
  SELECT node[1 : 32 * d] AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved
  FROM (SELECT n.*, n_children, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k ON k.up = n.node) GROUP BY 1
), e AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.up LEFT JOIN k ON k.up = n.node JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS alike, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), p AS (
  SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY rank <= 5""",
    "op10_bayes_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[p : p + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), c AS (
  SELECT doc_id AS node, doc_id AS reach FROM d
  UNION SELECT c.node, e.v FROM c JOIN e ON e.u = c.reach
), m AS (
  SELECT node, min(reach) AS component_id FROM c GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id""",
}
