"""Registered queries of the text-collection operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, cross_align, decontamination, kd_sharding, language_crf, line_dedup, near_dedup, packing, pivot_search, rotated_codes, secret_scan, substring_dedup, turn_repair


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), width=13)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), words=3, num=85, den=100)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify_language(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_read(spark, sf_dir, "conversations"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard_by_tree(_read(spark, sf_dir, "documents"), shards=40)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(_read(spark, sf_dir, "conversations")))


def op13_rotated_code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_line_dedup": op3_line_dedup,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_secret_scan": op6_secret_scan,
        "op7_language_id": op7_language_id,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_kd_sharding": op10_kd_sharding,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_rotated_code_neighbours": op13_rotated_code_neighbours,
        "pipeline": pipeline,
    }


#: Windows are compared as lists of words; the SQL runs over whole tables.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT win.doc_id, win.i FROM win JOIN firsts USING (k) WHERE win.doc_id > least), range(0, 13) t(o)),
word AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: The rule by brute definition: equal words, or one word inserted, deleted or replaced (8 words at least).
OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM l),
f AS (SELECT w, min((doc_id, pos)) AS pl, len(w) AS n FROM w WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, pl, n, i, list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, n)) AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8)),
near AS (SELECT v.w FROM v JOIN (SELECT k, i, min(pl) AS m FROM v GROUP BY k, i) s USING (k, i) WHERE s.m < v.pl
         UNION SELECT v.w FROM v JOIN f ON v.k = f.w WHERE f.n >= 8 AND f.pl < v.pl
         UNION SELECT f.w FROM v JOIN f ON v.k = f.w WHERE f.n >= 8 AND v.pl < f.pl),
j AS (SELECT w.doc_id, w.pos, w.line, len(w.w) > 0 AND ((w.doc_id, w.pos) > f.pl OR near.w IS NOT NULL) AS gone
      FROM w LEFT JOIN f ON w.w = f.w LEFT JOIN near ON w.w = near.w)
SELECT d.doc_id, count(j.pos)::BIGINT AS n_lines, count(j.pos) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""

OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: The checksum bit by bit; then the cheapest edits, row by row from the last one.
OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 20 AS m FROM c),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
rw AS (SELECT *, blank OR again AS must, cut AND NOT blank AND NOT again AS short FROM f),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rw GROUP BY conv_id),
-- Costs, edits and lines that remain behind row i - 1, from nothing yet (z), after s, after u and after a.
b AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS z, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} AS s, {'c': 3, 'a': 'I', 't': ['assistant:']} AS u, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS a FROM n
  UNION ALL
  SELECT conv_id, i, list_min([z, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}, {'c': 6 + a.c, 'a': 'II' || a.a, 't': list_concat(['user:', 'assistant:'], a.t)}]),
    list_min([s, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}, {'c': 6 + a.c, 'a': 'II' || a.a, 't': list_concat(['user:', 'assistant:'], a.t)}]),
    list_min([u, {'c': 3 + a.c, 'a': 'I' || a.a, 't': list_prepend('assistant:', a.t)}]), list_min([a, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}])
  FROM (
    SELECT b.conv_id, rw.i, list_min([{'c': 4 + z.c, 'a': 'D' || z.a, 't': z.t}, {'c': CASE WHEN must OR r NOT IN ('s', 'u') THEN 999999999 ELSE x END + CASE r WHEN 's' THEN s.c ELSE u.c END, 'a': 'K' || CASE r WHEN 's' THEN s.a ELSE u.a END, 't': list_prepend(role || ':' || text, CASE r WHEN 's' THEN s.t ELSE u.t END)}, {'c': v + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}]) AS z,
      list_min([{'c': 4 + s.c, 'a': 'D' || s.a, 't': s.t}, {'c': CASE WHEN must OR r <> 'u' THEN 999999999 ELSE x END + u.c, 'a': 'K' || u.a, 't': list_prepend(role || ':' || text, u.t)}, {'c': v + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}]) AS s,
      list_min([{'c': 4 + u.c, 'a': 'D' || u.a, 't': u.t}, {'c': CASE WHEN must OR r <> 'a' THEN 999999999 ELSE x END + a.c, 'a': 'K' || a.a, 't': list_prepend(role || ':' || text, a.t)}, {'c': v + a.c, 'a': 'R' || a.a, 't': list_prepend('assistant:' || text, a.t)}]) AS u,
      list_min([{'c': 4 + a.c, 'a': 'D' || a.a, 't': a.t}, {'c': CASE WHEN must OR r <> 'u' THEN 999999999 ELSE x END + u.c, 'a': 'K' || u.a, 't': list_prepend(role || ':' || text, u.t)}, {'c': v + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}]) AS a
    FROM b JOIN (SELECT *, CASE WHEN short THEN 3 ELSE 0 END AS x, CASE WHEN must THEN 999999999 WHEN short THEN 6 ELSE 3 END AS v FROM rw) rw ON b.conv_id IS NOT DISTINCT FROM rw.conv_id AND rw.i = b.i - 1))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN b ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op3_line_dedup": OP3_SQL,
        "op9_exact_top_k": OP9_SQL,
        "op12_conversation_repair": OP12_SQL,
    }
