"""Queries over the corpus operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, centroid_lang, chat, ctph, curriculum, decision_list, gear_chunks, gnat_codes, kneser_ney, label_shards, overlap_join, pii, turn_repair
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, found = F.col("base"), F.col("found")
    number = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *map(number, pii.KINDS),
        F.sha2(pii.joined_spans(base), 256).alias("base_sha256"),
        pii.joined_spans(F.concat(base, found)).alias("spans"),
        F.size(found).cast("long").alias("n_found"),
    )


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_by_perplexity(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carried=False)
    place = lambda copy: F.round(F.get("positions", F.lit(copy)), 9).alias(f"position_{copy + 1}")
    return curriculum.by_first_position(mixed).select("doc_id", "size", "source_size", "target", "taken", *map(place, range(3)))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.examples(chat.conversations_of(rows.unionByName(extra))))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.shard(table(spark, sf_dir, "documents")).drop("linked")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compared(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("next_fingerprint")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row", "copy")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_lang.identified(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Query] = {
    "op1_personal_data": op1_personal_data,
    "op2_perplexity": op2_perplexity,
    "op3_quality_rules": op3_quality_rules,
    "op4_mix_sources": op4_mix_sources,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_overlap_join": op7_overlap_join,
    "op8_shards": op8_shards,
    "op9_fingerprints": op9_fingerprints,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language": op11_language,
    "op12_vector_codes": op12_vector_codes,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS spot
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS source_rank FROM totals),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3 * source_size AS ceiling FROM ranked),
filling AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ceiling / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
leveled AS (SELECT min_by(level, ceiling / weight) AS level FROM filling WHERE level * weight <= ceiling),
targets AS (SELECT w.source, w.source_size, w.source_rank, least(w.ceiling::DOUBLE, l.level * w.weight) AS target FROM weighed w, leveled l),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.source_rank,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spot, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN size > 0 AND start + size / 2 <= target THEN (start + size / 2) / target END AS share_1,
         CASE WHEN size > 0 AND source_size + start + size / 2 <= target THEN (source_size + start + size / 2) / target END AS share_2,
         CASE WHEN size > 0 AND 2 * source_size + start + size / 2 <= target THEN (2 * source_size + start + size / 2) / target END AS share_3
  FROM placed)
SELECT doc_id, size, source_size, target,
       (size * ((share_1 IS NOT NULL)::INT + (share_2 IS NOT NULL)::INT + (share_3 IS NOT NULL)::INT))::BIGINT AS taken,
       round(CASE source_rank % 3 WHEN 0 THEN (7 - sqrt(49 - 40 * share_1)) / 4 WHEN 1 THEN share_1 ELSE (sqrt(0.36 + 1.6 * share_1) - 0.6) / 0.8 END, 9)::DOUBLE AS position_1,
       round(CASE source_rank % 3 WHEN 0 THEN (7 - sqrt(49 - 40 * share_2)) / 4 WHEN 1 THEN share_2 ELSE (sqrt(0.36 + 1.6 * share_2) - 0.6) / 0.8 END, 9)::DOUBLE AS position_2,
       round(CASE source_rank % 3 WHEN 0 THEN (7 - sqrt(49 - 40 * share_3)) / 4 WHEN 1 THEN share_3 ELSE (sqrt(0.36 + 1.6 * share_3) - 0.6) / 0.8 END, 9)::DOUBLE AS position_3
FROM copies""",
    "op5_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length('<|turn|>') + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 1
         + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length('<|end|>') + 1 AS chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
prefixed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM marked)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM prefixed GROUP BY conv_id""",
    "op12_vector_codes": r"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS width, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS (
  SELECT k, (i - 1) // width AS p, (i - 1) % width AS c, floor(256 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT k, width, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)),
books0 AS (SELECT p, k - 1 AS e, c, x FROM comps WHERE k <= 64),
near0 AS (
  SELECT k, p, m % 64 AS e, m // 64 AS d FROM (
    SELECT k, p, min(d * 64 + e) AS m FROM (
      SELECT v.k, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM comps v JOIN books0 b ON v.p = b.p AND v.c = b.c GROUP BY ALL) GROUP BY ALL)),
books1 AS (
  SELECT b.p, b.e, b.c, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, b.x)::BIGINT AS x
  FROM books0 b LEFT JOIN (
    SELECT v.p, n.e, v.c, sum(v.x)::BIGINT AS total, count(*) AS n FROM comps v JOIN near0 n ON v.k = n.k AND v.p = n.p GROUP BY ALL) m
  ON b.p = m.p AND b.e = m.e AND b.c = m.c),
near1 AS (
  SELECT k, p, m % 64 AS e, m // 64 AS d FROM (
    SELECT k, p, min(d * 64 + e) AS m FROM (
      SELECT v.k, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM comps v JOIN books1 b ON v.p = b.p AND v.c = b.c GROUP BY ALL) GROUP BY ALL)),
books2 AS (
  SELECT b.p, b.e, b.c, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, b.x)::BIGINT AS x
  FROM books1 b LEFT JOIN (
    SELECT v.p, n.e, v.c, sum(v.x)::BIGINT AS total, count(*) AS n FROM comps v JOIN near1 n ON v.k = n.k AND v.p = n.p GROUP BY ALL) m
  ON b.p = m.p AND b.e = m.e AND b.c = m.c),
near2 AS (
  SELECT k, p, m % 64 AS e, m // 64 AS d FROM (
    SELECT k, p, min(d * 64 + e) AS m FROM (
      SELECT v.k, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM comps v JOIN books2 b ON v.p = b.p AND v.c = b.c GROUP BY ALL) GROUP BY ALL)),
coded AS (
  SELECT q.vec_id, q.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error
  FROM kept q JOIN near2 n ON q.k = n.k GROUP BY q.k, q.vec_id, q.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, c)) FROM books2) AS codebooks_sha256
FROM coded""",
    "op13_turn_repair": r"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS earlier FROM placed),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM faulty),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'duplicate')::BIGINT AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (WHERE k > 1 AND earlier || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
         list({'i': i, 'role': role, 'text': text, 'fault': fault} ORDER BY k DESC) AS rows_
  FROM marked GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce(rows_,
    lambda node, x: list_transform([[
        list_sort(list_filter([{'c': node[1].c + 3, 'a': 'D' || node[1].a, 't': node[1].t},
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') THEN {'c': node[3].c + 2 + (x.fault = 'truncated')::INT, 'a': 'R' || node[3].a, 't': list_prepend('user:' || x.text, node[3].t)} END,
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') AND x.i = 'u' THEN {'c': node[3].c + (x.fault = 'truncated')::INT, 'a': 'K' || node[3].a, 't': list_prepend(x.role || ':' || x.text, node[3].t)} END,
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') AND x.i = 's' THEN {'c': node[2].c + (x.fault = 'truncated')::INT, 'a': 'K' || node[2].a, 't': list_prepend(x.role || ':' || x.text, node[2].t)} END], lambda w: w IS NOT NULL))[1],
        list_sort(list_filter([{'c': node[2].c + 3, 'a': 'D' || node[2].a, 't': node[2].t},
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') THEN {'c': node[3].c + 2 + (x.fault = 'truncated')::INT, 'a': 'R' || node[3].a, 't': list_prepend('user:' || x.text, node[3].t)} END,
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') AND x.i = 'u' THEN {'c': node[3].c + (x.fault = 'truncated')::INT, 'a': 'K' || node[3].a, 't': list_prepend(x.role || ':' || x.text, node[3].t)} END], lambda w: w IS NOT NULL))[1],
        list_sort(list_filter([{'c': node[3].c + 3, 'a': 'D' || node[3].a, 't': node[3].t},
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') THEN {'c': node[4].c + 2 + (x.fault = 'truncated')::INT, 'a': 'R' || node[4].a, 't': list_prepend('assistant:' || x.text, node[4].t)} END,
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') AND x.i = 'a' THEN {'c': node[4].c + (x.fault = 'truncated')::INT, 'a': 'K' || node[4].a, 't': list_prepend(x.role || ':' || x.text, node[4].t)} END], lambda w: w IS NOT NULL))[1],
        list_sort(list_filter([{'c': node[4].c + 3, 'a': 'D' || node[4].a, 't': node[4].t},
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') THEN {'c': node[3].c + 2 + (x.fault = 'truncated')::INT, 'a': 'R' || node[3].a, 't': list_prepend('user:' || x.text, node[3].t)} END,
          CASE WHEN x.fault NOT IN ('blank', 'duplicate') AND x.i = 'u' THEN {'c': node[3].c + (x.fault = 'truncated')::INT, 'a': 'K' || node[3].a, 't': list_prepend(x.role || ':' || x.text, node[3].t)} END], lambda w: w IS NOT NULL))[1]]],
      lambda e: [
        list_sort([e[1], {'c': e[3].c + 2, 'a': 'I' || e[3].a, 't': list_prepend('user:', e[3].t)}, {'c': e[4].c + 4, 'a': 'II' || e[4].a, 't': list_prepend('user:', list_prepend('assistant:', e[4].t))}])[1],
        list_sort([e[2], {'c': e[3].c + 2, 'a': 'I' || e[3].a, 't': list_prepend('user:', e[3].t)}, {'c': e[4].c + 4, 'a': 'II' || e[4].a, 't': list_prepend('user:', list_prepend('assistant:', e[4].t))}])[1],
        list_sort([e[3], {'c': e[4].c + 2, 'a': 'I' || e[4].a, 't': list_prepend('assistant:', e[4].t)}, {'c': e[3].c + 4, 'a': 'II' || e[3].a, 't': list_prepend('assistant:', list_prepend('user:', e[3].t))}])[1],
        list_sort([e[4], {'c': e[3].c + 2, 'a': 'I' || e[3].a, 't': list_prepend('user:', e[3].t)}, {'c': e[4].c + 4, 'a': 'II' || e[4].a, 't': list_prepend('user:', list_prepend('assistant:', e[4].t))}])[1]])[1],
    [{'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}, {'c': 2, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::VARCHAR[]}])[1] AS best
  FROM facts)
SELECT a.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
       coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(s.best.c, 0)::BIGINT AS cost,
       coalesce(s.best.a, '') AS audit, sha256(coalesce(array_to_string(s.best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN solved s ON a.conv_id IS NOT DISTINCT FROM s.conv_id""",
}
