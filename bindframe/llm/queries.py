"""One query for each text operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.llm import attention_lm, bpe_transducer, conversations, decontaminate, mixing, near_dedup, quality_cnn, quality_rules, sharding, spelling, substring_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: Where the vocabulary lies on the driver; executors get what they need of it from Spark.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.encode(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.measure(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return conversations.summaries(conversations.repair(conversations.damage(original)), original)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_edit_aware_counts": op1_edit_aware_counts,
    "op2_extendible_sharding": op2_extendible_sharding,
    "op3_qgram_decontamination": op3_qgram_decontamination,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_network": op6_byte_network,
    "op7_near_dedup": op7_near_dedup,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_attention_lm": op9_attention_lm,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_mixing": op11_source_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_extendible_sharding": f"""
WITH RECURSIVE k AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT AS h
  FROM documents
), d AS (
  SELECT 0 AS bits, doc_id, bytes, h, sum(bytes) OVER () AS total, count(*) OVER () AS n FROM k
  UNION ALL
  SELECT bits + 1, doc_id, bytes, h,
         sum(bytes) OVER (PARTITION BY h >> (60 - bits - 1)),
         count(*) OVER (PARTITION BY h >> (60 - bits - 1))
  FROM d WHERE total > {SHARD_BYTES} AND bits < 60
)
SELECT doc_id, bytes, CASE WHEN bits = 0 THEN '' ELSE right(lpad(bin(h >> (60 - bits)), 64, '0'), bits::INT) END AS shard,
       bits AS depth, total::BIGINT AS shard_bytes, n AS shard_rows, total > {SHARD_BYTES} AS oversize
FROM d WHERE total <= {SHARD_BYTES} OR bits = 60
""",
    "op10_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
l AS (SELECT r, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
m AS (
  SELECT t.doc_id, t.source, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r)
),
f AS (SELECT *, n_words < 50 AS s, 100 * n_repeat_words > 50 * n_words AS q, 10 * n_symbols > n_words AS y, 20 * n_dup_lines > n_words AS d FROM m),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k
      FROM (SELECT source, 's' AS rule, s::INT AS bad FROM f UNION ALL SELECT source, 'q', q::INT FROM f
            UNION ALL SELECT source, 'y', y::INT FROM f UNION ALL SELECT source, 'd', d::INT FROM f)
      WHERE source IS NOT NULL GROUP BY 1, 2),
a AS (SELECT rule, sum(n) AS nn, count(*) AS hosts, sum(n * n) AS sq, sum(k) AS kk, sum(k * k / n) AS kq FROM h GROUP BY 1),
b AS (SELECT rule, kk / nn AS mean, kk / nn * (1 - kk / nn) AS spread, nn - sq / nn AS room, kq - kk * kk / nn AS raw, hosts FROM a),
e AS (SELECT rule, mean, spread, room, CASE WHEN room > 0 THEN (raw - (hosts - 1) * spread) / room ELSE 0 END AS tau FROM b),
z AS (SELECT rule, mean, CASE WHEN spread <= 0 OR room <= 0 THEN 1.0 WHEN tau > 0 THEN least(1e6, greatest(spread / tau - 1, 1.0)) ELSE 1e6 END AS st FROM e),
x AS (SELECT DISTINCT source FROM h JOIN z USING (rule) WHERE (k + mean * st) / (n + st) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (s OR q) AS base_failed,
       NOT (s OR q) AND f.source IS DISTINCT FROM x.source AS kept
FROM f LEFT JOIN x ON f.source = x.source
""",
    "op11_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\N')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source
), f AS (
  SELECT *, 2 * ss AS cap, coalesce(sum(2 * ss) OVER (ORDER BY ss * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bc,
         coalesce(sum(w) OVER (ORDER BY ss * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bw,
         sum(w) OVER () AS aw, sum(ss) OVER () AS n
  FROM s
), g AS (SELECT *, cap * 2 * (aw - bw) <= w * (3 * n - 2 * bc) AS whole FROM f),
t AS (SELECT coalesce(sum(cap) FILTER (whole), 0) AS c, coalesce(sum(w) FILTER (NOT whole), 0) AS lw FROM g),
p AS (
  SELECT source, ss, CASE WHEN whole THEN cap::DOUBLE ELSE (w * (3 * n - 2 * c))::DOUBLE / (2 * lw)::DOUBLE END AS target,
         CASE WHEN whole THEN cap ELSE (w * (3 * n - 2 * c)) // (2 * lw) END::BIGINT AS budget
  FROM g, t
), r AS (
  SELECT doc_id, size, ss, target, budget, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS e,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, ss AS source_size, target, (e * size + greatest(0, least(size, budget - e * ss - before)))::BIGINT AS taken FROM r
""",
}
