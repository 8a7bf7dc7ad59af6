"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, license_scan, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir)).drop("n_links")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(documents(spark, sf_dir))
    dealt = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"])), ",")
    return planned.select("doc_id", "size", "source_size", "target", "taken", dealt.alias("epoch_shards"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("clean_text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_mix_sources, op3_token_counts, op4_line_dedup, op5_license_scan,
        op6_quality_rules, op7_exact_dedup, op8_secret_scan, op9_pack, op10_quality_classifier,
    )
}

_W = r"[\x20\x09-\x0D]+"

#: op7: of equal texts the largest doc_id; of rows with the same text and doc_id, one.
_OP7 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

#: op1: all pairs of sets that share a shingle, then reachability.
_OP1 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM t),
h AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, c.y FROM r JOIN c ON r.y = c.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(k.n, 0) AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
FROM t JOIN m ON t.doc_id = m.x LEFT JOIN k ON t.doc_id = k.doc_id
"""

_MARK = "length(regexp_replace(m, '{}', '', 'g'))"
_OP6 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT *, list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '') AS w FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM u),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
v AS (SELECT doc_id, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS solid, regexp_replace(line, '[^\p{{Lu}}#*$%&|<>»·•{quality_rules.PUNCTUATION}]+', '', 'g') AS m,
  regexp_matches(line, '[{quality_rules.SENTENCE_ENDS}](?:[{quality_rules.CLOSERS}]|\z)') AS sentence FROM l),
f AS (SELECT doc_id, line, solid, (length(m) > 0 AND ({_MARK.format('[^#*$%&|<>]+')} > {quality_rules.SYMBOL_SHARE} * length(line)
    OR ({_MARK.format('[^|>»·•]+')} >= {quality_rules.NAV_MARKS} AND length(line) <= {quality_rules.NAV_CHARS} * {_MARK.format('[^|>»·•]+')})
    OR ({_MARK.format(r'[^\p{Lu}]+')} >= {quality_rules.SHOUT_CAPITALS} AND {_MARK.format(r'[^\p{Lu}]+')} >= {quality_rules.SHOUT_SHARE} * length(line))
    OR ({_MARK.format(f'[^{quality_rules.PUNCTUATION}]+')} >= {quality_rules.PUNCTUATION_MARKS} AND {_MARK.format(f'[^{quality_rules.PUNCTUATION}]+')} >= {quality_rules.PUNCTUATION_SHARE} * length(line))))
  OR (length(line) <= {quality_rules.FRAGMENT_CHARS} AND solid AND NOT sentence)
  OR (length(line) <= {quality_rules.BOILERPLATE_CHARS} AND regexp_matches(lower(line), '{"|".join(quality_rules.BOILERPLATE)}')) AS failed FROM v),
d AS (SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(DISTINCT line) FILTER (solid) AS n_distinct, count(*) FILTER (failed) AS n_failed_lines,
  coalesce(sum(length(line)) FILTER (failed), 0)::BIGINT AS lost_chars, sum(length(line)) AS line_chars FROM f GROUP BY doc_id),
b AS (SELECT u.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_W}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  n_lines - n_distinct AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_lines, n_failed_lines, lost_chars, line_chars FROM u JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {quality_rules.LOST_SHARE} * line_chars AS kept,
  n_lines, n_failed_lines, lost_chars FROM e
"""

ORACLES: dict[str, str] = {"op1_near_dedup": _OP1, "op4_line_dedup": line_dedup.ORACLE, "op6_quality_rules": _OP6, "op7_exact_dedup": _OP7}
