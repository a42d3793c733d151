"""The queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, license_scan, line_dedup, mixing, quality, simhash, substring, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), exact_chars=line_dedup.EXACT_CHARS)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The raking rounds that the query stops after, or before, once its margins hold to 1e-10.
OP3_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
              WHEN length(coalesce(text, '')) < 1000 THEN 'short' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0),
s AS (SELECT source, sum(tokens) ** 0.5 AS x FROM cells GROUP BY 1), l AS (SELECT lang, sum(tokens) ** 0.7 AS x FROM cells GROUP BY 1),
t AS (SELECT topic, sum(tokens) ** 0.8 AS x FROM cells GROUP BY 1),
goal AS (
  SELECT c.*, s.x / (SELECT sum(x) FROM s) AS gs, l.x / (SELECT sum(x) FROM l) AS gl, t.x / (SELECT sum(x) FROM t) AS gt
  FROM cells c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
it AS (
  SELECT 0 AS k, source, lang, topic, tokens, gs, gl, gt, tokens AS w FROM goal
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, gs, gl, gt, w * gt / sum(w) OVER (PARTITION BY topic) AS w FROM (
    SELECT * EXCLUDE (w), w * gl / sum(w) OVER (PARTITION BY lang) AS w FROM (
      SELECT * EXCLUDE (w), w * gs / sum(w) OVER (PARTITION BY source) AS w FROM it WHERE k < 40))),
chance AS (SELECT source, lang, topic, round(w / tokens / (SELECT max(w / tokens) FROM it WHERE k = 40), 9) AS p FROM it WHERE k = 40)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 0), 6) AS probability,
       CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 < coalesce(p, 0) AS sampled
FROM rows_ LEFT JOIN chance USING (source, lang, topic)
"""

OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(r_host, r_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, max_by(r_host || r_path, length(r_host) + length(r_path)) AS rule, max_by(action, length(r_host) + length(r_path)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules ON ('.' || host) LIKE ('%.' || r_host) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring": op2_substring,
        "op3_mixing": op3_mixing,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_url_filter": op5_url_filter,
        "op6_license_scan": op6_license_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_nearest": op9_nearest,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_exact_dedup": OP7_SQL}
