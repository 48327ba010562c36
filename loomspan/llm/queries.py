"""Queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, fingerprints, language_id, line_dedup, mixing, ngram_join, quality, token_files, url_filter, vector_dedup

#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.fair_mix(_table(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0], share=1.5, max_repeats=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_neighbours(_table(spark, sf_dir, "documents"), radius=3)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(_table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked_components(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_wide_lines(_table(spark, sf_dir, "documents"), min_sites=8)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_source_mix": op2_source_mix,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
}

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2.0 * sum(size))::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, cap / weight AS full_at,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS remaining
  FROM weighed WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(CASE WHEN full_at * remaining > rest THEN rest / remaining END) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM levels, level),
placed AS (
  SELECT doc_id, s.source, size, h, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
sends AS (
  SELECT *, (turn * source_size + sent) / target AS finish FROM placed, (SELECT unnest([0, 1]) AS turn) WHERE size > 0 AND target > 0),
taken AS (
  SELECT doc_id, source, sent, size, sum(size) OVER (ORDER BY finish, h, source, turn, doc_id ROWS UNBOUNDED PRECEDING) AS r FROM sends),
kept AS (
  SELECT doc_id, source, sent, sum(size) AS taken FROM taken WHERE r <= (SELECT least(sum(target), 1.5::DOUBLE * sum(source_size)) FROM targets) GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN kept k ON p.doc_id IS NOT DISTINCT FROM k.doc_id AND p.source IS NOT DISTINCT FROM k.source AND p.sent = k.sent AND p.size > 0
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 90 * (x.n + y.n - same)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(coalesce(c.low, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_LINES = r"""
WITH parts AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS p FROM documents),
bare AS (SELECT doc_id, source, text, p, list_transform(p, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS b FROM parts),
wide AS (
  SELECT line FROM (SELECT source, unnest(b) AS line FROM bare) WHERE line <> '' AND source IS NOT NULL
  GROUP BY line HAVING count(DISTINCT source) >= 8),
known AS (SELECT coalesce(list(line), []) AS w FROM wide),
kept AS (
  SELECT doc_id, text, p, list_filter(p, lambda x, i: NOT list_contains(w, b[i])) AS k, len(list_filter(b, lambda x: x <> '')) AS f FROM bare, known)
SELECT doc_id, coalesce(len(p), 0)::BIGINT AS n_lines,
       (CASE WHEN len(p) - len(k) < f THEN len(p) - len(k) ELSE 0 END)::BIGINT AS n_removed,
       CASE WHEN len(p) - len(k) < f AND len(p) > len(k) THEN array_to_string(k, chr(10)) ELSE text END AS text
FROM kept
"""

ORACLES: dict[str, str] = {"op2_source_mix": _MIX, "op3_jaccard_join": _JACCARD, "op8_line_dedup": _LINES}
