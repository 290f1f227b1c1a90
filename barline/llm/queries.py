"""The registered queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, embedding_dup, language, lines, lm_score, mixing, near_dup, pieces, quality, runs, secret_scan, toxicity
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: DuckDB texts; operators that SQL can't express are tested against brute force in tests/llm.
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(spark, table(spark, folder, "documents"), near_dup.Near(words=2, percent=80))


@query
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dup.near_vectors(spark, table(spark, folder, "embeddings"))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(spark, table(spark, folder, "documents"))


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"), decontamination.TOLERANT).drop("key")


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


@query
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.lm_scores(spark, table(spark, folder, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_planted_period(table(spark, folder, "documents"))))


@query
def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, sources = mixing.mixed_documents(spark, table(spark, folder, "documents"), F.array("source"))
    sources = sources.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
    named = docs.withColumn("source", F.element_at("sources", 1))
    return named.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(spark, table(spark, folder, "documents"))


SQL["op13_source_divergence"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT row_no, lang, source, unnest(terms) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
priced AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.n AS in_lang,
    1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
listed AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
