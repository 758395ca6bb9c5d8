"""Queries of the llm operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import bpe, credentials, leakage, provenance, reading_level, syntax, term_counts
from srcatlas.plans.runtime import read


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_counts({"words": read(spark, sf, "words"), "trigrams": read(spark, sf, "trigrams")}, read(spark, sf, "files"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).where("mark <> ''").select("index_name", "term", "mark")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_handwritten(read(spark, sf, "files"))


def p4_labels(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.file_labels(read(spark, sf, "files")).select("file_id", "label")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credential_lines(read(spark, sf, "read_outputs"))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redacted_reads(read(spark, sf, "read_outputs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.unparsable_files(read(spark, sf, "files"))


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.parse_rates(read(spark, sf, "files"), read(spark, sf, "smart_reports"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(read(spark, sf, "documents"))


def p8_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    sizes = bpe.token_ids(read(spark, sf, "documents"), keep=("source",)).select("source", F.size("ids").cast("bigint").alias("n"))
    return sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(read(spark, sf, "documents"), read(spark, sf, "level_labels")).select("doc_id", "band").distinct()


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.level_profile(read(spark, sf, "documents"), read(spark, sf, "level_labels"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p4_found, p4_labels, p5_found, p5_redacted, p7_found, p7_rates, p8_ids, p8_tokens_by_source, p9_found, p9_items, p10_found, p10_profile)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P3 = f"""
WITH f AS (SELECT DISTINCT file_id FROM files), postings AS (
  SELECT 'words' AS index_name, trim({_LOWER.format("term")}, ' ') AS term, file_id, n_hits FROM words
  UNION ALL SELECT 'trigrams', {_LOWER.format("term")}, file_id, n_hits FROM trigrams
), valid AS (
  SELECT index_name, term, file_id, max(coalesce(n_hits, 0)) AS n FROM postings SEMI JOIN f USING (file_id) WHERE term IS NOT NULL GROUP BY ALL
), sizes AS (SELECT index_name, count(DISTINCT file_id) AS n_all FROM valid GROUP BY ALL
), counts AS (SELECT index_name, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS n_files FROM valid GROUP BY ALL)
SELECT index_name, term, occurrences, n_files, CASE WHEN n_files < 3 THEN 'rare' WHEN n_files > 0.2 * n_all THEN 'common' ELSE '' END AS mark
FROM counts JOIN sizes USING (index_name)
"""

SQL = {"p3_counts": _P3, "p3_found": f"SELECT index_name, term, mark FROM ({_P3}) WHERE mark <> ''"}
