"""Driver queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brisa.llm import decontaminate, fingerprints, langid, licenses, neardup, packing, repair, secrets, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_repeats(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(_table(spark, sf_dir, "documents"))


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_tokens(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_decontamination, op4_licenses, op5_neardup, op6_substrings, op7_fingerprints, op8_repair_tokens, op9_packing, op10_langid)}
#: Fingerprints: the digests that peeling recovers are the differences of the sets of digests.
ORACLE_SQL: dict[str, str] = {
    "op7_fingerprints": """
WITH p AS (
  SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS d
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT DISTINCT doc_id, d[1] AS heading, list_sort(list_distinct(d)) AS digests, CAST(len(d) AS INTEGER) AS n_paragraphs FROM p),
w AS (SELECT *, CASE WHEN heading IS NOT NULL THEN lag(doc_id) OVER o END AS prev_id,
        CASE WHEN heading IS NOT NULL THEN lag(digests) OVER o END AS old
      FROM v WINDOW o AS (PARTITION BY heading ORDER BY doc_id, digests))
SELECT doc_id, prev_id, n_paragraphs,
  list_filter(coalesce(old, CAST([] AS BIGINT[])), lambda x: NOT list_contains(digests, x)) AS removed,
  list_filter(digests, lambda x: NOT list_contains(coalesce(old, CAST([] AS BIGINT[])), x)) AS added
FROM w""",
}
