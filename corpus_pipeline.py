"""A corpus pipeline: five stages, each one an operator of ``brisa.llm``.

Every stage is written as Parquet and read again as the next one's documents. All but the last keep
the columns of ``documents``; the first three drop documents, the fourth masks secrets in texts, the
last cuts the token ids of what is left into windows.

Nulls, repeated rows, empty tables and extra columns: as the operators' docstrings say. Toxic and
leaking rows go by themselves, whatever their ``doc_id``; of near-duplicates, a row with a null
``doc_id`` stays. A null text stays until packing, which has nothing to pack of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brisa.llm import decontaminate, neardup, packing, secrets, toxicity
from brisa.session import Scratch, collecting


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't find toxic."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids with boundary records."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; tests hold each operator against brute force, and
#: what ``run`` returns against the rows that a small corpus is built to keep.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with collecting():  # a stage's own tables go once its result is written
            docs = scratch.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
