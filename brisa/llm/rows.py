"""Keeping and dropping rows of a documents table by id, whatever else its columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.session import Scratch

ID = "__brisa_id"


ROW = "__brisa_row"


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a number of their own in ``ROW``, written, so that it stays the same."""
    return scratch.put(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def by_row(rows: DataFrame) -> DataFrame:
    """Numbered documents with their number for ``doc_id``."""
    return rows.withColumn("doc_id", F.col(ROW))


def without_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbered documents whose number isn't among the ids (one column), without the number."""
    named = ids.toDF(ID)
    return rows.join(named, rows[ROW] == named[ID], "left_anti").drop(ROW)


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    named = ids.toDF(ID)
    return docs.join(named, docs["doc_id"] == named[ID], how)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` isn't among the ids (one column); a null ``doc_id`` stays."""
    return _joined(docs, ids, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` is among the ids."""
    return _joined(docs, ids, "left_semi")
