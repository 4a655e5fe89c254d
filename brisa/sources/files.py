"""Readers and writers for the forms in which address tables come and go."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files, folders or globs; columns and row groups are pruned by the scan."""
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, row_group_bytes: int = 32 << 20) -> None:
    """zstd, with statistics; row groups are limited by bytes, pages to 1 MiB."""
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(1 << 20)).parquet(path)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """CSV with a header, all columns as strings."""
    return spark.read.csv(path, header=True, encoding=encoding, sep=sep)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, without quoting."""
    return spark.read.text(path).select("value")


def write_lines(df: DataFrame, path: str) -> None:
    """The first column, a value a line, without quoting."""
    df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "utf-8", sep: str = ",", member: str = ".csv") -> DataFrame:
    """CSV files inside zip archives, one archive a task, as strings; archives can't be split."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        if not name.lower().endswith(member):
                            continue
                        with archive.open(name) as f:
                            options = pacsv.ConvertOptions(include_columns=columns, include_missing_columns=True, column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=True)
                            for part in pacsv.open_csv(f, read_options=pacsv.ReadOptions(encoding=encoding), parse_options=pacsv.ParseOptions(delimiter=sep), convert_options=options):
                                yield part.select(columns)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
