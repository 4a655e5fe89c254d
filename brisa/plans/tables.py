"""Batch jobs over whole tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.standardize import BATCH_KINDS, FIELDS, by_kind, with_municipality
from brisa.operators.split import split_standardized
from brisa.sources.files import read_lines, write_parquet


def parse_spec(spec: str) -> tuple[str, str, str]:
    """``kind:source:target``; anything else, and an unknown kind, is an error."""
    parts = spec.split(":")
    if len(parts) != 3:
        raise ValueError("a specification is kind:source:target")
    kind = parts[0].lower()
    if kind not in BATCH_KINDS:
        raise ValueError(f"unknown kind of field: {parts[0]}")
    return kind, parts[1], parts[2]


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text; floats lose their fraction first."""
    col = F.col(f"`{name}`")
    return (col.cast("int") if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col).cast("string")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores. For work that costs more a row than a shuffle does, on tables that may lie in
    one file with one row group, which is one task however many cores there are. Rows stream through such tasks, so
    two a core will do: hundreds would each compile the rules anew."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def standardize_table(df: DataFrame, specs: Iterable[str], keep: Iterable[str] = (), keep_all: bool = False, limit: int | None = None, municipalities: DataFrame | None = None, distinct_first: bool = False) -> DataFrame:
    """Standardized columns first, then those kept.

    ``distinct_first`` standardizes each distinct value once and joins the results back: worth its
    shuffle where values repeat a lot.
    """
    wanted = [parse_spec(s) for s in specs]
    if limit is not None:
        df = df.limit(limit)
    kept = list(df.columns) if keep_all else list(keep)
    out, marks = df, []
    for k, (kind, source, target) in enumerate(wanted):
        mark, text = f"__target_{k}", as_text(df, source)
        marks.append(F.col(mark).alias(target))
        if kind in ("municipio", "mun") and municipalities is not None:
            out = with_municipality(out.withColumn("__source", text), "__source", mark, municipalities).drop("__source")
        elif distinct_first:
            one = df.select(text.alias("__value")).distinct().withColumn(mark, BATCH_KINDS[kind](F.col("__value")))
            out = out.withColumn("__source", text).join(one, F.col("__source").eqNullSafe(F.col("__value")), "left").drop("__source", "__value")
        else:
            out = out.withColumn(mark, BATCH_KINDS[kind](text))
    targets = {t for _, _, t in wanted}
    return out.select(*marks, *[F.col(f"`{c}`") for c in kept if c not in targets])


def split_address_table(df: DataFrame, model, source: str = "DscEndereco", keep: bool = True) -> DataFrame:
    """Free-form addresses into their four fields, standardized."""
    # In steps, so that the Python function is planned once and not for every field.
    out = df.select(F.col(f"`{source}`"), split_standardized(F.col(f"`{source}`").cast("string"), model).alias("__parts"))
    return out.select(*([F.col(f"`{source}`")] if keep else []), *[F.col(f"__parts.{f}").alias(f) for f in FIELDS])


def diff_table(df: DataFrame, kind: str, raw: str = "logradouro", expected: str = "logradouro_padr") -> DataFrame:
    """Distinct rows in which the standardized column isn't the expected one; nulls drop out."""
    rows = df.select(F.col(f"`{raw}`").alias("raw"), F.col(f"`{expected}`").alias("expected")).withColumn("actual", by_kind(kind)(F.col("raw").cast("string")))
    return rows.where(~(F.col("actual") == F.col("expected"))).distinct()


def snapshot(values: DataFrame, kind: str) -> DataFrame:
    """``raw, value``: the golden file's rows, one for each distinct value."""
    raw = values.select(F.col(f"`{values.columns[0]}`").cast("string").alias("raw")).distinct()
    return raw.withColumn("value", BATCH_KINDS[kind](F.col("raw")))


def snapshot_compare(values: DataFrame, golden: DataFrame, kind: str) -> DataFrame:
    """``raw, expected, actual`` where they differ, or where the golden table lacks a value.

    Values are matched by key, not by line, so no table has to be read in order.
    """
    now = snapshot(values, kind).withColumnRenamed("value", "actual")
    return now.join(golden.select("raw", F.col("value").alias("expected")), "raw", "full").where(~F.col("actual").eqNullSafe(F.col("expected"))).select("raw", "expected", "actual")


def line_compare(raw: DataFrame, golden: DataFrame, kind: str) -> DataFrame:
    """The same for two line-aligned tables with a ``line`` column each; unequal lengths are an error."""
    n, m = raw.count(), golden.count()
    if n != m:
        raise ValueError(f"{n} lines against {m}")
    both = raw.select("line", F.col("value").alias("raw")).join(golden.select("line", F.col("value").alias("expected")), "line")
    return both.withColumn("actual", BATCH_KINDS[kind](F.col("raw"))).where(F.col("actual") != F.col("expected"))


def save_snapshot(spark: SparkSession, source: str, target: str, kind: str) -> None:
    """Standardizes a file of lines into a golden table."""
    write_parquet(snapshot(read_lines(spark, source), kind), target)


def check_snapshot(spark: SparkSession, source: str, golden: str, kind: str) -> DataFrame:
    """What differs now from a saved golden table."""
    return snapshot_compare(read_lines(spark, source), spark.read.parquet(golden), kind)
