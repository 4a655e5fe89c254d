"""Preparation of address corpora: seven sources to one schema, union, samples, splits, profiles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("logradouro", "numero", "complemento", "localidade", "cep", "municipio", "uf")


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _rows(df: DataFrame, *columns: Column | None) -> DataFrame:
    return df.select(*[(F.lit(None).cast("string") if c is None else c).alias(n) for c, n in zip(columns, COLUMNS)])


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(_c(n), F.lit("")) for n in names])


def prepare_cneas(df: DataFrame) -> DataFrame:
    p = "cneas_entidade_endereco_"
    return _rows(df, *[_c(f"{p}{x}_s") for x in ("logradouro", "numero", "complemento", "bairro", "cep")], _c("cneas_entidade_nome_municipio_s"), _c("cneas_entidade_sigla_uf_s"))


def prepare_cno(df: DataFrame) -> DataFrame:
    return _rows(df, _joined("Tipo de logradouro", "Logradouro"), *[_c(x) for x in ("Número do logradouro", "Complemento", "Bairro", "CEP", "Nome do município", "Estado")])


def prepare_cnes(df: DataFrame, towns: DataFrame) -> DataFrame:
    """``towns``: cod_ibge, municipio, uf. Establishments' codes lack the check digit."""
    t = towns.select(F.expr("substring(cast(cod_ibge AS string), 1, 6)").alias("t_code"), F.col("municipio").alias("t_name"), F.col("uf").alias("t_uf"))
    j = df.join(t, _c("co_ibge") == F.col("t_code"), "left")
    return _rows(j, _c("no_logradouro"), _c("nu_endereco"), None, _c("no_bairro"), _c("co_cep"), _c("t_name"), _c("t_uf"))


def prepare_school_census(df: DataFrame) -> DataFrame:
    names = ("ds_endereco", "nu_endereco", "ds_complemento", "no_bairro", "co_cep", "no_municipio", "sg_uf")
    return _rows(df, *[F.coalesce(_c(n), F.lit("")) for n in names])


def prepare_welfare_posts(df: DataFrame) -> DataFrame:
    return _rows(df, *[_c(n) for n in ("endereco", "numero", "complemento", "bairro", "cep", "cidade", "uf")])


def prepare_cnefe(df: DataFrame, towns: DataFrame) -> DataFrame:
    """Addresses of the census: parts of names and of complements are put together; only known towns."""
    t = towns.select(_c("cod_ibge").alias("t_code"), F.col("municipio").alias("t_name"), F.col("uf").alias("t_uf"))
    j = df.join(t, _c("code_muni") == F.col("t_code"), "inner")
    number = _joined("num_adress", "dsc_modificador")
    extra = F.trim(F.regexp_replace(_joined("nom_comp_elem1", "val_comp_elem1", "nom_comp_elem2", "val_comp_elem2", "nom_comp_elem3", "val_comp_elem3", "nom_comp_elem4"), r"\s+", " "))
    return _rows(j, _joined("nom_tipo_seglogr", "nom_titulo_seglogr", "nom_seglogr"), number, extra, _c("desc_localidade"), _c("cep"), _c("t_name"), _c("t_uf"))


def prepare_cnpj(df: DataFrame, towns: DataFrame) -> DataFrame:
    """``towns``: code, name, uf by the tax office's codes."""
    t = towns.select(_c("code").alias("t_code"), F.col("name").alias("t_name"), F.col("uf").alias("t_uf"))
    j = df.join(t, _c("municipio") == F.col("t_code"), "left")
    rest = [F.coalesce(_c(n), F.lit("")) for n in ("numero_estab", "complemento", "bairro", "cep")]
    return _rows(j, F.concat_ws(" ", _c("tipo_logradouro"), _c("logradouro")), *rest, _c("t_name"), _c("t_uf"))


def union_sources(sources: dict[str, DataFrame], distinct: bool = True) -> DataFrame:
    """All sources by position, each with its name in ``origem``; another number of columns is an error."""
    for name, df in sources.items():
        if len(df.columns) != len(COLUMNS):
            raise ValueError(f"{name} has {len(df.columns)} columns instead of {len(COLUMNS)}")
    rows = reduce(DataFrame.union, [df.toDF(*COLUMNS).withColumn("origem", F.lit(k)) for k, df in sources.items()])
    return rows.distinct() if distinct else rows


def draw(keys: list[str], seed: int = 0) -> Column:
    """A number from 0 up to 1 for each row, from an MD5 of its keys, which other engines can compute, too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_c(k), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample_rows(df: DataFrame, n: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """``n`` random rows: each partition offers its own best ``n``, so this is no global sort.

    With ``keys`` (which should tell rows apart) the same rows are drawn whenever it runs.
    """
    order = F.rand(seed) if keys is None else draw(keys, seed)
    return df.withColumn("__r", order).orderBy("__r", *(keys or [])).limit(n).drop("__r")


def random_split(df: DataFrame, keys: list[str], share: float = 0.9, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two complementary parts. A row's side is a hash of ``keys``, so retries can't move it."""
    r = draw(keys, seed)
    return df.where(r < share), df.where(r >= share)


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: smallest, largest, distinct values, share of nulls."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    cols = df.columns
    aggs = [f(F.col(f"`{c}`")).cast("string").alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in (("min", F.min), ("max", F.max), ("distinct", distinct), ("count", F.count))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max"), F.col(f"distinct_{i}").cast("bigint").alias("n_distinct"), (1 - F.col(f"count_{i}").cast("double") / F.col("n")).alias("null_share")) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


@F.pandas_udf(T.LongType())
def _ordered(values: pd.Series) -> pd.Series:
    """The bits of doubles as integers of the same order. Zeros are one value, and so are NaNs, the largest."""
    v = values.to_numpy("float64") + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view("int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def _quantiles(df: DataFrame, numeric: list[str], shares: dict[str, float]) -> DataFrame:
    """``column`` and exact quantiles, interpolated as ``percentile`` does, for columns that have values.

    ``percentile`` sends every distinct value to one task. Here values are counted by the first 16 bits of
    their order, then only those beside a wanted rank by the next 16, four times in all: no task holds more
    than 65,536 counts of a cell, and a column has no more cells than wanted ranks.
    """
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in numeric]))
    rows = df.select(one.alias("r")).select("r.*").where("value IS NOT NULL")
    cells = None
    for shift in (48, 32, 16, 0):
        inside, keys = rows, ["column"]
        if cells is not None:
            inside, keys = rows.join(F.broadcast(cells), "column").where(F.col("value").between(F.col("lo"), F.col("hi"))), ["column", "lo", "before", "wants"]
        counted = inside.groupBy(*keys, F.shiftright(_ordered("value"), shift).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        cell = Window.partitionBy("column", *keys[1:2])
        upto = F.sum("n").over(cell.orderBy("bucket"))
        if cells is None:
            last = F.sum("n").over(cell) - 1
            places = [(k, last * F.lit(q)) for k, q in shares.items()]
            ranks = [F.struct(F.lit(k).alias("share"), p.alias("place"), f(p).cast("bigint").alias("rank")) for k, p in places for f in (F.floor, F.ceil)]
            counted = counted.withColumns({"before": F.lit(0).cast("bigint"), "wants": F.array_distinct(F.array(*ranks))})
        counted = counted.withColumn("upto", F.col("before") + upto).withColumn("want", F.explode("wants"))
        found = counted.where((F.col("want.rank") >= F.col("upto") - F.col("n")) & (F.col("want.rank") < F.col("upto")))
        cells = found.groupBy("column", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("n")).alias("before")).agg(F.sort_array(F.collect_list("want")).alias("wants"))
    each = cells.select("column", F.col("lo").alias("value"), F.inline("wants"))
    ends = each.groupBy("column", "share", "place").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    a, b, place = F.col("a"), F.col("b"), F.col("place")
    between = (F.ceil(place) - place) * a + (place - F.floor(place)) * b
    ends = ends.withColumn("q", F.when(a == b, a).otherwise(between))
    return ends.groupBy("column").agg(*[F.max(F.when(F.col("share") == k, F.col("q"))).alias(k) for k in shares])


def summarize(df: DataFrame) -> DataFrame:
    """``profile`` with exact counts, and mean, standard deviation and quartiles of numeric columns."""
    numeric = [c for c, t in df.dtypes if t.startswith(("int", "bigint", "smallint", "tinyint", "float", "double", "decimal"))]
    stats, shares = {"avg": F.avg, "std": F.stddev_samp}, {f"q{q}": q / 100 for q in (25, 50, 75)}
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}_{i}") for i, c in enumerate(df.columns) if c in numeric for k, f in stats.items()]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[(F.col(f"{k}_{i}") if c in numeric else F.lit(None).cast("double")).alias(k) for k in stats]) for i, c in enumerate(df.columns)])
    more = df.agg(F.count("*").alias("__n"), *aggs).select(F.inline(rows))
    if numeric:
        more = more.join(_quantiles(df, numeric, shares), "column", "left")
    else:
        more = more.select("*", *[F.lit(None).cast("double").alias(k) for k in shares])
    return profile(df, exact=True).join(more, "column")
