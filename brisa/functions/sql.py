"""The standardizers as SQL functions.

SQL text can't hold a Column, so all are registered as Arrow UDFs, which also keep results of values
that repeat. DataFrame code should use ``brisa.functions.standardize``, whose short sets stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions import scalars

PREFIX = "padronizar_"


def _udf(group: str, name: str):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        f: Callable[[str], str] = getattr(scalars, group)[name]
        seen: dict[str, str] = {}
        return pd.Series([None if t is None else seen[t] if t in seen else seen.setdefault(t, f(t)) for t in texts], dtype=object)

    return run


def _typed(name: str):
    f, kind = scalars.TYPED[name]

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        f = scalars.TYPED[name][0]
        out = [None if v is None or v != v else f(int(v) if isinstance(v, (int, float)) or hasattr(v, "item") else v) for v in values]
        return pd.Series(out, dtype=object if kind == "string" else "Int64" if kind == "bigint" else "Int32")

    return run


def register_splitter(spark: SparkSession, model) -> list[str]:
    """``separar_endereco(text)``, a struct, and ``padronizar_endereco_bruto(text)`` with a model."""
    from brisa.operators import split

    @F.pandas_udf(split.SPLIT)
    def separar(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            tokens = [] if t is None else split.pieces(t)
            rows.append(split.assemble(tokens, model.tag(split.features(tokens))))
        return pd.DataFrame(rows, columns=list(split.FIELDS), dtype=object)

    @F.pandas_udf(T.StringType())
    def bruto(texts: pd.Series) -> pd.Series:
        kinds = dict(zip(split.FIELDS, ("logradouro", "numero", "complemento", "bairro")))
        out = []
        for t in texts:
            tokens = [] if t is None else split.pieces(t)
            parts = split.assemble(tokens, model.tag(split.features(tokens)))
            out.append(None if t is None else ", ".join(scalars.SCALARS[kinds[f]](v).strip() for f, v in parts.items() if v is not None))
        return pd.Series(out, dtype=object)

    spark.udf.register("separar_endereco", separar)
    spark.udf.register("padronizar_endereco_bruto", bruto)
    return ["separar_endereco", "padronizar_endereco_bruto"]


def register(spark: SparkSession) -> list[str]:
    """Makes ``padronizar_<kind>(text)`` and a few more known to ``spark.sql``; gives their names."""
    found = {PREFIX + k: _udf("SCALARS", k) for k in scalars.SCALARS} | {k: _udf("OTHERS", k) for k in scalars.OTHERS} | {k: _typed(k) for k in scalars.TYPED}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
