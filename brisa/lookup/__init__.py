"""Reference tables: the 27 states (fixed) and municipalities (a CSV file that the user supplies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.functions.normalize import normalize, normalize_text

_STATES = """11 RO Rondônia;12 AC Acre;13 AM Amazonas;14 RR Roraima;15 PA Pará;16 AP Amapá;17 TO Tocantins;21 MA Maranhão;22 PI Piauí
23 CE Ceará;24 RN Rio Grande do Norte;25 PB Paraíba;26 PE Pernambuco;27 AL Alagoas;28 SE Sergipe;29 BA Bahia;31 MG Minas Gerais
32 ES Espírito Santo;33 RJ Rio de Janeiro;35 SP São Paulo;41 PR Paraná;42 SC Santa Catarina;43 RS Rio Grande do Sul
50 MS Mato Grosso do Sul;51 MT Mato Grosso;52 GO Goiás;53 DF Distrito Federal"""
#: (code, abbreviation, name without accents)
STATES: tuple[tuple[str, str, str], ...] = tuple((c, a, normalize_text(n)) for c, a, n in (x.split(" ", 2) for x in _STATES.replace("\n", ";").split(";")))


def state_keys(field: int) -> dict[str, str]:
    """Abbreviations, codes and names, each to one field of their state."""
    return {key: row[field] for row in STATES for key in row}


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """``key, name`` from a header CSV whose first columns are the 7-digit code and the name.

    Codes without their last (check) digit are keys, too.
    """
    rows = spark.read.csv(path, header=True)
    code, name = (F.col(f"`{c}`") for c in rows.columns[:2])
    full = rows.select(code.cast("string").alias("key"), normalize(name).alias("name"))
    return full.unionByName(full.select(F.expr("substring(key, 1, length(key) - 1)").alias("key"), "name")).where("key IS NOT NULL").dropDuplicates(["key"])
