"""Standardizers: Column functions, one for each kind of address field. Null gives null.

Short rule sets run as nested built-in functions; the four long ones as Arrow UDFs, as code generation
gives up on hundreds of nested calls and costs more than it saves (see README).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.functions.normalize import literal_map
from brisa.lookup import state_keys
from brisa.rules import builtin

_PUNCTUATION = r"!-/:-@\[-`{-~"


@cache
def _long(name: str):
    return builtin(name).as_arrow_udf(name)


def street(col: Column) -> Column:
    """Street names: types, titles, saints, highways and dates spelled out."""
    return _long("street")(col)


def street_type(col: Column) -> Column:
    """Types of streets, without ordinals and plain numbers."""
    return _long("street_type")(col)


def neighbourhood(col: Column) -> Column:
    return _long("neighbourhood")(col)


def complement(col: Column) -> Column:
    """Blocks, lots, flats and the like; glued forms come apart."""
    return _long("complement")(col)


def number(col: Column) -> Column:
    """House numbers; ``S/N`` where there is none."""
    return builtin("number").as_column(col)


def number_to_int(col: Column) -> Column:
    """House numbers as integers: null for none, for zero and beyond 32 unsigned bits."""
    text = number(col)
    value = F.when(text.rlike(r"^\+?[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return F.when(value.between(1, 4294967295), value.cast("bigint"))


def number_to_string(col: Column) -> Column:
    """Numbers as house numbers: truncated, ``S/N`` for zero and less, never in exponent form."""
    v = col.cast("double")
    whole = F.when(v < 1e37, v.cast("decimal(38,0)").cast("string"))
    whole = F.when(v < 1, F.lit("0")).when(v < 9e18, F.floor(v).cast("bigint").cast("string")).otherwise(F.coalesce(whole, F.format_string("%.0f", v)))
    return F.when(v.isNull(), None).when(F.isnan(v), F.lit("NaN")).when(v <= 0, F.lit("S/N")).when(v == float("inf"), F.lit("inf")).otherwise(whole)


def _dashed(digits: Column) -> Column:
    return F.concat(F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 3))


def _result(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"))


def postcode_numeric(col: Column) -> Column:
    """``struct<value, error>`` of an integer postal code; 99999999 and more are errors, and so is what is
    below 32 bits."""
    n = col.cast("bigint")
    ok = n.between(-(1 << 31), 99999998)
    return F.when(n.isNotNull(), _result(F.when(ok, _dashed(F.format_string("%08d", n))), F.when(~ok, F.lit("postal code out of range"))))


def postcode_strict(col: Column) -> Column:
    """``struct<value, error>``. Blank gives an empty value. Digits that aren't ASCII are invalid here."""
    digits = F.regexp_replace(col, "[^0-9]", "")
    bad, blank = col.rlike(rf"(?U)[^{_PUNCTUATION}0-9\s]"), col.rlike(r"(?U)^\s*\z")
    many = F.length(digits) > 8
    value = F.when(bad, None).when(blank, F.lit("")).when(~many, _dashed(F.lpad(digits, 8, "0")))
    error = F.when(bad, F.lit("invalid characters in postal code")).when(~blank & many, F.lit("too many digits in postal code"))
    return F.when(col.isNotNull(), _result(value, error))


def postcode(col: Column) -> Column:
    """The strict value, empty where it is an error."""
    return F.when(col.isNotNull(), F.coalesce(postcode_strict(col)["value"], F.lit("")))


def postcode_lenient(col: Column) -> Column:
    """The first eight digits, whatever else is there; empty stays empty."""
    return F.when(col == "", col).otherwise(_dashed(F.lpad(F.substring(F.regexp_replace(col, "[^0-9]", ""), 1, 8), 8, "0")))


def _state(col: Column, field: int) -> Column:
    key = builtin("state").as_column(col)
    table = literal_map(state_keys(field))
    return F.when(col.isNotNull(), F.coalesce(F.try_element_at(table, key), F.lit("")))


def state_code(col: Column) -> Column:
    return _state(col, 0)


def state_abbreviation(col: Column) -> Column:
    return _state(col, 1)


def state_name(col: Column) -> Column:
    return _state(col, 2)


def municipality_text(col: Column) -> Column:
    """Municipality names with renamings; codes stay (see ``with_municipality``)."""
    return builtin("municipality").as_column(col)


def with_municipality(df: DataFrame, source: str, target: str, table: DataFrame) -> DataFrame:
    """Adds ``target``: the name for a code of ``table`` (key, name), else the standardized text.

    The table has two rows for each municipality, about 11,000, so Spark's own size limit decides on
    broadcasting it.
    """
    key, name, text = "__municipality_key", "__municipality_name", "__municipality_text"
    small = table.select(F.col("key").alias(key), F.col("name").alias(name))
    joined = df.withColumn(text, municipality_text(F.col(source).cast("string"))).join(small, F.col(text) == F.col(key), "left")
    return joined.withColumn(target, F.coalesce(name, text)).drop(key, name, text)


def phonetic(col: Column) -> Column:
    """A phonetic key for Brazilian Portuguese: metaphone rules, then runs of a letter become one."""
    soft = F.translate(col, "Çç", "Ss")
    return F.regexp_replace(builtin("phonetic").as_column(soft), r"(?s)(.)\1+", "$1")


#: Names by which the command line, SQL and table specifications call a standardizer.
KINDS: dict[str, Callable[[Column], Column]] = {
    "logradouro": street, "logr": street, "tipo_logradouro": street_type, "tipo_logr": street_type, "numero": number, "num": number,
    "bairro": neighbourhood, "complemento": complement, "comp": complement, "estado": state_abbreviation, "estado_nome": state_name,
    "estado_codigo": state_code, "municipio": municipality_text, "mun": municipality_text, "cep": postcode, "cep_leniente": postcode_lenient, "metaphone": phonetic,
}
#: The same for tables, where two names mean something else.
BATCH_KINDS = {k: v for k, v in KINDS.items() if k not in ("estado_nome", "estado_codigo", "cep_leniente", "metaphone")} | {"estado": state_name, "uf": state_name, "cep": postcode_lenient, "localidade": neighbourhood, "loc": neighbourhood}
def by_kind(name: str) -> Callable[[Column], Column]:
    """The standardizer of that name; an unknown one is an error."""
    if name not in KINDS:
        raise ValueError(f"unknown kind of field: {name}")
    return KINDS[name]


FIELDS = {"logradouro": street, "numero": number, "complemento": complement, "localidade": neighbourhood}


def address(**columns: Column) -> Column:
    """An address struct: of the four fields, those given; the others are null."""
    return F.struct(*[columns.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def standardize_address(col: Column) -> Column:
    """Each field of an address struct by its own standardizer."""
    return F.struct(*[f(col[name]).alias(name) for name, f in FIELDS.items()])


def format_address(col: Column) -> Column:
    """Trimmed fields joined by commas. Nulls are left out, empty ones are not."""
    return F.concat_ws(", ", *[F.regexp_replace(col[name], r"(?U)^\s+|\s+\z", "") for name in FIELDS])
