"""Numbers in Portuguese words, and Roman numerals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ONES = "ZERO UM DOIS TRES QUATRO CINCO SEIS SETE OITO NOVE DEZ ONZE DOZE TREZE QUATORZE QUINZE DEZESSEIS DEZESSETE DEZOITO DEZENOVE".split()
_TENS = "- - VINTE TRINTA QUARENTA CINQUENTA SESSENTA SETENTA OITENTA NOVENTA".split()
_HUNDREDS = "- CENTO DUZENTOS TREZENTOS QUATROCENTOS QUINHENTOS SEISCENTOS SETECENTOS OITOCENTOS NOVECENTOS".split()
#: From thousands up: for one, and for more.
_SCALES = tuple(x.split("/") for x in ("MIL/MIL", "UM MILHAO/MILHOES", "UM BILHAO/BILHOES"))
ROMAN_CANDIDATE = re.compile(r"\b[MDCLXVI]+\b", re.IGNORECASE)
ROMAN = re.compile(r"M*(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})", re.IGNORECASE)
_VALUES = dict(zip("IVXLCDMivxlcdm", 2 * (1, 5, 10, 50, 100, 500, 1000)))
_MOST = 2**31 - 1


def _below_thousand(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f" E {_ONES[n % 10]}" if n % 10 else "")
    if n == 100:
        return "CEM"
    return _HUNDREDS[n // 100] + (f" E {_below_thousand(n % 100)}" if n % 100 else "")


SMALL = tuple(map(_below_thousand, range(1000)))


def words_of(n: int) -> str:
    """A whole number in words. Kept as is: ``-1000`` reads ``MENOS E MIL``."""
    size = abs(n)
    if size < 1000:
        return "MENOS " * (n < 0) + SMALL[size]
    out = "MENOS" if n < 0 else ""
    for k in (2, 1, 0):
        group, rest = size // 1000 ** (k + 1) % 1000, size % 1000 ** (k + 1)
        if group:
            out += (" E " if not rest else " ") if out else ""
            out += _SCALES[k][0] if group == 1 else f"{SMALL[group]} {_SCALES[k][1]}"
    last = size % 1000
    if last:
        out += (" E " if last < 100 or last % 100 == 0 else " ") + SMALL[last]
    return out


def number_to_words(col: Column) -> Column:
    """``words_of`` for 32-bit integers, with built-in functions only."""
    small = F.split(F.lit("|".join(SMALL)), r"\|")  # a constant
    n = col.cast("bigint")
    word = lambda g: F.element_at(small, (g + 1).cast("int"))

    def build(v: Column) -> Column:
        size = F.abs(v)
        parts, any_before = [F.when(v < 0, F.lit("MENOS")).otherwise(F.lit(""))], v < 0
        for k in (2, 1, 0):
            unit = 1000 ** (k + 1)
            group, rest = F.floor(size / unit) % 1000, size % unit
            joint = F.when(~any_before, F.lit("")).when(rest == 0, F.lit(" E ")).otherwise(F.lit(" "))
            text = F.when(group == 1, F.lit(_SCALES[k][0])).otherwise(F.concat(word(group), F.lit(" " + _SCALES[k][1])))
            parts.append(F.when(group > 0, F.concat(joint, text)).otherwise(F.lit("")))
            any_before = any_before | (group > 0)
        last = size % 1000
        parts.append(F.when(last > 0, F.concat(F.when((last < 100) | (last % 100 == 0), F.lit(" E ")).otherwise(F.lit(" ")), word(last))).otherwise(F.lit("")))
        less = F.concat(F.when(v < 0, F.lit("MENOS ")).otherwise(F.lit("")), word(size % 1000))
        return F.when(size < 1000, less).otherwise(F.concat(*parts))

    # Bound once: the number occurs many times in what follows.
    return F.when(n.isNotNull(), F.transform(F.array(n), build)[0])


def digits_in_text(text: str) -> str:
    """Runs of ASCII digits in words; those beyond 32 bits stay."""
    return re.sub(r"[0-9]+", lambda m: words_of(int(m[0])) if len(m[0].lstrip("0")) <= 10 and int(m[0]) <= _MOST else m[0], text)


def roman_value(text: str) -> int:
    """Subtractive sum from the right; other characters count zero, and nothing is validated."""
    total = last = 0
    for c in reversed(text):
        v = _VALUES.get(c, 0)
        total += -v if v < last else v
        last = v
    return total


def roman_in_text(text: str) -> str:
    """Whole words that are Roman numerals, in words, whatever else they may mean."""
    return ROMAN_CANDIDATE.sub(lambda m: words_of(roman_value(m[0])) if ROMAN.fullmatch(m[0]) else m[0], text)


def _mapped(f):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return run


digits_to_words = _mapped(digits_in_text)
roman_to_words = _mapped(roman_in_text)


def roman_to_int(col: Column) -> Column:
    """``roman_value`` with built-in functions only."""
    table = F.create_map(*[F.lit(x) for pair in _VALUES.items() for x in pair])
    letters = F.transform(F.reverse(F.split(col, "")), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda s, v: F.struct(F.when(v < s.last, s.total - v).otherwise(s.total + v).alias("total"), v.alias("last"))
    return F.aggregate(letters, start, step, lambda s: s.total)
