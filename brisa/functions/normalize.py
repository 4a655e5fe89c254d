"""Normalization: trim Unicode white space, decompose (NFKD), keep ASCII, upper case."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed: the Unicode property, not Python's wider notion.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def fold_ascii(text: str) -> str:
    """Decomposed, without what isn't ASCII, in ASCII capitals; not trimmed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return text.translate(_UPPER)


def normalize_text(text: str) -> str:
    """The same function for one string. It trims first, so a dropped character may leave a blank."""
    return fold_ascii(text.strip(SPACES))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, those, and those that give several.

    Latin letters and punctuation that give none come last in the first string, without a partner:
    ``translate`` drops them. The rest of Unicode is left to a slower step that few texts need.
    """
    one, to, none, many = [], [], [], {}
    for k in range(128, sys.maxunicode + 1):
        latin = k < 0x370 or 0x2000 <= k < 0x2070
        if not latin and not unicodedata.decomposition(chr(k)):
            continue
        text = unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode("ascii")
        if len(text) == 1:
            one.append(chr(k)), to.append(text)
        elif text:
            many[chr(k)] = text
        elif latin:
            none.append(chr(k))
    return "".join(one + none), "".join(to), many


def literal_map(table: dict[str, str]) -> Column:
    """A constant map from one literal: a call for each entry would take longer than many a query."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _bound(col: Column, f) -> Column:
    """``f(col)``, with ``col`` computed once however often ``f`` uses it."""
    return F.transform(F.array(col), f)[0]


def normalize(col: Column, trim: bool = True) -> Column:
    """``normalize_text`` with built-in functions only. Null gives null.

    ASCII text takes the short way. Characters that decompose to one letter are translated; the few
    that give several are looked up one by one, in texts that still aren't ASCII then.
    """
    one, to, many = _tables()
    ascii_only = r"^[\x00-\x7F]*\z"
    table = literal_map(many)

    def rare(v: Column) -> Column:
        letters = F.transform(F.split(v, ""), lambda x: F.when(x.rlike(ascii_only), x).otherwise(F.coalesce(F.try_element_at(table, x), F.lit(""))))
        return F.when(v.rlike(ascii_only), v).otherwise(F.array_join(letters, ""))

    def fold(v: Column) -> Column:
        return F.upper(F.when(v.rlike(ascii_only), v).otherwise(_bound(F.translate(v, one, to), rare)))

    trimmed = F.btrim(col, F.lit(SPACES)) if trim else col
    return F.when(col.isNotNull(), _bound(trimmed, fold))
