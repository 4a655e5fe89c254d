"""The standardizers for single strings: the command line and SQL registration use them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from brisa.functions.normalize import normalize_text
from brisa.functions.words import digits_in_text, roman_in_text, roman_value, words_of
from brisa.lookup import state_keys
from brisa.rules import builtin

_ALLOWED = re.compile(r"[!-/:-@\[-`{-~0-9\s]*")


def state(text: str, field: int) -> str:
    return state_keys(field).get(builtin("state").apply(text), "")


def phonetic(text: str) -> str:
    out = builtin("phonetic").apply(text.replace("Ç", "S").replace("ç", "s"))
    return re.sub(r"(.)\1+", r"\1", out, flags=re.DOTALL)


def postcode(text: str) -> str:
    """Empty for what isn't a postal code."""
    digits = re.sub("[^0-9]", "", text)
    if not _ALLOWED.fullmatch(text) or not text.strip() or len(digits) > 8:
        return ""
    digits = digits.rjust(8, "0")
    return f"{digits[:5]}-{digits[5:]}"


def postcode_lenient(text: str) -> str:
    digits = re.sub("[^0-9]", "", text)[:8].rjust(8, "0")
    return f"{digits[:5]}-{digits[5:]}" if text else ""


def _rules(name: str) -> Callable[[str], str]:
    return lambda text: builtin(name).apply(text)


SCALARS: dict[str, Callable[[str], str]] = {
    "logradouro": _rules("street"), "logr": _rules("street"), "tipo_logradouro": _rules("street_type"), "tipo_logr": _rules("street_type"),
    "numero": _rules("number"), "num": _rules("number"), "bairro": _rules("neighbourhood"), "complemento": _rules("complement"), "comp": _rules("complement"),
    "estado": partial(state, field=1), "estado_nome": partial(state, field=2), "estado_codigo": partial(state, field=0),
    "municipio": _rules("municipality"), "mun": _rules("municipality"), "cep": postcode, "cep_leniente": postcode_lenient, "metaphone": phonetic,
}


def number_to_int(text: str) -> int | None:
    out = builtin("number").apply(text)
    value = int(out) if re.fullmatch(r"\+?[0-9]+", out) else 0
    return value if 0 < value < 1 << 32 else None


#: Functions of other types, with their SQL result type.
TYPED: dict[str, tuple[Callable, str]] = {
    "numero_int": (number_to_int, "bigint"),
    "numero_por_extenso": (words_of, "string"),
    "romano_para_inteiro": (roman_value, "int"),
}
OTHERS: dict[str, Callable[[str], str]] = {"normalizar": normalize_text, "numeros_por_extenso": digits_in_text, "romano_por_extenso": roman_in_text}
