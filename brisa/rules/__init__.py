"""Ordered rewrite rules: parsing, and folding over strings or columns.

A rule set is applied once, in order: each rule sees what earlier rules made of the text, replaces all
its matches, and has no second turn. A rule whose guard matches anywhere in the text is skipped.
Texts are normalized first (see ``brisa.functions.normalize``), so rules see upper-case ASCII.

The catalog's notation: ``<a&b>`` is a group of alternatives, ``~`` a word edge, ``#`` a digit, ``!`` a
literal dot; ``@p``, ``@d``, ``@s``, ``@w``, ``@n`` are fragments that recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.normalize import normalize, normalize_text

try:
    from re import _constants as _sre
    from re import _parser
except ImportError:  # another interpreter: no shortcut
    _parser = None

_FRAGMENTS = {"@s": r"\b(-|,|\.) *", "@p": r"\b(\.|,)?", "@d": r"\b\.?", "@w": r"\s{2,}", "@n": "NOSSA SENHORA"}
_SIGNS = str.maketrans({"!": r"\.", "#": r"\d", "~": r"\b", "&": "|", ">": ")", "<": "("})
_CACHE = 200_000


def _expand(text: str) -> str:
    text = text.translate(_SIGNS)
    for short, long in _FRAGMENTS.items():
        text = text.replace(short, long)
    return text


@dataclass(frozen=True)
class Rule:
    """All matches of ``pattern`` become ``replacement`` (``$1`` is a group), unless ``guard`` matches."""

    pattern: str
    replacement: str
    guard: str | None = None


def _python(pattern: str) -> str:
    """``$`` is the end of the text only, as in the catalog's dialect."""
    return re.sub(r"(?<!\\)\$", r"\\Z", pattern)


def _java(pattern: str) -> str:
    return "(?d)" + re.sub(r"(?<!\\)\$", r"\\z", pattern)


def _needs(tree) -> frozenset[str] | None:
    """Strings of which any match must contain one, as long as can be told; none if nothing can."""
    best: frozenset[str] | None = None
    run = ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best)) or min(map(len, found)) == min(map(len, best)) and len(found) < len(best)):
            best = found

    for op, arg in tree:
        if op is _sre.LITERAL:
            run += chr(arg)
            continue
        if op is _sre.AT:
            continue
        offer(frozenset([run]) if run else None)
        run = ""
        if op is _sre.SUBPATTERN:
            offer(_needs(arg[3]))
        elif op is _sre.BRANCH:
            parts = [_needs(p) for p in arg[1]]
            offer(None if None in parts else frozenset().union(*parts))
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and arg[0] > 0:
            offer(_needs(arg[2]))
    offer(frozenset([run]) if run else None)
    return best


class _Compiled:
    def __init__(self, rule: Rule):
        self.sub = re.compile(_python(rule.pattern), re.ASCII).sub
        self.to = re.sub(r"\$\{?(\d+)\}?", r"\\g<\1>", rule.replacement.replace("\\", r"\\"))
        self.guard = re.compile(_python(rule.guard), re.ASCII).search if rule.guard else None
        needed = _needs(_parser.parse(_python(rule.pattern), re.ASCII)) if _parser else None
        self.needed = tuple(needed) if needed and len(needed) <= 12 else None


def _replaced(col: Column, rule: Rule, to: str) -> Column:
    return F.regexp_replace(col, F.lit(_java(rule.pattern)), F.lit(to))


def _guarded(col: Column, rule: Rule, to: str) -> Column:
    """Bound once: written plainly, the input would be computed twice."""
    return F.transform(F.array(col), lambda v: F.when(v.rlike(_java(rule.guard)), v).otherwise(_replaced(v, rule, to)))[0]


@dataclass(frozen=True)
class RuleSet:
    """An immutable, ordered set of rules. Adding gives a new set, ready to use."""

    rules: tuple[Rule, ...] = ()
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return RuleSet, (self.rules,)

    # building
    def add(self, pattern: str, replacement: str, guard: str | None = None) -> "RuleSet":
        """One more rule. The replacement is upper-cased, the patterns are not."""
        return RuleSet((*self.rules, Rule(pattern, replacement.upper(), guard)))

    def add_pairs(self, pairs: Iterable[Sequence[str | None]]) -> "RuleSet":
        """Rows of one (delete), two (replace) or three (guarded) strings; nulls are left out first."""
        out = self
        for row in pairs:
            row = [x for x in row if x is not None]
            if row:
                out = out.add(row[0], row[1] if len(row) > 1 else "", row[2] if len(row) > 2 else None)
        return out

    def add_vectors(self, patterns: Sequence[str], replacements: Sequence[str], guards: Sequence[str | None] | None = None) -> "RuleSet":
        """Rules given by columns of equal length."""
        guards = [None] * len(patterns) if guards is None else guards
        if not len(patterns) == len(replacements) == len(guards):
            raise ValueError("patterns, replacements and guards must be equally long")
        out = self
        for row in zip(patterns, replacements, guards):
            out = out.add(*row)
        return out

    # export
    def pairs(self) -> list[tuple[str, str, str | None]]:
        return [(r.pattern, r.replacement, r.guard) for r in self.rules]

    def vectors(self) -> tuple[list[str], list[str], list[str | None]]:
        return [r.pattern for r in self.rules], [r.replacement for r in self.rules], [r.guard for r in self.rules]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *p) for k, p in enumerate(self.pairs())]
        return spark.createDataFrame(rows, "ord int, pattern string, replacement string, guard string")

    # applying
    def fold(self, text: str) -> str:
        """The rules over a text that is normalized already."""
        if "compiled" not in self._made:
            self._made["compiled"] = [_Compiled(r) for r in self.rules]
        for c in self._made["compiled"]:
            if c.needed is not None:
                for x in c.needed:
                    if x in text:
                        break
                else:
                    continue
            if c.guard is None or not c.guard(text):
                text = c.sub(c.to, text)
        return text

    def apply(self, text: str) -> str:
        """Normalize and fold; results are kept, as addresses repeat."""
        seen = self._made.setdefault("seen", {})
        out = seen.get(text)
        if out is None:
            if len(seen) > _CACHE:
                seen.clear()
            out = seen[text] = self.fold(normalize_text(text))
        return out

    def as_column(self, col: Column, normalized: bool = False) -> Column:
        """The rules as nested built-in functions: no Python, for short sets."""
        out = col if normalized else normalize(col)
        for r in self.rules:
            to = re.sub(r"\$\{(\d+)\}", r"$\1", r.replacement)
            out = _guarded(out, r, to) if r.guard else _replaced(out, r, to)
        return out

    def as_arrow_udf(self, name: str | None = None):
        """The rules as one Arrow UDF, for long sets: patterns compile once a worker, and code generation
        would give up on that many nested calls. ``name`` lets workers find a built-in set themselves."""
        rules = self

        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            apply = (builtin(name) if name else rules).apply
            return pd.Series([None if t is None else apply(t) for t in texts], dtype=object)

        return run


_BUILTIN: dict[str, RuleSet] = {}


def builtin(name: str) -> RuleSet:
    """A rule set of the catalog: street, neighbourhood, complement, street_type, number, state,
    municipality or phonetic. It can be extended; the catalog's stays as it is."""
    if not _BUILTIN:
        found: dict[str, list[Rule]] = {}
        for line in resources.files("brisa.rules").joinpath("catalog.txt").read_text("utf-8").split("\n"):
            if line.startswith("[") and line.endswith("]") and " => " not in line:
                rules = found.setdefault(line[1:-1], [])
            elif " => " in line and not line.startswith("# Rewrite"):
                pattern, _, rest = line.partition(" => ")
                to, _, guard = rest.partition(" != ")
                rules.append(Rule(_expand(pattern), to.replace("@n", _FRAGMENTS["@n"]), _expand(guard) or None))
        _BUILTIN.update({k: RuleSet(tuple(v)) for k, v in found.items()})
    return _BUILTIN[name]
