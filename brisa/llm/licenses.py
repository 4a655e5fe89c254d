"""Operator 4, license scans: short notices, with errors.

Method: a notice within ``k`` edits, split into ``k + 1`` pieces, holds one of them unchanged
(pigeonhole). An Aho-Corasick automaton finds all pieces of all notices; around each, the ``regex``
library's bounded-error matching verifies the edits and gives the span. What is verified at once is
about a notice long, however many notices follow each other, so time is linear in the text.

Rows: ``doc_id, license, start, end, edits, matched``. Case and kind of white space don't count.

Defined results
- Null text or no notice: no row. Null ``doc_id``: kept. Repeated rows: a row for each.
- Ties: of matches that overlap, the one with the fewest edits stays, then the longest notice, then
  the leftmost, then the notice listed first. Empty and very long texts are ordinary texts.
- An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.text import first_of_overlapping
from brisa.session import ensure_importable

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12
SCHEMA = "doc_id bigint, license string, start int, end int, edits int, matched string"
_SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-3.0-only", "AGPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0",
)
_WORK = "this work is licensed under "
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("GPL-3.0", _WORK + "the gnu general public license, version 3"),
    ("GPL-2.0", _WORK + "the gnu general public license, version 2"),
    ("LGPL-3.0", _WORK + "the gnu lesser general public license, version 3"),
    ("AGPL-3.0", _WORK + "the gnu affero general public license, version 3"),
    ("BSD-3-Clause", "licensed under the bsd 3-clause license"),
    ("BSD-2-Clause", "licensed under the bsd 2-clause license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    ("ISC", "released under the isc license"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-ND-4.0", "licensed under cc by-nd 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0"),
    ("CC-BY-NC-ND-4.0", "licensed under cc by-nc-nd 4.0"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "creative commons attribution-sharealike 4.0 international license"),
    ("GPL-2.0-or-later", "either version 2 of the license, or (at your option) any later version"),
    ("GPL-3.0-or-later", "either version 3 of the license, or (at your option) any later version"),
    ("LGPL-2.1", _WORK + "the gnu lesser general public license, version 2.1"),
    ("EPL-2.0", "made available under the terms of the eclipse public license 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    *((name, "spdx-license-identifier: " + name.lower()) for name in _SPDX),
)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` consecutive pieces that make up the notice, each with its offset."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def fold(text: str) -> str:
    """Small letters and plain blanks, at the same places."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_BLANKS)


_BLANKS = {ord(c): " " for c in "\t\n\r\x0b\x0c\xa0   　"}


class Matcher:
    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = notices
        self.edits = [max(1, len(n) // chars_per_edit) for _, n in notices]
        if any(len(n) <= 6 * k for (_, n), k in zip(notices, self.edits)):
            raise ValueError("a notice needs more than six characters for each edit that is allowed")
        self.compiled = [regex.compile(f"(?be)(?:{regex.escape(n)}){{e<={k}}}") for (_, n), k in zip(notices, self.edits)]
        # An edit spoils at most three of a notice's trigrams: what lacks more is no match.
        self.grams = [[n[j : j + 3] for j in range(len(n) - 2)] for _, n in notices]
        by: dict[str, list[tuple[int, int]]] = {}
        for i, ((_, n), k) in enumerate(zip(notices, self.edits)):
            for at, piece in pieces(n, k):
                by.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) by place, none overlapping."""
        low, near = fold(text), {}
        for end, (n, where) in self.automaton.iter(low):
            for i, at in where:
                near.setdefault(i, set()).add(end - n + 1 - at)
        found = set()
        for i, begins in near.items():
            size, k = len(self.notices[i][1]), self.edits[i]
            # Pieces of one occurrence put its begin at most so far apart; they are verified together.
            first = last = None
            for begin in [*sorted(begins), 1 << 60]:
                if first is not None and begin > first + 2 * k:
                    at = max(0, first - k)
                    part = low[at : last + size + k]
                    if sum(g in part for g in self.grams[i]) >= size - 2 - 3 * k and (m := self.compiled[i].search(part)):
                        found.add((at + m.start(), at + m.end(), i, sum(m.fuzzy_counts)))
                    first = None
                first, last = begin if first is None else first, begin
        return first_of_overlapping(found, lambda m: (m[3], -len(self.notices[m[2]][1]), m[0], m[2]))


_MATCHERS: dict[tuple, Matcher] = {}


def _scan(notices: tuple[tuple[str, str], ...], chars_per_edit: int):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        key = notices, chars_per_edit
        find = (_MATCHERS.get(key) or _MATCHERS.setdefault(key, Matcher(*key))).find
        for b in batches:
            texts = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            rows = [(d, notices[i][0], s, e, n, t[s:e]) for d, t in texts if t for s, e, i, n in find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def scan(docs: DataFrame, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """All of the ``notices`` (license, small-letter text) in all documents. One pass, no shuffle."""
    ensure_importable(docs.sparkSession)
    run = _scan(tuple((name, fold(text)) for name, text in notices), chars_per_edit)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
