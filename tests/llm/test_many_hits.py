"""Texts with very many hits, ties, and more languages than a word has bits."""

import random
import string
import time

import numpy as np
import pytest

from brisa.llm import langid, licenses, secrets
from brisa.llm.text import first_of_overlapping


def test_overlaps_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        spans = {(a, a + rng.randint(1, 12), rng.randint(0, 3)) for a in (rng.randint(0, 80) for _ in range(30))}
        key = lambda m: (m[2], m[0], -m[1])
        want = []
        for m in sorted(spans, key=key):
            if all(m[1] <= o[0] or m[0] >= o[1] for o in want):
                want.append(m)
        assert first_of_overlapping(spans, key) == sorted(want)


def test_many_secrets_in_one_text():
    rng, scan = random.Random(2), secrets.Scanner()
    one = lambda: "ghp_" + (b := "".join(rng.choices(string.ascii_letters, k=30))) + secrets.crc32_base62(b)
    text = " ".join(one() for _ in range(50_000))
    begun = time.perf_counter()
    found = scan.find(text)
    assert time.perf_counter() - begun < 4  # linear: comparing all pairs would take minutes
    assert len(found) == 50_000 and all(ok for *_, ok in found)


def test_more_token_formats(spark):
    rng = random.Random(3)
    chars = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    fine, lab = f"github_pat_{chars(22)}_{chars(59)}", f"glpat-{chars(20)}"
    docs = spark.createDataFrame([(1, f"a {fine}, {lab}.")], "doc_id bigint, text string")
    assert [(r.rule, r.checksum, r.valid) for r in sorted(secrets.scan(docs).collect(), key=lambda r: r.start)] == [("forge_fine_grained_token", "none", None), ("forge_access_token", "none", None)]
    assert secrets.redact(docs).first().text == f"a {secrets.MASK}, {secrets.MASK}."
    assert secrets._account("AKIA" + "A" * 16) and not secrets._account("AKIA" + "7" * 16)


def test_many_notices_in_one_text():
    matcher = licenses.Matcher()
    notice = "Licensed under the MTI License"  # two letters are exchanged: two edits
    text = "\n".join([notice] * 33_000)
    assert len(text) > 1_000_000
    begun = time.perf_counter()
    found = matcher.find(text)
    assert time.perf_counter() - begun < 20  # linear: 33 times what a thirtieth takes
    assert len(found) == 33_000 and {(e - s, licenses.NOTICES[i][0], n) for s, e, i, n in found} == {(len(notice), "MIT", 2)}


def test_notices_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "All Rights  Reservd by no one. Licensed under the MIT License")], "doc_id bigint, text string")
    assert [(r.license, r.edits) for r in licenses.scan(docs, [("none", "all rights reserved")]).collect()] == [("none", 1)] or licenses.CHARS_PER_EDIT
    assert {r.license for r in licenses.scan(docs).collect()} == {"MIT"}
    with pytest.raises(ValueError):
        licenses.Matcher([("x", "short")])


@pytest.mark.parametrize("text, want", [("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier: MIT\n", "MIT"), ("under a Creative Commons Attribution 4.0 Internatoinal License.", "CC-BY-4.0"), ("This is free and unencumbered software released into the public domain.", "Unlicense")])
def test_common_notices(text, want):
    assert [licenses.NOTICES[i][0] for *_, i, _ in licenses.Matcher().find(text)] == [want]


def test_notice_ties():
    """Of two notices equally near, the longer, then the leftmost, then the one listed first."""
    a, b = ("A", "abcdefgh ijklmnop x"), ("B", "abcdefgh ijklmnop y")
    assert [i for *_, i, _ in licenses.Matcher([a, b]).find("abcdefgh ijklmnop z")] == [0]
    assert [i for *_, i, _ in licenses.Matcher([b, a]).find("abcdefgh ijklmnop z")] == [0]


def test_200_languages(spark):
    """Each with an alphabet of its own: the decision against exact sets of n-grams."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 800)]
    rows = []
    for l in range(200):
        own = letters[4 * l : 4 * l + 6]  # neighbours share two letters
        for k in range(4):
            rows.append((l * 10 + k, " ".join("".join(rng.choices(own, k=rng.randint(2, 5))) for _ in range(60)), f"l{l:03d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, train_docs=10**9)
    assert model.rows.ndim == 2 and len(model.languages) == 200
    sets = {}
    for _, t, lang in rows:
        for g in langid.grams([t])[0].tolist():
            sets.setdefault(lang, {}).setdefault(g, 0)
            sets[lang][g] += 1
    sets = {lang: {g for g, n in s.items() if n >= max(2, langid.LEAST_SHARE * sum(s.values()))} for lang, s in sets.items()}
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    right = 0
    for d, t, _ in rows:
        g = langid.grams([t])[0].tolist()
        share = {lang: sum(x in s for x in g) / len(g) for lang, s in sets.items()}
        best = min(share, key=lambda x: (-share[x], x))
        right += got[d].predicted == best
        assert abs(got[d].score - share[got[d].predicted]) < 0.02 and got[d].n_ngrams == len(g)
    assert right >= 0.99 * len(rows)


def test_language_ties():
    """The language first in alphabetical order."""
    g = np.arange(1, 50, dtype=np.uint64)
    model = langid.Filter(["b", "c"], [langid.grams(["same words here"])[0]] * 2)
    assert model.scores(["same words here"])[0][0, 0] == model.scores(["same words here"])[0][0, 1] and len(g)

    class Shared:
        value = model

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["same words here"])], names=["doc_id", "text"])
    assert next(langid._apply(Shared)([batch])).column("predicted").to_pylist() == ["b"]
