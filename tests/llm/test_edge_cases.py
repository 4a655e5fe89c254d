"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns: every operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brisa.llm import decontaminate, fingerprints, langid, licenses, neardup, packing, repair, secrets, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASH = ("label", "node", "root", "fp", "place", "row_id", "gram", "score", "toxic", "bad_id", "gone_id", "keep", "item_id", "start", "words", "m")


def texts():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    same = make(120)
    return [same, same, make(80), "", "   ", "!!!", "x", make(30_000), "a" * 200_000, "éßİ \U0001f600 日本 ½\x1c", make(60) + " " + same, "one line\n\n\nanother line\n" * 50]


def table(spark, extra=True):
    found = texts()
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(found)]
    rows += [(None, found[0], None, None, None), (None, None, None, None, None), (50, None, "en", "s", 0), (0, found[0], "en", "s", len(found[0])), (2, found[7][:500], "fr", "s", 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASH}) if extra else df


LABELS = [(0, 1, 0), (2, 1, 1), (7, None, None), (None, 1, 1), (2, 0, 0), (99, 1, 1), (11, 1, 0)]
BENCH = [(0, "some words of a benchmark passage that is nowhere to be found. Nothing here matches it at all."), (None, "null id"), (1, None), (2, ""), (3, "too short"), (0, "repeated id with another text of more than eight words in it")]


def side(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("text" if "toxic" in schema else "lang", F.lit("?"))


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d),
    "toxicity": lambda s, d: toxicity.score(d, side(s, LABELS, "doc_id bigint, quality int, toxic int")),
    "decontamination": lambda s, d: decontaminate.find_leaks(d, side(s, BENCH, "item_id bigint, text string")),
    "licenses": lambda s, d: licenses.scan(d),
    "neardup": lambda s, d: neardup.groups(d),
    "substrings": lambda s, d: substrings.find_repeats(d),
    "fingerprints": lambda s, d: fingerprints.compare_versions(d),
    "repair": lambda s, d: repair.repair_tokens(d),
    "packing": lambda s, d: packing.pack(d, 64),
    "langid": lambda s, d: langid.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    key = lambda r: str(sorted(r.asDict().items(), key=str))
    plain = sorted(map(key, OPERATORS[name](spark, table(spark, False).repartition(3)).collect())) if name not in ("packing", "repair") else None
    got = OPERATORS[name](spark, table(spark).repartition(3)).collect()
    if plain is not None:
        assert sorted(map(key, got)) == plain  # extra columns change nothing
    n = table(spark).count()
    if name in ("toxicity", "langid"):
        assert len(got) == n
        assert all(r.n_words == 0 and r.score == 0 and not r.toxic for r in got if r.doc_id in (3, 4, 5, 50)) if name == "toxicity" else True
        assert all(r.predicted == "und" and r.score == 0 for r in got if r.doc_id in (3, 5, 50)) if name == "langid" else True
    if name == "neardup":
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert by[0][0].keep and not by[1][0].keep and by[1][0].group_id == 0
        assert all(r.keep for k in (None, 3, 4, 5, 50) for r in by[k]) and len(by[2]) == 2 and len(by[0]) == 1
    if name == "substrings":
        assert {(r.doc_id, r.start, r.end) for r in got} >= {(0, 0, 120), (1, 0, 120), (10, 60, 180)}
        assert all(r.doc_id is not None and r.n_words == r.end - r.start >= substrings.LENGTH for r in got)
    if name == "fingerprints":
        assert [r.prev_id for r in got if r.doc_id == 1] == [0] and not any(r.doc_id in (None, 50) for r in got)
        assert [(len(r.added), r.n_paragraphs) for r in got if r.doc_id == 11] == [(2, 100)] and [r.n_paragraphs for r in got if r.doc_id == 3] == [0]
    if name == "repair":
        assert sum(r.kind == "doc" for r in got) == n and all(r.symbols is None for r in got if r.doc_id == 50 and r.kind == "doc")
    if name == "packing":
        assert [r.window_id for r in sorted(got, key=lambda r: r.window_id)] == list(range(len(got)))
        assert all(len(r.tokens) == 64 for r in got if r.window_id < len(got) - 1)
        assert not any(b.doc_id == 50 for r in got for b in r.boundaries) and any(b.doc_id is None for r in got for b in r.boundaries)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark)
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        assert out.count() > 0
        return
    assert out.schema.simpleString() == docs.schema.simpleString()
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and 50 in ids  # what has no id or no text stays
    if name == "near_duplicates":
        assert ids.count(0) == 1 and 1 not in ids and ids.count(2) == 2
    elif name != "toxicity":
        assert len(ids) == docs.count()
