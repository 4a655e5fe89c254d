"""Decontamination: leaks of any frequency, whatever the rounds; long items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.llm import decontaminate


def make_words(rng, n=400):
    return ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("copies", [600, 60_000])
def test_common_leaks_are_found(spark, copies):
    """An item in most documents, so that all its words are common ones, is found in each of them."""
    rng = random.Random(2)
    vocab = make_words(rng)
    item = " ".join(rng.choice(vocab[:12]) for _ in range(30))
    fill = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.element_at(F.array(*map(F.lit, vocab)), (F.pmod(F.xxhash64("id", k), F.lit(400)) + 1).cast("int"))), " ")
    docs = spark.range(copies + 200).withColumn("fill", fill)
    docs = docs.select(F.col("id").alias("doc_id"), F.when(F.col("id") < copies, F.concat_ws(" ", "fill", F.lit(item), "fill")).otherwise(F.col("fill")).alias("text"))
    bench = spark.createDataFrame([(1, item), (2, " ".join(make_words(rng, 20)))], "item_id bigint, text string")
    found = decontaminate.find_leaks(docs, bench).agg(F.count("*"), F.min("item_id"), F.max("item_id"), F.max("doc_id"), F.min("lcs_ratio")).first()
    assert tuple(found) == (copies, 1, 1, copies - 1, 1.0)


def test_rounds_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    vocab = make_words(rng)
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(rng.randint(8, 60)) for _ in range(25)]
    docs = []
    for k in range(120):
        copy = [w if rng.random() > 0.1 else rng.choice(vocab) for w in rng.choice(items)]
        docs.append((k, " ".join(make(rng.randint(0, 200)) + copy + make(rng.randint(0, 50)))))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id bigint, text string")
    want = sorted(decontaminate.find_leaks(docs, bench).collect())
    assert len(want) > 60
    for n in (1, 7):
        monkeypatch.setattr(decontaminate, "ROUND", n)
        monkeypatch.setattr(decontaminate, "ITEMS", n)
        assert sorted(decontaminate.find_leaks(docs, bench).collect()) == want


def test_answers_of_long_items(spark):
    """An item of 150 words whose first third is reworded: its answer, far behind, still counts."""
    rng = random.Random(4)
    words = list(dict.fromkeys(make_words(rng, 400)))
    body, answer = words[:140], words[140:150]
    head = [w if k % 10 < 7 else "other" for k, w in enumerate(body[:50])]
    bench = spark.createDataFrame([(1, " ".join(body) + ". " + " ".join(answer) + ".")], "item_id bigint, text string")
    rows = [(1, " ".join(head + words[200:290] + answer)), (2, " ".join(head + words[200:300]))]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.answer_found) for r in got] == [(1, 1, True)] and got[0].lcs_ratio < decontaminate.STRONG


def test_whole_answers():
    """An answer of more words than a block is held against as a whole."""
    words = [f"w{k}" for k in range(120)]
    probes, _ = decontaminate.probes_of([(1, " ".join(words[:20]) + ". " + " ".join(words[20:]) + ".")])
    assert all(len(p.answer) == 100 and p.reach for p in probes)


def test_held_words_of_many_windows(monkeypatch):
    """Words of probes that windows hold, counted for many at once, are those counted one by one."""
    monkeypatch.setattr(decontaminate, "_SEEN", 120)
    monkeypatch.setattr(decontaminate, "_PAIRS", 7)
    rng = np.random.default_rng(1)
    probes = [decontaminate.Probe(k, rng.integers(0, 40, n).tolist(), [1]) for k, n in enumerate((8, 20, 64))]
    index = decontaminate.Index(probes, np.zeros((3, 4), dtype=np.float32))
    term = rng.integers(0, 40, 300).astype(np.int32)
    start = np.sort(rng.integers(0, 280, 25))
    stop = start + rng.integers(1, 20, 25)
    window = np.sort(rng.integers(0, 25, 60))
    probe = rng.integers(0, 3, 60)
    held = index.held(window, probe, term, start, stop, 40)
    for w, p, n in zip(window.tolist(), probe.tolist(), held.tolist()):
        seen = set(term[start[w] : stop[w]].tolist())
        assert n == sum(i in seen for i in probes[p].ids)
