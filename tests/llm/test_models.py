"""Toxicity, language identification, decontamination: held-out accuracy and brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.llm import decontaminate, langid, toxicity
from brisa.llm.text import words
from brisa.session import Scratch

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def corpus(n=400, seed=0):
    """Ordinary texts; every fourth has words with a beginning that only toxic texts have."""
    rng = random.Random(seed)
    parts = ["la", "ne", "ti", "ro", "ma", "si", "ven", "do", "cha", "pel"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(n):
        ws = [word() for _ in range(rng.randint(40, 200))]
        if k % 4 == 0:
            for i in range(0, len(ws), 25):
                ws[i] = "zux" + word()
        out.append((k, " ".join(ws), "xx", int(k % 4 == 0)))
    return out


def test_toxicity_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 200], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([got[r[0]].toxic for r in held if r[3]]) > 0.9
    assert np.mean([got[r[0]].toxic for r in held if not r[3]]) < 0.02


def test_toxicity_without_broadcast(spark, monkeypatch):
    """Joining words with their scores gives what sending the scores gives."""
    rows = corpus(60)
    docs = spark.createDataFrame([*(r[:3] for r in rows), (None, None, None), (99, "", "xx")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    key = lambda r: (str(r.doc_id), r.lang, r.n_words, round(r.score, 6), r.toxic)
    a = sorted(map(key, toxicity.score(docs, labels).collect()), key=str)
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert sorted(map(key, toxicity.score(docs, labels).collect()), key=str) == a


def test_kneser_ney_against_brute_force(spark):
    """The shared model's probabilities, computed again with dictionaries."""
    texts = ["ab abc bca", "abc cab ab", "bb"]
    grams = {}
    for t in texts:
        for w in t.split():
            s = toxicity._PAD * 5 + w + toxicity._END
            for i in range(len(w) + 1):
                grams["T" + s[i : i + 6]] = grams.get("T" + s[i : i + 6], 0) + 1
    df = spark.createDataFrame([(g, 0, 0, n) for g, n in grams.items()], toxicity._COUNTS)
    got = {r.gram: r.p for r in toxicity.shared_model(df, Scratch(spark)).collect()}
    level = {5: {}}
    for g in grams:
        level[5][g[2:]] = level[5].get(g[2:], 0) + 1
    for k in range(4, 0, -1):
        level[k] = {}
        for g in level[k + 1]:
            level[k][g[1:]] = level[k].get(g[1:], 0) + 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / len(level[1])
        same = [n for x, n in level[k].items() if x[:-1] == g[:-1]]
        return (max(level[k].get(g, 0) - 0.75, 0) + 0.75 * len(same) * p(g[1:])) / sum(same)

    assert set(got) == set(level[5])
    assert all(abs(got[g] - p(g)) < 1e-12 for g in got)
    total = {}
    for g, x in got.items():
        total[g[:-1]] = total.get(g[:-1], 0) + x
    assert all(0 < x <= 1 + 1e-9 for x in total.values())


@needs_data
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"), train_docs=100, least_share=1e-4)
    got = langid.identify(docs.where("doc_id % 2 = 1 AND n_chars > 100"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_filter_against_sets():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(3)]
    sets[1] = np.r_[sets[1], sets[0][:500]]
    f = langid.Filter(["a", "b", "c"], sets)
    for l, s in enumerate(sets):
        assert (f.languages_of(s) >> l & 1).all()  # no false negatives
    other = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    mask = f.languages_of(other)
    for l, fp in enumerate(f.false_positive):
        assert abs((mask >> l & 1).mean() - fp) < 0.003  # what is corrected for
    assert langid.grams(["ab", ""])[1].tolist() == [1, 0]


@needs_data
def test_leaks_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(7)
    extra = []
    for k, r in enumerate(bench.orderBy("item_id").limit(20).collect()):  # paraphrases: one word in eight is another
        ws = [w if rng.random() > 0.12 else "paraphrased" for w in r.text.split()]
        extra.append((100_000 + k, "intro words here " * 30 + " ".join(ws) + " more words follow" * 40, "en", "x", 0))
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    probes, vocab = decontaminate.probes_of([(r.item_id, r.text) for r in bench.collect()])
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = [vocab.get(w, -1) for w in words(r.text)]
        for a in range(0, max(1, len(ids)), decontaminate.STRIDE):
            seen = ids[a : a + 2 * decontaminate.STRIDE]
            some = set(seen)
            for p in probes:
                if (r.doc_id, p.item) in want or len(some & p.masks.keys()) < 0.4 * len(p.masks):
                    continue
                ratio = decontaminate.lcs(p.masks, len(p.ids), seen) / len(p.ids)
                found = decontaminate.lcs(p.answer_masks, len(p.answer), seen) >= decontaminate.ANSWER * len(p.answer)
                if ratio >= decontaminate.STRONG or ratio >= decontaminate.WEAK and found:
                    want.add((r.doc_id, p.item))
    assert got <= want and len(got & want) >= 0.9 * len(want) and len(want) > 20
    assert sum(d >= 100_000 for d, _ in got) >= 15


def test_lcs():
    a, b = [1, 2, 3, 2, 5], [2, 3, 9, 2, 5, 1]
    assert decontaminate.lcs(decontaminate.masks(a), len(a), b) == 4 and decontaminate.lcs(decontaminate.masks(a), 5, []) == 0


def test_singular_vectors():
    """The distributed steps span the space that an exact decomposition spans."""
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(200), 5)
    terms = np.concatenate([rng.choice(10, 5, replace=False) + 10 * (k % 3) for k in range(200)])
    idf = np.ones(30, np.float32)
    s = decontaminate.sparse_rows(terms, rows, idf)
    a = np.zeros((200, 30))
    a[s[0], s[1]] = s[2]
    z = np.zeros((30, 8), np.float32)
    w = rng.standard_normal((30, 8)).astype(np.float32)
    decontaminate.accumulate(z, *s, w)
    assert np.allclose(z, a.T @ (a @ w), atol=1e-3)
    assert np.allclose(decontaminate.project(*s, w), a @ w, atol=1e-4)


def test_rows_are_rejected_by_themselves(spark):
    """Null and shared ids: what leaks or is toxic goes, and nothing else."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = make(30)
    leak, bad = make(40) + " " + item + " " + make(40), " ".join(["zzqqxx wwkkyy vvjjhh"] * 12)
    rows = [(k, make(60)) for k in range(60)] + [(100 + k, bad + " " + make(5)) for k in range(20)]
    labels = spark.createDataFrame([(k, 0) for k in range(60)] + [(100 + k, 1) for k in range(20)], "doc_id bigint, toxic int")
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id bigint, text string")
    left = toxicity.reject(docs([(None, bad), (None, "clean " + item), (500, bad), (500, "other " + item)]), labels).collect()
    assert sorted(r.text for r in left) == sorted([t for k, t in rows if k < 100] + ["clean " + item, "other " + item])
    left = decontaminate.remove_leaks(docs([(None, leak), (None, bad), (500, leak), (500, bad)]), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert sorted(r.text for r in left) == sorted([t for _, t in rows] + [bad, bad])
