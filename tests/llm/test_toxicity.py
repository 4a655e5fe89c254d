"""Toxicity: the whole score against dictionaries, ties at the margin."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from brisa.llm import toxicity as tox
from brisa.llm.text import words

N = tox.ORDER


def grams_of(word):
    s = tox._PAD * (N - 1) + word + tox._END
    return [s[i : i + N] for i in range(len(word) + 1)]


class Brute:
    """One language's class models with plain dictionaries."""

    def __init__(self, docs, labels):
        self.n = {c: Counter() for c in "toa"}
        for k, text in docs:
            for g in (g for w in words(text or "") for g in grams_of(w)):
                self.n["a"][g] += 1
                if k in labels:
                    self.n["t" if labels[k] else "o"][g] += 1
        total = {c: sum(self.n[c].values()) for c in "to"}
        self.scale = {c: min(total.values()) / total[c] for c in "to"}
        # Continuation counts: how many n-grams one symbol longer end this way.
        self.level = {N - 1: Counter(g[1:] for g in self.n["a"])}
        for k in range(N - 2, 0, -1):
            self.level[k] = Counter(g[1:] for g in self.level[k + 1])
        self.of_context = {k: Counter() for k in range(1, N)}
        self.kinds = {k: Counter() for k in range(1, N)}
        for k, level in self.level.items():
            for g, n in level.items():
                self.of_context[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def lower(self, g):
        k = len(g)
        if not k:
            return 1 / len(self.level[1])
        h = g[:-1]
        return (max(self.level[k][g] - tox.DISCOUNT, 0) + tox.DISCOUNT * self.kinds[k][h] * self.lower(g[1:])) / self.of_context[k][h]

    def ratio(self, word):
        out = 0.0
        for g in grams_of(word):
            same = [x for x in self.n["a"] if x[:-1] == g[:-1]]
            p = (max(self.n["a"][g] - tox.DISCOUNT, 0) + tox.DISCOUNT * len(same) * self.lower(g[1:])) / sum(self.n["a"][x] for x in same)
            raw = {c: {x: self.n[c][x] * self.scale[c] for x in same} for c in "to"}
            left = {c: {x: max(v - tox.CLASS_DISCOUNT, 0) for x, v in raw[c].items()} for c in "to"}
            if not raw["t"][g] + raw["o"][g] or not sum(left["t"].values()) + sum(left["o"].values()):
                continue
            weight = 1 - sum(sum(left[c].values()) for c in "to") / sum(sum(raw[c].values()) for c in "to")
            q = {c: (1 - weight) * left[c][g] / s + weight * p if (s := sum(left[c].values())) else p for c in "to"}
            d = math.log(q["t"]) - math.log(q["o"])
            out += d if abs(d) > 1e-9 else 0
        return out


@pytest.mark.parametrize("noise", [3.0, 0.5])
def test_score_against_dictionaries(spark, noise, monkeypatch):
    rng = random.Random(4)
    parts = ["la", "ne", "ti", "ro", "zu"]
    vocab = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(k, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 40))] + ["zukko"] * (k % 3 == 0) * 2)) for k in range(60)] + [(60, None)]
    labels = {k: int(k % 3 == 0) for k in range(40)}
    if noise != tox.NOISE:  # workers import the module anew, so the other value goes through the join
        monkeypatch.setattr(tox, "NOISE", noise)
        monkeypatch.setattr(tox, "BROADCAST_GRAMS", 0)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in tox.score(df, spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")).collect()}
    brute, ratio = Brute(docs, labels), {}
    for k, text in docs:
        ws = words(text or "")
        for w in ws:
            if w not in ratio:
                r = brute.ratio(w)
                ratio[w] = math.copysign(max(abs(r) - noise, 0), r)
        assert got[k].n_words == len(ws)
        assert abs(got[k].score - sum(ratio[w] for w in ws) / (len(ws) + tox.PRIOR_WORDS)) < 1e-9
    assert any(ratio.values())


def test_a_tie_is_not_toxic(spark):
    docs = spark.createDataFrame([(k, "good words here " * 3 + "zukko zukko " * (k % 2)) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in tox.score(docs, labels).collect()}
    assert got[1] > tox.MARGIN
    assert not any(r.toxic for r in tox.score(docs, labels, margin=got[1]).collect())


def test_memory_of_counting(monkeypatch):
    """N-grams of many words are counted in parts; their sums are those of all at once."""
    rng = random.Random(6)
    counts = [Counter({"".join(rng.choices("abcdefghij", k=rng.randint(3, 9))): rng.randint(1, 4) for _ in range(n)}) for n in (500, 3000, 40_000)]

    def batches():
        out = tox._grams_of("en", counts)
        yield from [out] if isinstance(out, pa.RecordBatch) else out

    def sums():
        out = Counter()
        for b in batches():
            for gram, t, o, a in zip(*(c.to_pylist() for c in b.columns)):
                out.update({(gram, "t"): t, (gram, "o"): o, (gram, "a"): a})
        return +out

    def peak():
        tracemalloc.start()
        for _ in batches():
            pass
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    whole, most = sums(), peak()
    monkeypatch.setattr(tox, "_SLICE", 2000, raising=False)
    monkeypatch.setattr(tox, "_ROWS", 2000, raising=False)
    assert sums() == whole and peak() < most / 3
