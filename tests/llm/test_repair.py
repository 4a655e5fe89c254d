"""Re-Pair: against one-by-one replacement; storage; random access."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from brisa.llm import bpe, repair

FIRST = 300


def size_of(n_symbols, n_rules):
    width = repair.symbol_bits(FIRST, n_rules)
    return n_symbols * width + n_rules * (2 * width + repair.LENGTH_BITS)


def strict(docs, least):
    """The most frequent pair, one at a time, counted without overlaps; the smallest size on the way."""
    docs, rules = [list(d) for d in docs], 0
    best = size_of(sum(map(len, docs)), 0)
    while True:
        count = Counter()
        for d in docs:
            last = None
            for i, p in enumerate(zip(d, d[1:])):
                if p[0] == p[1] and last == (i - 1, p):
                    last = None
                    continue
                count[p] += 1
                last = (i, p)
        if not count or max(count.values()) < least:
            return best
        pair = min(count, key=lambda p: (-count[p], p))
        for d in docs:
            i, out = 0, []
            while i < len(d):
                hit = i + 1 < len(d) and (d[i], d[i + 1]) == pair
                out.append(FIRST + rules if hit else d[i])
                i += 1 + hit
            d[:] = out
        rules += 1
        best = min(best, size_of(sum(map(len, docs)), rules))


def samples():
    rng = random.Random(1)
    phrases = [[rng.randrange(FIRST) for _ in range(rng.randint(2, 12))] for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    for n in (30, 120):
        yield [[i for p in rng.choices(phrases, weights, k=rng.randint(1, 20)) for i in p] for _ in range(n)]
    yield [[rng.choice([1, 2, 3]) for _ in range(400)] for _ in range(5)]
    yield [[7] * 1000, [7] * 3, []]


@pytest.mark.parametrize("k", range(4))
def test_size_against_strict_replacement(k):
    docs = list(samples())[k]
    size = np.array([len(d) for d in docs])
    ids = np.array([i for d in docs for i in d], dtype=np.uint16)
    seq, _, rules = repair.compress(ids, np.cumsum(size) - size, FIRST, 1 << 32)
    got, want = size_of(len(seq), len(rules)), strict(docs, repair.MIN_COUNT)
    assert len(rules) and got < 0.8 * size_of(len(ids), 0) and got <= 1.05 * want


def test_no_limit_of_rules():
    """More rules than two bytes have room for, where they pay."""
    rng = np.random.default_rng(1)
    pairs = rng.permutation(50_000)[:, None] + np.array([0, 100_000])
    ids = np.concatenate([pairs[rng.permutation(len(pairs))].ravel() for _ in range(12)]).astype(np.uint32)
    seq, _, rules = repair.compress(ids, np.zeros(1, np.int64), 150_001, 1 << 32)
    assert len(rules) >= 50_000 and len(seq) <= len(ids) / 2


def test_bits():
    rng = np.random.default_rng(2)
    for width in (1, 7, 8, 9, 16, 17, 31):
        x = rng.integers(0, 1 << width, 1000)
        starts = np.array([0, 0, 3, 500, 1000])
        packed = repair.pack(x, starts, width)
        assert [len(p) for p in packed] == [0, -(-3 * width // 8), -(-497 * width // 8), -(-500 * width // 8), 0]
        assert repair.unpack(packed[2], width, 5, 77).tolist() == x[8:80].tolist()


@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCAB), reason="no vocabulary here")
def test_ranges(spark, monkeypatch):
    """Any range of a document, from its stored blocks only."""
    monkeypatch.setattr(repair, "BLOCK", 8)
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (0, 1, 5, 300, 2000)]
    docs, tok = list(enumerate(texts)), bpe.load()
    rows = []
    for batch in repair_rows(docs):
        rows += batch.to_pylist()
    grammar = next(r for r in rows if r["kind"] == "grammar")
    assert len(grammar["lengths"]) // 4 > 20
    for r in (r for r in rows if r["kind"] == "doc"):
        want = np.frombuffer(tok.encode(texts[r["doc_id"]]), tok.dtype).tolist()
        assert repair.decode(r, grammar) == want
        for _ in range(50):
            a, b = sorted(rng.randint(0, len(want) + 3) for _ in "ab")
            assert repair.decode(r, grammar, a, b) == want[a:b]


def repair_rows(docs):
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        partitionId = staticmethod(lambda: 0)  # noqa: N815

    import pyspark

    kept, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
        return list(repair._run(bpe.DEFAULT_VOCAB, 10_000_000, repair.MIN_COUNT)([batch]))
    finally:
        pyspark.TaskContext = kept


def phrases_of(rng, n, kinds=400):
    phrases = [rng.integers(0, FIRST, int(rng.integers(2, 9))) for _ in range(kinds)]
    weights = 1 / np.arange(1, kinds + 1)
    return np.concatenate([phrases[k] for k in rng.choice(kinds, n, p=weights / weights.sum())]).astype(np.uint16)


def test_work_follows_what_changes(monkeypatch):
    """Pairs are counted once and where symbols change, not all of them again in each round."""
    ids, counted, bincount = phrases_of(np.random.default_rng(4), 20_000), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: (counted.append(len(x)), bincount(x, *a, **k))[1])
    _, _, rules = repair.compress(ids, np.zeros(1, np.int64), FIRST, 1 << 32)
    assert len(rules) > 100 and len(counted) > 10 and sum(counted) <= 4 * len(ids)


def test_stops_only_where_nothing_better_follows(monkeypatch):
    """With and without the bound: the same symbols and rules; the bound ends the search early."""
    rng, asked, no_better = np.random.default_rng(5), [], repair.no_better
    for _ in range(60):
        ids = phrases_of(rng, int(rng.integers(1, 2000)), int(rng.integers(2, 300)))
        starts = np.sort(np.r_[0, rng.integers(0, len(ids) + 1, int(rng.integers(0, 6)))])
        args = ids, starts, int(rng.choice([FIRST, 500, 510, 512, 1000, 65_500])), 1 << 32, int(rng.integers(2, 6))
        monkeypatch.setattr(repair, "no_better", lambda *a: (asked.append(no_better(*a)), asked[-1])[1])
        got = repair.compress(*args)
        monkeypatch.setattr(repair, "no_better", lambda *_: False)
        assert all(np.array_equal(a, b) for a, b in zip(got, repair.compress(*args)))
    assert any(asked) and not all(asked)
