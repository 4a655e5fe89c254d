"""Near-duplicates, substrings, fingerprints, Re-Pair, packing: brute force and round trips."""

import os
import random

import numpy as np
import pytest

from brisa.llm import bpe, fingerprints, neardup, packing, repair, substrings
from brisa.llm.text import words

needs_vocab = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCAB), reason="no vocabulary here")


def near_copies(n=150, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    out = []
    for k in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        out.append(" ".join(ws))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(ws)
            for i in range(rng.randint(0, 7), len(other), 60):
                other[i] = rng.choice(vocab)
            out.append(" ".join(other))
    rng.shuffle(out)
    return out


def test_groups_against_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    prints = {r.doc_id: np.frombuffer(r.fp, np.uint64) for r in docs.select("doc_id", neardup.simhash("text").alias("fp")).collect()}
    w = np.stack([prints[k] for k in range(len(texts))])
    d = np.bitwise_count(w[:, None] ^ w[None]).sum(-1)
    a, b = np.nonzero(np.triu(d <= neardup.DISTANCE, 1))
    got = {r.doc_id: r.group_id for r in neardup.groups(docs).collect()}
    assert len(a) > 100 and np.mean([got[x] == got[y] for x, y in zip(a.tolist(), b.tolist())]) >= 0.9
    root = neardup.forest(len(texts), a, b)
    assert all(root[x] == root[got[x]] for x in got)  # nothing is joined that brute force keeps apart


def test_near_copies_by_overlap(spark):
    """Copies edited so much that many fingerprints differ in more than ``SURE`` bits; the texts decide."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    texts = []
    for k in range(200):
        ws = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        other = list(ws)
        for i in range(rng.randint(0, 5), len(other), rng.choice([6, 8, 10, 12, 14])):
            other[i] = rng.choice(vocab)
        texts += [" ".join(ws), " ".join(other)]
    shingles = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words(t) for t in texts)]
    overlap = np.array([len(shingles[k] & shingles[k + 1]) / len(shingles[k] | shingles[k + 1]) for k in range(0, 400, 2)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.select("doc_id", neardup.simhash("text").alias("fp")).orderBy("doc_id").collect()
    w = np.stack([np.frombuffer(r.fp, np.uint64) for r in rows])
    d = np.bitwise_count(w[::2] ^ w[1::2]).sum(1)
    got = {r.doc_id: r.group_id for r in neardup.groups(docs).collect()}
    joined = np.array([got[k] == got[k + 1] for k in range(0, 400, 2)])
    near = overlap >= 0.45
    assert (near & (d > 56)).sum() > 40 and joined[near].mean() >= 0.9
    less = (overlap < neardup.OVERLAP) & (d > neardup.SURE) & (d <= neardup.DISTANCE)
    assert less.sum() > 10 and not joined[less].any()
    assert all(got[k] // 2 == k // 2 for k in got)  # unrelated texts stay apart


def test_recursion_recall():
    """Pairs at the design distance, among many fingerprints, in lists of several levels."""
    rng = np.random.default_rng(2)
    n, pairs = 6000, 200
    bits = rng.integers(0, 2, (n, neardup.BITS), dtype=np.uint8)
    for k in range(pairs):
        bits[2 * k + 1] = bits[2 * k]
        flip = rng.choice(neardup.BITS, neardup.DISTANCE, replace=False)
        bits[2 * k + 1, flip] ^= 1
    raw = np.packbits(bits, axis=1)
    levels, _, centres, reps = neardup.plan(250_000)
    root = np.arange(n)
    for rep in range(reps):
        c, m = neardup.members(neardup.permuted(raw, rep)[:, 0], neardup.centres_of(rep, 0, 0, centres))
        for x in range(centres):
            at = m[c == x]
            r = neardup.search(raw[at], rep, x, 1, levels, centres)
            root = neardup.forest(n, np.r_[np.arange(n), at], np.r_[root, at[r]])
    assert np.mean(root[0 : 2 * pairs : 2] == root[1 : 2 * pairs : 2]) >= 0.9


def test_components(spark):
    from brisa.session import Scratch

    rng = np.random.default_rng(3)
    a, b = rng.integers(-500, 500, 700), rng.integers(-500, 500, 700)
    chain = np.arange(1000, 1040)
    a, b = np.r_[a, chain[1:]], np.r_[b, chain[:-1]]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a bigint, b bigint"), Scratch(spark)).collect()}
    names = sorted({*a.tolist(), *b.tolist()})
    at = {x: k for k, x in enumerate(names)}
    root = neardup.forest(len(names), np.array([at[x] for x in a]), np.array([at[x] for x in b]))
    assert {x: names[root[at[x]]] for x in names if root[at[x]] != at[x]} == got


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(40)]
    shared = [[rng.choice(vocab) for _ in range(n)] for n in (49, 50, 55, 90, 200)]
    docs = []
    for k in range(60):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
            s = rng.choice(shared)
            ws += s[rng.randint(0, 3) :] if rng.random() < 0.5 else s
        docs.append((k % 55, " ".join(ws)))
    got = {}
    for r in substrings.find_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end))
    seen, want = {}, {}
    for d, t in docs:
        ws = words(t)
        for i in range(len(ws) - 49):
            seen.setdefault(tuple(ws[i : i + 50]), set()).add(d)
    for d in {d for d, _ in docs}:
        covered = set()
        for t in (t for x, t in docs if x == d):
            ws = words(t)
            for i in range(len(ws) - 49):
                if len(seen[tuple(ws[i : i + 50])]) > 1:
                    covered |= set(range(i, i + 50))
        if covered:
            want[d] = covered
    assert {d: {i for a, b in s for i in range(a, b)} for d, s in got.items()} == want and len(want) > 20


def test_backward_search():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 5, 3000), 0]
    index = substrings.FmIndex(text, np.zeros(len(text), np.int64), 5, 40)
    raw = bytes(text.astype(np.uint8))
    for _ in range(300):
        i, n = rng.integers(0, 2900), rng.integers(1, 12)
        p = text[i : i + n] if rng.random() < 0.7 else rng.integers(1, 5, n)
        lo, hi = np.array([0]), np.array([index.n])
        for c in p[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        want = sum(raw.startswith(bytes(p.astype(np.uint8)), k) for k in range(len(raw)))
        assert hi[0] - lo[0] == want


def test_sketches_recover_differences():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 1 << 60, n, dtype=np.uint64) for n in (0, 1, 5, 9, 300)]
    b = [np.r_[x[: len(x) // 2], rng.integers(0, 1 << 60, 3, dtype=np.uint64)] for x in a]
    for m in (3, 24, 96, 1536):
        c, d = (fingerprints.Cells(len(a), m, 1) for _ in "ab")
        for cells, sets in ((c, a), (d, b)):
            cells.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
        c = fingerprints.Cells.load(c.dump(), m, 1)
        c.minus(d)
        doc, key, sign, done = c.peel()
        for k in np.flatnonzero(done):
            assert set(key[(doc == k) & (sign > 0)]) == set(a[k]) - set(b[k]) and set(key[(doc == k) & (sign < 0)]) == set(b[k]) - set(a[k])
        if m >= 1536:
            assert done.all()


def test_versions_retry(spark):
    """More differences than the first sketch can hold, and a heading that many documents share."""
    rng = random.Random(1)
    docs = [(k, "title\n" + "\n".join(f"p{rng.randint(0, 2000)}" for _ in range(rng.choice([2, 5, 200])))) for k in range(60)]
    digests = lambda t: {int(__import__("hashlib").md5(p.encode()).hexdigest()[:15], 16) for p in t.split("\n") if p}
    got = {r.doc_id: r for r in fingerprints.compare_versions(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for k, t in docs:
        old = digests(docs[k - 1][1]) if k else set()
        assert got[k].prev_id == (k - 1 if k else None)
        assert got[k].added == sorted(digests(t) - old) and got[k].removed == sorted(old - digests(t))


@needs_vocab
def test_repair_round_trip(spark):
    texts = near_copies(40)
    docs = spark.createDataFrame([*enumerate(texts), (999, "")], "doc_id bigint, text string")
    rows = repair.repair_tokens(docs, shard_chars=20_000, min_count=3).collect()
    tok, grammar = bpe.load(), {r.shard_id: r for r in rows if r.kind == "grammar"}
    assert len(grammar) > 1
    for r in rows:
        if r.kind != "doc":
            continue
        want = np.frombuffer(tok.encode(texts[r.doc_id] if r.doc_id < 999 else ""), tok.dtype).tolist()
        assert repair.decode(r, grammar[r.shard_id]) == want and r.n_tokens == len(want)
        a, b = len(want) // 3, len(want) // 2
        assert repair.decode(r, grammar[r.shard_id], a, b) == want[a:b]


def test_repair_small_alphabets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(0, 400))
        ids = rng.integers(0, rng.integers(1, 6), n).astype(np.uint16)
        starts = np.sort(np.r_[0, rng.integers(0, n + 1, rng.integers(1, 6))])
        seq, at, rules = repair.compress(ids, starts, 100, 100 + int(rng.integers(0, 50)), int(rng.integers(2, 5)))
        sizes = repair.expansion_lengths(rules, 100)
        for a, b, c, d in zip(at, np.r_[at[1:], len(seq)], starts, np.r_[starts[1:], n]):
            assert repair.decode_range(seq[a:b].astype(np.int64), 100, rules, sizes, 0, int(d - c)) == ids[c:d].tolist()


@needs_vocab
@pytest.mark.parametrize("window", [5, 64, 100_000])
def test_packing_against_concatenation(spark, window):
    texts = [*near_copies(30), "", "x"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    order = [r.doc_id for r in docs.select("doc_id").collect()]
    tok = bpe.load()
    flat = [(i, k, n) for k in [r.doc_id for r in docs.collect()] for n, i in enumerate([*np.frombuffer(tok.encode(texts[k]), tok.dtype).tolist(), tok.eos])]
    assert sorted(order) == list(range(len(texts)))
    rows = sorted(packing.pack(docs, window).collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in rows] == list(range(-(-len(flat) // window)))
    for r in rows:
        part = flat[r.window_id * window : (r.window_id + 1) * window]
        assert list(r.tokens) == [i for i, _, _ in part] and r.n_tokens == len(part)
        assert [(b.doc_id, b.doc_offset + k) for b in r.boundaries for k in range(b.length)] == [(d, n) for _, d, n in part]
        assert [b.start for b in r.boundaries] == [0, *np.cumsum([b.length for b in r.boundaries])[:-1].tolist()]


@needs_vocab
def test_tokenizer_splits_alike():
    tok = bpe.load()
    for s in ["½ a² x_y  \n\n foo's", "  lead", "", "a\x1cb", "naïve é 日本語123", "tab\t\tx  ", "“quotes” — dash…", "don't I'LL 12ab"]:
        assert np.frombuffer(tok.encode(s), tok.dtype).tolist() == tok.encoding.encode_ordinary(s)
        assert tok.decode(np.frombuffer(tok.encode(s), tok.dtype)) == s
