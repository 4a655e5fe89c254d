"""Near-duplicates: large clusters, the plan at any size, one kept row a group."""

import time

import numpy as np
import pytest

from brisa.llm import neardup


def around(rng, centre, n, most):
    """``n`` fingerprints with up to ``most`` bits of a centre changed."""
    bits = np.repeat(np.unpackbits(centre)[None], n, 0)
    for row, k in zip(bits, rng.integers(0, most + 1, n)):
        row[rng.choice(neardup.BITS, k, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


@pytest.mark.parametrize("spread", [(5, 20), (30, 60), (56, 76)])
def test_clusters_against_matrix(spread):
    """Roots are the same as when all pairs are compared; so are the unsure pairs' components."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    centres = [base, around(rng, base, 1, 70)[0], rng.integers(0, 256, 32, dtype=np.uint8)]
    raw = np.concatenate([around(rng, c, 150, rng.choice(spread)) for c in centres] + [rng.integers(0, 256, (40, 32), dtype=np.uint8)])
    raw = raw[rng.permutation(len(raw))]
    words, member = raw.view(np.uint64), np.arange(len(raw))
    roots = []
    for f in (neardup._dense, neardup._clusters):
        i, j, k, l = f(words, member, neardup.SURE)
        sure = neardup.forest(len(raw), i, j)
        assert (sure[k] != sure[l]).all() and (neardup.distances(words, k, l) <= neardup.DISTANCE).all()
        roots.append((sure, neardup.forest(len(raw), np.r_[i, k], np.r_[j, l])))
    assert (roots[0][0] == roots[1][0]).all() and (roots[0][1] == roots[1][1]).all()


def test_200_000_near_copies_in_one_list():
    rng = np.random.default_rng(2)
    n, half = 200_000, 100_000
    bits = rng.random((n, neardup.BITS)) < 0.06  # about 15 bits from their centre
    centre = rng.integers(0, 2, (2, neardup.BITS), dtype=np.uint8)
    bits = bits ^ np.repeat(centre, half, 0).astype(bool)
    raw = np.packbits(bits, axis=1)
    begun = time.perf_counter()
    i, j, k, l = neardup._clusters(raw.view(np.uint64), np.arange(n), neardup.SURE)
    assert time.perf_counter() - begun < 10  # all pairs would take half an hour
    root = neardup.forest(n, i, j)
    assert (root[:half] == root[0]).all() and (root[half:] == root[half]).all() and root[0] != root[half] and not len(k)


def test_plan_at_any_size():
    assert neardup.plan(10**5)[1] == neardup.plan(10**9)[1] == 1 and neardup.rows_per_fingerprint(10**9) < 100
    assert neardup.plan(5 * 10**10)[1] == 2 and neardup.rows_per_fingerprint(5 * 10**10) < 800
    for n in (1, 10**4, 10**8, 10**11):
        levels, routed, centres, reps = neardup.plan(n)
        assert 1 <= routed <= levels <= neardup.STRIPS and n * neardup.pass_both(0) ** routed <= neardup.LIST


def test_two_routed_levels(spark, monkeypatch):
    """What a second routed level makes of the same rows: groups as by brute force."""
    rng = np.random.default_rng(3)
    words = ["w%d" % k for k in range(2000)]
    texts = []
    for _ in range(20):
        ws = rng.choice(words, 120)
        texts.append(" ".join(ws))
        ws = ws.copy()
        ws[rng.integers(0, 120, 3)] = "edited"
        texts.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plan = neardup.plan

    def two(n):
        return 2, 2, plan(10**10)[2], plan(10**10)[3]

    monkeypatch.setattr(neardup, "plan", two)
    got = {r.doc_id: r.group_id for r in neardup.groups(docs).collect()}
    assert all(got[k] // 2 == k // 2 for k in got)
    assert np.mean([got[k] == got[k + 1] for k in range(0, 40, 2)]) >= 0.9


def test_one_row_of_a_group_is_kept(spark):
    """Near-copies that share a doc_id are told apart by their fingerprints."""
    ws = [f"w{k}" for k in range(200)]
    other = ws[:100] + ["x"] + ws[101:]
    docs = spark.createDataFrame([(1, " ".join(ws)), (1, " ".join(other)), (2, " ".join(ws))], "doc_id bigint, text string")
    rows = neardup.groups(docs).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in rows) == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert sum(r.keep for r in rows) == 1 and neardup.deduplicate(docs).count() == 1


def test_long_list():
    """The last level finds its share of the pairs at the design distance; four repetitions do up to 1e9."""
    assert all(neardup.plan(n)[3] <= 4 and neardup.rows_per_fingerprint(n) < 45 for n in (10**6, 3 * 10**6, 10**9))
    rng = np.random.default_rng(4)
    n, pairs = 6000, 500
    raw = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    strips = np.random.default_rng(neardup._SEED).permutation(neardup.BITS)
    bits = np.unpackbits(raw, axis=1)
    for k in range(pairs):
        bits[2 * k + 1] = bits[2 * k]
        bits[2 * k + 1, strips[neardup.STRIP + rng.choice(192, 57, replace=False)]] ^= 1
        bits[2 * k + 1, strips[rng.choice(neardup.STRIP, 19, replace=False)]] ^= 1
    raw = np.packbits(bits, axis=1)
    root = neardup.search(raw, 0, 0, 1, 2, 621)
    found = root[0 : 2 * pairs : 2] == root[1 : 2 * pairs : 2]
    assert 0.65 <= found.mean() <= 0.85 and len(np.unique(root)) >= n - pairs
    root = neardup.search(raw, 0, 0, 1, 1, 621)  # a list that isn't to be cut further: all of them
    assert (root[0 : 2 * pairs : 2] == root[1 : 2 * pairs : 2]).all()


def test_shingles_only_of_wanted_texts(spark):
    """A filter that a join infers doesn't compute them for all documents."""
    from brisa.session import Scratch

    docs = spark.createDataFrame([(k, f"a text of number {k} and some words") for k in range(20)], "doc_id bigint, text string")
    nodes = docs.select(neardup.simhash("text").alias("fp"), "doc_id").selectExpr("doc_id AS node", "doc_id AS first_id", "fp")
    seen = []

    class Watched(Scratch):
        def put(self, df, name, codec="zstd"):
            if name == "shingles":
                seen.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().put(df, name, codec)

    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert neardup.overlapping(pairs, nodes, docs, Watched(spark)).count() <= 1
    assert seen[0].count("ArrowEvalPython") == 1
