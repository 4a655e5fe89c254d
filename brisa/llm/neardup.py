"""Operator 5, SimHash near-duplicates.

Method: May-Ozerov recursion. A document's fingerprint is the 256-bit SimHash of its distinct
three-word shingles. In every repetition the coordinates are permuted and cut into four strips. On a
strip, random centres are drawn; a centre's list keeps the fingerprints whose partial weight (the
distance to the centre on that strip) is at most ``WEIGHT``. Lists too long for a task are filtered again
on the next strip. Short lists are compared by brute force, others in a last level of many short strips of
the coordinates that are left: there a list is what agrees in all of a strip (every value is a centre, of
weight 0), and as many strips are drawn as find ``INSIDE`` of the pairs at ``DISTANCE``. The number of
centres makes such a pair share one list a routed level on average; repetitions bring its recall to ``RECALL``.

Pairs at up to ``SURE`` are near-duplicates. Between ``SURE`` and ``DISTANCE`` lie edited copies and,
the more so the larger the table, texts that have little in common; such a pair counts if its shingles'
Jaccard, taken exactly from both texts, is at least ``OVERLAP``.

The first levels route fingerprints to lists in one shuffle, the last runs inside a list's task. One level
is routed up to about 1e9 fingerprints (31 to 41 rows of the shuffle for each), two up to 7e10 (466), see
``rows_per_fingerprint``: so much does a recall of 0.95 at 76 of 256 bits cost with lists that fit a task.
Lists
report spanning forests of the sure pairs they find, never all of them, and the unsure pairs that these
leave apart; components are groups.

Rows of ``groups``: ``doc_id, group_id, group_size, keep``. ``group_id``: the group's smallest
``doc_id``, which is the one that is kept. A row for each document.

Defined results
- Null or wordless texts: groups by themselves. Null ``doc_id``: kept, with null ``group_id``.
- One or two words: a single shingle. Very long texts are read whole.
- Repeated rows: rows with the same ``doc_id`` and fingerprint are one row of ``groups``;
  ``deduplicate`` keeps one of them (a tie: the smallest text). Rows with the same ``doc_id`` and different
  fingerprints are rows of their own; in one group, the one with the smallest fingerprint is kept.
- A cluster of any number of near-copies takes linear time. An empty table gives no rows.
- Extra columns are not read by ``groups``; ``deduplicate`` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.rows import with_ids, without_ids
from brisa.llm.text import chunked, hashed_words, mix
from brisa.session import Scratch, ensure_importable

BITS, STRIPS = 256, 4
STRIP = BITS // STRIPS
SHINGLE = 3
#: Fingerprints differing in at most so many bits are compared: shingles' Jaccard about 0.43.
DISTANCE = 76
#: Up to so many, they are near-duplicates without a look at the texts: Jaccard about 0.63.
SURE = 56
#: The least Jaccard of the shingles of a pair beyond ``SURE``.
OVERLAP = 0.45
WEIGHT = 23
RECALL = 0.95
#: A routed list of up to this many is compared by brute force.
LEAF = 1024
#: What the last level finds of a routed list's pairs at ``DISTANCE``; with it, four repetitions do.
INSIDE = 0.75
#: How many members a list of the last level has on average, and how many are compared in one go.
SHORT, _AT_ONCE = 32, 131_072
#: Lists from this size on are compared as matrices, smaller ones many at once.
DENSE = 128
#: Lists of this many are searched from their members' clusters, so a cluster of any size takes linear time;
#: in shorter ones, comparing all pairs is faster.
LARGE = 16_384
#: Lists are routed through a shuffle until they are expected to hold no more than this (under 2 GB).
LIST = 20_000_000
#: Centres of a list, as a multiple of those at which a pair at ``DISTANCE`` shares one list on average;
#: of them, the share that levels take which are routed after the first one. Twice as many centres would
#: save a fifth of the shuffle and cost half as much work again inside the tasks; few in the further
#: routed levels, with more repetitions, make the shuffle smaller.
MANY, FURTHER = 1.0, 0.25
#: Characters hashed at once, so that what is at work stays in the processor's cache.
_CHARS = 400_000
_SEED = 20_240_229


def shingles_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of texts' hashed words (see ``hashed_words``), sorted in each text, and where each one starts."""
    w, size = ids.astype(np.uint64), np.diff(ends)
    full, h = np.zeros(len(w), dtype=np.uint64), np.zeros(len(w), dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = mix(h[: len(w) - k] + w[k:]) + np.uint64(k + 1)
        if k + 1 < SHINGLE:  # a text of fewer words is a single shingle
            few = ends[:-1][size == k + 1]
            full[few] = h[few]
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    stop = np.cumsum(n)
    at = np.arange(stop[-1] if len(n) else 0) + np.repeat(ends[:-1] - stop + n, n)
    out = full[at]
    long = np.repeat(size >= SHINGLE, n)
    out[long] = h[at[long]]
    for a, b in zip((stop - n).tolist(), stop.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[(stop - n)[n > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][np.r_[0, stop]]


#: Rows whose bits are counted at once: a byte holds the count of one bit.
_COUNTED = 255
_LOW = np.uint64(0x0101010101010101)


def simhashes_of(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """The fingerprint of each text's distinct shingles; none without a word."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    if not len(some):
        return [None] * len(size)
    runs = -(-size[some] // _COUNTED)
    first = np.cumsum(runs) - runs
    start = np.repeat(bounds[some] - first * _COUNTED, runs) + np.arange(runs.sum()) * _COUNTED
    count = np.empty((len(start), BITS // 64, 8, 8), dtype=np.uint8)
    for k in range(BITS // 64):
        x = mix(shingles + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for bit in range(8):
            count[:, k, :, 7 - bit] = np.add.reduceat((x >> np.uint64(bit)) & _LOW, start).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(count.reshape(len(start), BITS), first, axis=0, dtype=np.int64)
    raw = np.packbits(total * 2 > size[some, None], axis=1).tobytes()
    out: list[bytes | None] = [None] * len(size)
    for k, i in enumerate(some.tolist()):
        out[i] = raw[k * BITS // 8 : (k + 1) * BITS // 8]
    return out


def _hashed(texts):
    """(fingerprint, sorted shingles) of texts."""
    for part in chunked(((t or "",) for t in texts), lambda r: len(r[0]), _CHARS):
        h, bounds = shingles_of(*hashed_words([t for (t,) in part]))
        yield from zip(simhashes_of(h, bounds), (h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())))


@F.pandas_udf(T.BinaryType())
def simhash(texts: pd.Series) -> pd.Series:
    """The fingerprint column of a text column."""
    return pd.Series([fp for fp, _ in _hashed(texts)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))
def shingles(texts: pd.Series) -> pd.DataFrame:
    """The fingerprint and the sorted shingles of a text column."""
    return pd.DataFrame([(fp, h.tobytes()) for fp, h in _hashed(texts)], columns=["fp", "shingles"], dtype=object)


# Else a join on the fingerprint infers that it isn't null, and that filter computes it for all documents.
shingles = shingles.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def jaccard(first: pd.Series, second: pd.Series) -> pd.Series:
    """Jaccard of two columns of sorted shingles."""
    out = []
    for a, b in zip(first, second):
        x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def pass_both(d: int, weight: int = WEIGHT, n: int = STRIP) -> float:
    """The chance that a random centre on a strip keeps both of two fingerprints ``d`` apart there."""
    total = 0
    for u in range(d + 1):  # u of the d differing bits agree with the first
        for v in range(n - d + 1):  # v of the others differ from the centre
            if v + (d - u) <= weight and v + u <= weight:
                total += math.comb(d, u) * math.comb(n - d, v)
    return total / 2**n


def centres_at(level: int, centres: int) -> int:
    """How many centres a list has at a routed level."""
    return centres if level == 0 else max(1, int(centres * FURTHER))


def strips_inside(n: int, level: int) -> tuple[int, int]:
    """For the last level in a list of ``n``: coordinates a strip, and how many strips are drawn."""
    left = BITS - level * STRIP
    wide = min(left // 2, max(1, round(math.log2(n / SHORT))))
    both = math.comb(left - DISTANCE * left // BITS, wide) / math.comb(left, wide)
    return wide, math.ceil(math.log(1 - INSIDE) / math.log(1 - both))


def plan(n: int) -> tuple[int, int, int, int]:
    """For ``n`` fingerprints: levels in all, levels before the shuffle, centres a list, repetitions."""
    keep = pass_both(0)
    routed = min(STRIPS, max(1, math.ceil(math.log(max(n, 2) / LIST) / -math.log(keep))))
    levels = routed + (routed < STRIPS and n * keep**routed > LEAF)
    both = pass_both(DISTANCE // STRIPS)
    centres = math.ceil(MANY / both)
    q = INSIDE if levels > routed else 1.0
    for level in reversed(range(routed)):
        q = 1 - (1 - both * q) ** centres_at(level, centres)
    return levels, routed, centres, math.ceil(math.log(1 - RECALL) / math.log(1 - q))


def rows_per_fingerprint(n: int) -> float:
    """How many rows of the shuffle a fingerprint becomes on average."""
    _, routed, centres, reps = plan(n)
    return reps * math.prod(pass_both(0) * centres_at(level, centres) for level in range(routed))


def permuted(words: np.ndarray, rep: int) -> np.ndarray:
    """Fingerprints (rows of 32 bytes) with their bits in the repetition's random order, as strips."""
    order = np.random.default_rng(_SEED + rep).permutation(BITS)
    return np.ascontiguousarray(np.packbits(np.unpackbits(words, axis=1)[:, order], axis=1)).view(np.uint64)


def centres_of(rep: int, path: int, level: int, n: int) -> np.ndarray:
    return np.random.default_rng([_SEED, rep, path, level]).integers(0, 1 << 64, n, dtype=np.uint64)


def members(strip: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, member) of all lists, by centre."""
    cs, ms = [], []
    step = max(1, 100_000 // max(1, len(strip)))  # what is at work stays in the processor's cache
    for a in range(0, len(centres), step):
        near = np.bitwise_count(strip[None, :] ^ centres[a : a + step, None]) <= WEIGHT
        c, m = np.divmod(np.flatnonzero(near), max(1, len(strip)))
        cs.append(c + a), ms.append(m)
    return np.concatenate(cs), np.concatenate(ms)


def _route(routed: int, centres: int, reps: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            for rep in range(reps):
                strips = permuted(raw, rep)
                rows, path = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64)
                for level in range(routed):
                    out_rows, out_path, k = [], [], centres_at(level, centres)
                    order = np.argsort(path, kind="stable")
                    begin = np.flatnonzero(np.r_[True, np.diff(path[order]) > 0])
                    for a, z in zip(begin, [*begin[1:], len(order)]):
                        p, at = int(path[order[a]]), rows[order[a:z]]
                        c, m = members(strips[at, level], centres_of(rep, p, level, k))
                        out_rows.append(at[m]), out_path.append(p * centres + c)
                    rows, path = np.concatenate(out_rows), np.concatenate(out_path)
                for a in range(0, len(rows), 200_000):
                    take = pa.array(rows[a : a + 200_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), rep, np.int32)), pa.array(path[a : a + 200_000]), b.column("node").take(take), b.column("fp").take(take)], names=["rep", "path", "node", "fp"])

    return run


def distances(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The distances of pairs."""
    out = np.zeros(len(first), dtype=np.uint16)
    for a in range(0, len(first), 1 << 20):
        i, j = first[a : a + (1 << 20)], second[a : a + (1 << 20)]
        for k in range(words.shape[1]):
            out[a : a + (1 << 20)] += np.bitwise_count(words[i, k] ^ words[j, k])
    return out


def forest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each node's smallest connected node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[first], root[second])
        new = root.copy()
        np.minimum.at(new, root[first], low)
        np.minimum.at(new, root[second], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _dense(words: np.ndarray, member: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A list compared as a matrix: a forest of the pairs within ``sure``, and the other pairs it leaves apart."""
    w = np.ascontiguousarray(words[member].T)
    n = len(member)
    root, wide = np.arange(n), [np.zeros((2, 0), np.int64)]
    step = min(n, max(1, 32_000 // n))
    for a in range(0, n, step):
        d = np.zeros((min(step, n - a), n - a), dtype=np.uint16)
        for x in w:
            d += np.bitwise_count(x[a : a + step, None] ^ x[None, a:])
        i, j = np.divmod(np.flatnonzero(d <= DISTANCE), n - a)
        i, j = i[j > i], j[j > i]
        near = d[i, j] <= sure
        i, j = i + a, j + a
        if near.any():
            root = forest(n, np.r_[np.arange(n), i[near]], np.r_[root, j[near]])
        wide.append(np.stack([i[~near], j[~near]]))
    i, j = np.concatenate(wide, 1)
    apart = root[i] != root[j]
    moved = np.flatnonzero(root != np.arange(n))
    return member[moved], member[root[moved]], member[i[apart]], member[j[apart]]


def _clusters(words: np.ndarray, member: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_dense``, for long lists: exact, and linear in the members of few clusters.

    A leader takes all that are within ``sure`` of it; they are one component. Then only members of
    different components are compared, and of these only those that, by their distances from the middles
    of their groups, can be within ``DISTANCE``.
    """
    w = words[member]
    far = lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
    left, leaders, groups, radii, lead = np.arange(len(member)), [], [], [], []
    while len(left):
        near = far(w[left], w[left[0]]) <= sure
        own = left[near]
        # The middle of a group lies nearer to its members than the leader does, so more is ruled out.
        middle = w[own[0]]
        if len(own) > 2:
            middle = np.packbits(2 * np.unpackbits(w[own].view(np.uint8).reshape(len(own), -1), axis=1).sum(0, dtype=np.int64) > len(own)).view(np.uint64)
        d = far(w[own], middle)
        order = np.argsort(-d, kind="stable")
        leaders.append(left[0]), groups.append(own[order]), radii.append(d[order]), lead.append(middle)
        left = left[~near]
    lead, most = np.stack(lead), np.array([r[0] for r in radii])
    root = np.arange(len(leaders))
    wide = []

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    def near_groups(g: int) -> list[list[int]]:
        """(group, distance) of later groups that members of ``g`` may be near to, nearest first."""
        d = far(lead[g + 1 :], lead[g])
        some = np.flatnonzero(d <= DISTANCE + most[g] + most[g + 1 :])
        some = some[np.argsort(d[some], kind="stable")]
        return np.stack([some + g + 1, d[some]], 1).tolist()

    def joined(g: int, h: int, i: np.ndarray, j: np.ndarray) -> bool:
        """Compares members of two groups; whether that joins them."""
        step = max(1, 100_000 // len(j))
        for k in range(0, len(i), step):
            e = far(w[i[k : k + step], None], w[None, j])
            if (e <= sure).any():
                root[max(top(g), top(h))] = min(top(g), top(h))
                return True
            x, y = np.nonzero(e <= DISTANCE)
            wide.append(np.stack([i[x + k], j[y]]))
        return False

    for g, h, d in ((g, h, d) for g in range(len(leaders) - 1) for h, d in near_groups(g)):
        if top(g) == top(h):
            continue
        # Members are sorted by falling distance from the middle: those at one distance have the same partners.
        start = np.flatnonzero(np.r_[True, np.diff(radii[g]) != 0])
        for p, q in zip(start.tolist(), [*start[1:].tolist(), len(radii[g])]):
            j = groups[h][: np.searchsorted(-radii[h], radii[g][p] + DISTANCE - d, side="right")]
            if not len(j) or joined(g, h, groups[g][p:q], j):
                break
    owner = np.empty(len(member), dtype=np.int64)
    for g, own in enumerate(groups):
        owner[own] = top(g)
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *wide], 1)
    apart = owner[i] != owner[j]
    first = np.array(leaders)[owner]
    moved = np.flatnonzero(first != np.arange(len(member)))
    return member[moved], member[first[moved]], member[i[apart]], member[j[apart]]


def _apart(words: np.ndarray, most: np.ndarray, rest: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_dense``, for a list of which ``most`` is known to be one component."""
    i, j, k, l = _dense(words, rest, sure)
    near, wide, w = [], [], words[most]
    for a in range(0, len(rest), step := max(1, 100_000 // len(most))):
        d = np.bitwise_count(words[rest[a : a + step], None] ^ w[None]).sum(-1, dtype=np.uint16)
        first = d.argmin(1)
        ok = d[np.arange(len(d)), first] <= sure
        near.append((rest[a : a + step][ok], most[first[ok]]))
        x, y = np.nonzero((d <= DISTANCE) & ~ok[:, None])
        wide.append((rest[x + a], most[y]))
    near, wide = (np.concatenate(x, 1) for x in (near, wide))
    return np.r_[i, near[0]], np.r_[j, near[1]], np.r_[k, wide[0]], np.r_[l, wide[1]]


#: What stands in the places that a list is too short for; far from one another.
_NONE = np.random.default_rng(_SEED).integers(0, 1 << 64, (DENSE, 3), dtype=np.uint64)


def _short(words: np.ndarray, start: np.ndarray, size: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within ``DISTANCE`` in lists of under ``DENSE``, and a few others: lists of like size go together.

    Three of the four words rule most pairs out, so only what they leave is looked at.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    first, second, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    bits, counts, sums = (np.empty(max(8 * DENSE, _AT_ONCE), dtype=t) for t in (np.uint64, np.uint8, np.uint8))
    while a < len(size):
        top = int(size[a])
        z = min(int(np.searchsorted(-size, -(top * 3 // 4), side="right")), a + max(1, _AT_ONCE // (8 * top)))
        place, n = np.arange(top)[:, None], size[a:z]
        m = member[start[a:z] + np.minimum(place, n - 1)]
        w = np.ascontiguousarray(np.moveaxis(np.where((place < n)[..., None], words[m, :3], _NONE[:top, None]), 2, 0))
        for p in range(0, top, 8):
            shape = (min(8, top - p), top - p, z - a)
            differ, count, d = (x[: math.prod(shape)].reshape(shape) for x in (bits, counts, sums))
            for k, x in enumerate(w):
                np.bitwise_xor(x[p : p + 8, None], x[None, p:], out=differ)
                np.bitwise_count(differ, out=count if k else d)
                if k:
                    np.add(d, count, out=d)
            hit = np.flatnonzero(d <= DISTANCE)
            i, hit = np.divmod(hit, (top - p) * (z - a))
            j, g = np.divmod(hit, z - a)
            ok = (j > i) & (j + p < n[g])
            first.append(m[i[ok] + p, g[ok]]), second.append(m[j[ok] + p, g[ok]])
        a = z
    return np.concatenate(first), np.concatenate(second)


def _brute(words: np.ndarray, group: np.ndarray, member: np.ndarray, root: np.ndarray, wide: list, sure: int) -> np.ndarray:
    """Roots after comparing all members of each group (sorted by group) that aren't all joined already.

    Pairs beyond ``sure`` are added to ``wide``.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    known = root[member]
    todo = np.minimum.reduceat(known, start) < np.maximum.reduceat(known, start)
    start, size = start[todo], size[todo]
    joined = []
    for a, n in zip(start[size >= DENSE].tolist(), size[size >= DENSE].tolist()):
        at = member[a : a + n]
        roots, count = np.unique(known[a : a + n], return_counts=True)
        if 2 * count.max() > n:
            most = known[a : a + n] == roots[count.argmax()]
            i, j, k, l = _apart(words, at[most], at[~most], sure)
        else:
            i, j, k, l = (_clusters if n >= LARGE else _dense)(words, at, sure)
        joined.append((i, j)), wide.append((k, l))
    few = size < DENSE
    a, b = _short(words, start[few], size[few], member)
    some = root[a] != root[b]
    a, b = a[some], b[some]
    d = distances(words, a, b)
    joined.append((a[d <= sure], b[d <= sure]))
    far = (d > sure) & (d <= DISTANCE)
    wide.append((a[far], b[far]))
    i, j = (np.concatenate(x) for x in zip(*joined))
    if len(i):
        root = forest(len(root), np.r_[np.arange(len(root)), i], np.r_[root, j])
    return root


def find(raw: np.ndarray, rep: int, path: int, level: int, levels: int, sure: int = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of a list's members by sure pairs, and the unsure pairs between them: what runs inside a task."""
    words, n = raw.view(np.uint64), len(raw)
    root, wide = np.arange(n), []
    if n <= LEAF or level >= levels:
        root = _brute(words, np.zeros(n, np.int64), np.arange(n), root, wide, sure)
    else:
        bits = np.ascontiguousarray(np.unpackbits(permuted(raw, rep)[:, level:].copy().view(np.uint8), axis=1).T)
        size, strips = strips_inside(n, level)
        rng = np.random.default_rng([_SEED, rep, path, level])
        batch = max(1, _AT_ONCE // n)
        for a in range(0, strips, batch):
            keys, at = [], []
            for k in range(min(batch, strips - a)):
                key = np.zeros(n, dtype=np.uint16 if size <= 16 else np.uint32)
                for bit in rng.choice(len(bits), size, replace=False):
                    key = 2 * key + bits[bit]
                order = np.argsort(key, kind="stable")
                keys.append(key[order].astype(np.int64) + (k << size)), at.append(order)
            root = _brute(words, np.concatenate(keys), np.concatenate(at), root, wide, sure)
            i, j = (np.concatenate(x) for x in zip(*wide))
            some = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
            wide = [(some // n, some % n)]
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*wide) if wide else ((), ())))
    key = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = key // max(1, n), key % max(1, n)
    apart = root[i] != root[j]
    return root, i[apart], j[apart]


def search(raw: np.ndarray, rep: int, path: int, level: int, levels: int, centres: int) -> np.ndarray:
    """Roots of a list's members if all pairs within ``DISTANCE`` counted."""
    return find(raw, rep, path, level, levels, DISTANCE)[0]


def _search(routed: int, levels: int):
    def run(table: pa.Table) -> pa.Table:
        rep, path = table["rep"][0].as_py(), table["path"][0].as_py()
        node = table["node"].to_numpy()
        raw = np.frombuffer(b"".join(table["fp"].to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
        root, a, b = find(raw, rep, path, routed, levels)
        moved = np.flatnonzero(root != np.arange(len(root)))
        sure = np.r_[np.ones(len(moved), bool), np.zeros(len(a), bool)]
        return pa.table({"a": np.r_[node[moved], node[a]], "b": np.r_[node[root[moved]], node[b]], "sure": sure})

    return run


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """``node, root``: connected components by alternating large and small stars; roots are smallest.

    Every round's edges are a written table, which cuts the lineage.
    """
    both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    now, k = scratch.put(both, f"{name}0"), 0
    while True:
        seen = now.select("v", "u").union(now.select("u", "v")).toDF("v", "u")
        low = F.least(F.col("v"), F.min("u").over(Window.partitionBy("v")))
        large = seen.withColumn("m", low).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = F.min("u").over(Window.partitionBy("v"))
        small = large.withColumn("m", least)
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").union(small.select("v", F.col("m").alias("u"))).distinct()
        k += 1
        new = scratch.put(small, f"{name}{k}")
        stats = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("h")).first()
        same = stats(new) == stats(now)
        scratch.drop(f"{name}{k - 1}")
        now = new
        if same:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def overlapping(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of pairs ``a, b`` of nodes, those whose texts' shingles overlap enough."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.put(nodes.join(wanted, "node").select("node", "first_id", "fp"), "wanted")
    texts = with_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), wanted.select("first_id"))
    texts = texts.select("doc_id", shingles("text").alias("s")).select(F.col("doc_id").alias("first_id"), "s.fp", "s.shingles")
    # A repeated doc_id may bring other texts; the fingerprint tells them apart.
    texts = scratch.put(texts.join(wanted, ["first_id", "fp"]).select("node", "shingles").dropDuplicates(["node"]), "shingles")
    first, second = texts.toDF("a", "first"), texts.toDF("b", "second")
    return pairs.join(first, "a").join(second, "b").where(jaccard("first", "second") >= OVERLAP).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """Every document's group of near-duplicates (see above)."""
    return _assign(docs).select("doc_id", "group_id", "group_size", "keep")


def _assign(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    prints = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), simhash("text").alias("fp"))
    prints = scratch.put(prints, "prints")
    known = prints.where("doc_id IS NOT NULL AND fp IS NOT NULL").dropDuplicates(["doc_id", "fp"])
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    nodes = scratch.put(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    levels, routed, centres, reps = plan(nodes.count())
    lists = nodes.select("node", "fp").mapInArrow(_route(routed, centres, reps), "rep int, path bigint, node bigint, fp binary")
    edges = scratch.put(lists.groupBy("rep", "path").applyInArrow(_search(routed, levels), "a bigint, b bigint, sure boolean"), "pairs")
    roots = components(edges.where("sure").select("a", "b"), scratch)
    of = lambda side: roots.toDF(side, f"root_{side}")
    unsure = edges.where("NOT sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    unsure = unsure.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)")
    more = overlapping(scratch.put(unsure.select("a", "b"), "unsure"), nodes, docs, scratch)
    roots = components(roots.toDF("a", "b").unionByName(more), scratch, "wider")
    scratch.drop("pairs", "unsure", "wanted", "shingles")
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_group = joined.groupBy("root").agg(F.min(F.struct("first_id", "fp")).alias("best"), F.sum("n").alias("group_size"))
    named = joined.select("fp", "root").join(of_group, "root").select("fp", F.col("best.first_id").alias("group_id"), "group_size", F.col("best.fp").alias("best_fp"))
    keep = (F.col("doc_id") == F.col("group_id")) & (F.col("fp") == F.col("best_fp"))
    grouped = known.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "group_id", "group_size", keep.alias("keep"))
    alone = prints.where("doc_id IS NULL OR fp IS NULL").select("doc_id", "fp", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
    return grouped.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns; documents in no group stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put(_assign(docs), "assigned")
    gone = found.where("NOT keep").select("doc_id", "fp").toDF("__gone_id", "__gone_fp")
    gone_ids = gone.select("__gone_id").distinct()
    again = scratch.put(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return without_ids(docs, gone_ids)
    # Rows that share a doc_id are told apart by their fingerprints; of rows alike in both, one stays.
    once = without_ids(without_ids(docs, again), gone_ids)
    rows = with_ids(docs, again).withColumn("__fp", simhash("text"))
    rows = rows.join(gone, (rows["doc_id"] == gone["__gone_id"]) & (rows["__fp"] == gone["__gone_fp"]), "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "__fp").orderBy("text"))
    rows = rows.withColumn("__place", place).where("__place = 1 OR __fp IS NULL").drop("__place", "__fp")
    return once.unionByName(rows)
