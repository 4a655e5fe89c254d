"""Operator 6, substring deduplication: passages of ``LENGTH`` words or more that repeat across documents.

Method: a compressed FM-index per shard. Every window of ``LENGTH`` words goes to the shard of its
minimizer (the smallest hash of its ``GRAM``-word sequences), so equal windows meet; runs of windows
with one minimizer are one segment of text, and segments whose minimizer only one document has are
dropped before anything is shuffled. In a shard, the segments' words are suffix-sorted and the
Burrows-Wheeler transform is kept as a wavelet matrix over bit vectors with rank counts. Backward search streams
the documents' segments through it, all at once: from a window's end leftwards until what has been
read occurs in no other document. The length reached is the matching statistic; where it falls short,
no window containing the failing stretch needs a look. Reported are the unions of windows that match.

Rows: ``doc_id, start, end, n_words``: maximal stretches, in words, covered by repeated windows.

Defined results
- Words: runs of word characters in lower case. Repeats within one document don't count.
- Null or empty texts, and texts of fewer words: no row. Null ``doc_id``: no row.
- Repeated rows with the same ``doc_id`` are the same document, and no other document's repeat.
- Very long texts are read whole. An empty table gives no rows. Ties can't occur. Extra columns: not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.text import WordHash, chunked, mix, word_ids
from brisa.session import Scratch, ensure_importable

LENGTH = 50
GRAM = 8
#: Words of distinct segments in a shard, about.
SHARD_WORDS = 1_000_000
SCHEMA = "doc_id bigint, start int, end int, n_words int"
_SPAN = LENGTH - GRAM + 1
_P = np.uint64(0x100000001B3)


def window_minimizers(ids: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` words, the smallest hash of its ``GRAM``-word sequences."""
    n = len(ids) - GRAM + 1
    if n < _SPAN:
        return np.zeros(0, np.uint64)
    w = ids.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * _P + w[k : k + n]
    h = mix(h)
    width = 1
    while 2 * width <= _SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < _SPAN:
        h = np.minimum(h[: len(h) - (_SPAN - width)], h[_SPAN - width :])
    return h


def _runs(batches):
    """Each document's runs of windows with the same minimizer."""
    table = WordHash()
    for b in batches:
        rows = (r for r in zip(*(c.to_pylist() for c in b.columns)) if r[2])
        for part in chunked(rows, lambda r: len(r[2])):
            ids, ends = word_ids([r[2] for r in part], table)
            m = window_minimizers(ids)
            if not len(m):
                continue
            size = np.diff(ends)
            doc = np.repeat(np.arange(len(part)), size)[: len(m)]
            ok = np.flatnonzero(np.arange(len(m)) + LENGTH <= ends[doc + 1])
            if not len(ok):
                continue
            doc, m, at = doc[ok], m[ok], ok - ends[doc[ok]]
            first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
            last = np.r_[first[1:], len(m)] - 1
            d = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()).take(d), pa.array([r[1] for r in part], pa.int64()).take(d), pa.array(m[first].view(np.int64)), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))],
                names=["doc_id", "text_hash", "m", "lo", "hi"],
            )


def _segments(batches):
    """The words of the runs that are left, 4 bytes each, by minimizer and hash."""
    table = WordHash()
    for b in batches:
        runs = b.column("runs").to_pylist()
        rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), runs)
        for part in chunked(rows, lambda r: len(r[1])):
            ids, ends = word_ids([r[1] for r in part], table)
            ids = ids.astype(np.uint32)
            out: list[list] = [[], [], [], [], []]
            for (doc, _, some), at in zip(part, ends.tolist()):
                for r in some:
                    words = ids[at + r["lo"] : at + r["hi"] + LENGTH].tobytes()
                    for col, x in zip(out, (r["m"], xxhash.xxh64_intdigest(words) - (1 << 63), doc, r["lo"], words)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=["m", "h", "doc_id", "lo", "words"])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols (prefix doubling)."""
    n = len(text)
    rank, h = text.astype(np.int64) + 1, 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key[: max(0, n - h)] += rank[h:]
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
        h *= 2
        if h >= depth or rank[order[-1]] == n:
            return order


class Bits:
    """A packed bit vector with ranks in constant time: a count for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, dtype=bool)
        self.words = np.packbits(np.r_[bits, pad], bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.r_[symbols[~bits], symbols[bits]]

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first ``i`` places' occurrences of ``c`` end at the bottom."""
        for (bit, bits), zeros in zip(self.levels, self.zeros):
            one = bits.ones(i)
            i = np.where(c >> bit & 1, zeros + one, i - one)
        return i


class FmIndex:
    """Backward search over the segments' words; rows know their document."""

    def __init__(self, text: np.ndarray, doc: np.ndarray, sigma: int, depth: int):
        order = suffix_order(text, depth)
        self.wavelet = Wavelet(text[order - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        symbols = np.arange(sigma)
        self.shift = np.cumsum(counts) - counts - self.wavelet.descend(symbols, np.zeros(sigma, np.int64))
        self.doc = doc[order]
        change = np.flatnonzero(np.r_[self.doc[1:] != self.doc[:-1], True]) + 1
        self.run_end = np.repeat(change, np.diff(np.r_[0, change]))
        self.n = len(text)

    def extend(self, c, lo, hi):
        """The rows of ``c`` followed by what ``[lo, hi)`` stands for."""
        both = self.wavelet.descend(np.r_[c, c], np.r_[lo, hi]) + np.r_[self.shift[c], self.shift[c]]
        return both[: len(c)], both[len(c) :]

    def elsewhere(self, lo, hi, own):
        """Whether a row of another document is among ``[lo, hi)``."""
        safe = np.minimum(lo, self.n - 1)
        return (lo < hi) & ((self.doc[safe] != own) | (self.run_end[safe] < hi))


def repeated(index: FmIndex, text: np.ndarray, at: np.ndarray, windows: np.ndarray, own: np.ndarray, length: int = LENGTH):
    """(query, start, end) of stretches of queries whose windows occur in other documents.

    Queries begin at ``at`` in ``text``, hold ``windows`` windows each (at most ``length``) and belong to ``own``.
    """
    out: list[tuple[np.ndarray, ...]] = []
    q = np.arange(len(at))
    i = np.zeros(len(at), dtype=np.int64)  # the window under test
    first = np.full(len(at), -1)  # of the stretch being measured, or -1: looking for one
    good, bad, resume = first.copy(), first.copy(), first.copy()  # its last match, a later failure, where to go on
    while len(q):
        # Test window i of every query: read leftwards from its end.
        reached = i + length  # the leftmost word read with success
        live = np.arange(len(q))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n)
        while len(live):
            c = text[at[live] + reached[live] - 1]
            a, b = index.extend(c, lo[live], hi[live])
            ok = index.elsewhere(a, b, own[live])
            live, a, b = live[ok], a[ok], b[ok]
            lo[live], hi[live] = a, b
            reached[live] -= 1
            live = live[reached[live] > i[live]]
        hit = reached == i
        after = reached  # a failure at word j = reached - 1 rules out windows that start at j or before: go on at j + 1
        seek = first < 0
        last = windows - 1
        first = np.where(seek & hit, i, first)
        good = np.where(hit, i, good)
        bad = np.where(seek & hit, windows, np.where(~seek & ~hit, i, bad))
        resume = np.where(seek & hit, windows, np.where(~seek & ~hit, after, resume))
        done = (first >= 0) & (bad - good <= 1)
        if done.any():
            out.append((q[done], first[done], good[done] + length))
        # Next window: beyond the failure; the last one first, then halves between match and failure.
        nxt = np.where(first < 0, after, np.where(seek, last, (good + bad) // 2))
        nxt = np.where(done, resume, nxt)
        first = np.where(done, -1, first)
        go = nxt < windows
        q, i, first, good, bad, resume, at, windows, own = (x[go] for x in (q, nxt, first, good, bad, resume, at, windows, own))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search(table: pa.Table) -> pa.Table:
    """A shard: its distinct segments, indexed and searched."""
    words = table["words"].to_pylist()
    size = np.array([len(w) // 4 for w in words])
    flat = np.frombuffer(b"".join(words), dtype=np.uint32)
    symbol, coded = np.unique(flat, return_inverse=True)
    # One separator, symbol 0, ends every segment.
    starts = np.cumsum(size + 1) - size - 1
    text = np.zeros(len(flat) + len(size), dtype=np.int64)
    where = np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)
    text[where] = coded + 1
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    # A segment that several documents have is another document's for everyone.
    names, own = np.unique(np.where(a == b, a, 0), return_inverse=True)
    own = np.where(a == b, own, len(names))
    shared = np.flatnonzero(a != b)
    alone = np.flatnonzero(a == b)
    q, s, e = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(alone):
        index = FmIndex(text, np.repeat(own, size + 1), len(symbol) + 1, LENGTH + 1)
        q, s, e = repeated(index, text, starts[alone], size[alone] - LENGTH + 1, own[alone])
    which = np.r_[shared, alone[q]]
    return pa.table({"m": table["m"].take(pa.array(which)), "h": table["h"].take(pa.array(which)), "s": pa.array(np.r_[np.zeros(len(shared), np.int64), s].astype(np.int32)), "e": pa.array(np.r_[size[shared], e].astype(np.int32))})


def merged(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching spans of each document."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order)
    return spans.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """All stretches of all documents that occur in other documents (see above)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    runs = scratch.put(texts.mapInArrow(_runs, "doc_id bigint, text_hash bigint, m bigint, lo int, hi int"), "runs")
    several = runs.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("m")
    left = runs.join(several, "m", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("m", "lo", "hi")).alias("runs"))
    segments = scratch.put(texts.join(left, ["doc_id", "text_hash"]).select("doc_id", "text", "runs").mapInArrow(_segments, "m bigint, h bigint, doc_id bigint, lo int, words binary"), "segments")
    scratch.drop("runs")
    distinct = segments.groupBy("m", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("words").alias("words"))
    total = segments.agg(F.sum(F.octet_length("words")).alias("n")).first().n or 0
    shards = max(1, math.ceil(total / 4 / SHARD_WORDS))
    found = distinct.groupBy(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")).applyInArrow(_search, "m bigint, h bigint, s int, e int")
    spans = segments.select("m", "h", "doc_id", "lo").join(found, ["m", "h"]).select("doc_id", (F.col("lo") + F.col("s")).alias("start"), (F.col("lo") + F.col("e")).alias("end"))
    return merged(spans.distinct())
