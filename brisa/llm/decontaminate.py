"""Operator 3, benchmark decontamination.

Method: latent semantic retrieval. Passages (blocks of ``STRIDE`` words) are TF-IDF vectors over the
benchmark's vocabulary. A distributed randomised SVD finds their leading right singular vectors:
``Z = A'(A W)`` for a random ``W`` is summed over the partitions, ``Q = qr(Z)``, then the small Gram
matrix of ``A Q`` is summed and its eigenvectors rotate ``Q``. Corpus and benchmark weigh alike, or the
few benchmark passages would vanish in the corpus. Every window of two blocks is then projected and
compared with every benchmark passage by cosine; candidates are held against the longest common
subsequence of words and an answer check, in the same task. Weights and basis are those of the whole
benchmark. Beside the cosine, a passage is a candidate wherever ``LEAST_WORDS`` of its words stand in a
row, so that copies are found however common their words are or become.

A passage counts as leaked if ``lcs_ratio >= STRONG``, or ``>= WEAK`` and the answer (the benchmark
passage's last sentence) is there: ``ANSWER`` of its words in order.

Rows: ``doc_id, item_id, start, cosine, lcs, lcs_ratio, answer_found``: a document's best window for
each item that it leaks.

Defined results
- Null or empty texts leak nothing. Null ``doc_id``: no row (nothing could be named). Repeated rows
  with one ``doc_id`` are one document's windows. Very long texts are read whole.
- Items with fewer than ``LEAST_WORDS`` words or null ``item_id`` are not searched for; longer ones than
  ``STRIDE`` words are searched for in parts, any of which tells, and their answer is looked for in as many
  words around a window as the item has. A repeated ``item_id``: all its texts.
- A passage in any number of documents, up to all of them, is found in each.
- Ties between windows: the leftmost. An empty table on either side: no rows. Extra columns: not read.
- A benchmark of more than ``ROUND`` parts is searched for in several rounds of that many, with the same
  result. What is sent to executors grows with the benchmark (its vocabulary by ``RANK`` numbers), not
  with the corpus.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.rows import by_row, numbered, without_rows
from brisa.llm.text import WORD, chunked, mix, words
from brisa.session import Scratch, ensure_importable

STRIDE = 64
RANK, OVERSAMPLE = 128, 16
COSINE = 0.2
STRONG, WEAK, ANSWER = 0.75, 0.65, 0.8
LEAST_WORDS = 8
#: A shorter sentence than this is no answer: its words could be there by chance.
LEAST_ANSWER = 4
#: Probes compared at once in a task; those that one pass over the corpus searches for.
ITEMS, ROUND = 1000, 32_000
#: Marks of windows' words, and pairs of a window and a probe, that are looked at in one go.
_SEEN, _PAIRS = 2_000_000, 8_000
#: What a term weighs at least, however many passages have it.
LEAST_IDF = 0.1
_TOKENS = 120_000
SCHEMA = "doc_id bigint, item_id bigint, start int, cosine double, lcs int, lcs_ratio double, answer_found boolean"
_END = re.compile(r"[.!?\n]+")


class Probe:
    """A part of a benchmark passage: its words as vocabulary ids, and its answer's.

    ``reach``: in how many blocks around a window the answer is looked for.
    """

    def __init__(self, item: int, ids: list[int], answer: list[int], reach: int = 0):
        self.item, self.ids, self.answer, self.reach = item, ids, answer, reach
        self.masks, self.answer_masks = masks(ids), masks(answer)


def masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, i in enumerate(ids):
        out[i] = out.get(i, 0) | 1 << k
    return out


def lcs(where: dict[int, int], n: int, other) -> int:
    """Length of the longest common subsequence with ``n`` words given as bit masks of places."""
    full = (1 << n) - 1
    s = full
    for w in other:
        m = where.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def probes_of(rows) -> tuple[list[Probe], dict[str, int]]:
    """Probes of (item_id, text) rows, and the vocabulary."""
    vocab: dict[str, int] = {}
    probes = []
    for item, text in rows:
        ws = words(text or "")
        if item is None or len(ws) < LEAST_WORDS:
            continue
        ids = [vocab.setdefault(w, len(vocab)) for w in ws]
        sentences = [s for s in (words(s) for s in _END.split(text)) if s]
        last = [s for s in sentences if len(s) >= LEAST_ANSWER]
        answer = [vocab[w] for w in last[-1]] if len(sentences) > 1 and last else ids
        parts = -(-len(ids) // STRIDE)
        for k in range(parts):
            a, b = k * len(ids) // parts, (k + 1) * len(ids) // parts
            probes.append(Probe(item, ids[a:b], answer, parts if parts > 1 else 0))
    return probes, vocab


def _known(shared):
    """Documents' words that the vocabulary has: places and ids."""

    def run(batches):
        vocab = shared.value
        for b in batches:
            rows = (r for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if r[1])
            for part in chunked(rows, lambda r: len(r[1])):
                out_id, out_n, out_at, out_term = [], [], [], []
                for doc, text in part:
                    ws = WORD.findall(text.lower())
                    term = np.fromiter(map(vocab.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
                    at = np.flatnonzero(term >= 0).astype(np.int32)
                    out_id.append(doc), out_n.append(len(ws)), out_at.append(at.tobytes()), out_term.append(term[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_at, pa.binary()), pa.array(out_term, pa.binary())], names=["doc_id", "n", "at", "term"])

    return run


def _parts(batches, columns=("n", "at", "term")):
    """Lists of documents' rows with about ``_TOKENS`` known words in all."""
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in columns))
        yield from chunked(rows, lambda r: len(r[-1]) // 4, _TOKENS)


def _blocks(part):
    """Flat places, terms and block numbers of documents, and the documents' first blocks."""
    at = np.frombuffer(b"".join(r[-2] for r in part), dtype=np.int32)
    term = np.frombuffer(b"".join(r[-1] for r in part), dtype=np.int32)
    size = np.array([len(r[-1]) // 4 for r in part])
    n_blocks = np.array([-(-r[-3] // STRIDE) for r in part], dtype=np.int64)
    first = np.r_[0, np.cumsum(n_blocks)]
    return at, term, np.repeat(first[:-1], size) + at // STRIDE, size, first


def _frequencies(n_terms: int):
    def run(batches):
        df, blocks = np.zeros(n_terms + 1, dtype=np.int64), 0
        for part in _parts(batches):
            _, term, block, _, first = _blocks(part)
            df[:n_terms] += np.bincount(np.unique(block * n_terms + term) % n_terms, minlength=n_terms)
            df[n_terms] += first[-1]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return run


def sparse_rows(term: np.ndarray, block: np.ndarray, idf: np.ndarray):
    """TF-IDF rows of length one, as (row, term, weight), and the number of rows."""
    keep = idf[term] > 0
    key, tf = np.unique(block[keep] * len(idf) + term[keep], return_counts=True)
    row, term = key // len(idf), key % len(idf)
    if not len(row):
        return row, term, np.zeros(0, np.float32), 0
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    row = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(row)]))
    w = (tf * idf[term]).astype(np.float32)
    w /= np.sqrt(np.add.reduceat(w * w, start))[row]
    return row, term, w, len(start)


#: Longer runs are summed by a matrix product of their own.
_LONG = 48


def run_sums(table: np.ndarray, pick: np.ndarray, weight: np.ndarray | None, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For every run ``[start, stop)``, the sum of ``weight[i] * table[pick[i]]`` over its ``i``.

    Runs go by length: step ``j`` adds the ``j``-th row of all runs that have one, which lie together.
    """
    size = stop - start
    out = np.zeros((len(start), table.shape[1]), dtype=np.float32)
    for k in np.flatnonzero(size > _LONG):
        at = slice(start[k], stop[k])
        rows = table[pick[at]]
        out[k] = rows.sum(0) if weight is None else weight[at] @ rows
    short = np.flatnonzero((size > 0) & (size <= _LONG))
    short = short[np.argsort(-size[short], kind="stable")]
    begin, length = start[short], size[short]
    sums = np.zeros((len(short), table.shape[1]), dtype=np.float32)
    for j in range(int(length[0]) if len(short) else 0):
        at = begin[: np.searchsorted(-length, -j, side="left")] + j
        rows = table[pick[at]]
        if weight is not None:
            rows *= weight[at, None]
        sums[: len(at)] += rows
    out[short] = sums
    return out


def project(row, term, w, n, basis) -> np.ndarray:
    """Sparse rows (sorted by row) times a dense basis."""
    ends = np.searchsorted(row, np.arange(n + 1))
    return run_sums(basis, term, w, ends[:-1], ends[1:])


def accumulate(z: np.ndarray, row, term, w, n, basis) -> None:
    """``z += A'(A basis)`` for sparse rows ``A``."""
    if not n:
        return
    y = project(row, term, w, n, basis)
    order = np.argsort(term, kind="stable")
    t = term[order]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    z[t[start]] += run_sums(y, row[order], w[order], start, np.r_[start[1:], len(t)])


def _range(shared):
    """This partition's part of ``A'(A W)``, a row of bytes for every 256 terms that occur."""

    def run(batches):
        idf, basis = shared.value
        z, rows = np.zeros(basis.shape, dtype=np.float32), 0
        for part in _parts(batches):
            _, term, block, *_ = _blocks(part)
            s = sparse_rows(term, block, idf)
            accumulate(z, *s, basis)
            rows += s[3]
        some = [a for a in range(0, len(z), 256) if z[a : a + 256].any()]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([np.float64(rows).tobytes(), *(z[a : a + 256].astype(np.float64).tobytes() for a in some)], pa.binary())], names=["part", "data"])

    return run


def _gram(shared):
    def run(batches):
        idf, basis = shared.value
        g = np.zeros((basis.shape[1],) * 2)
        for part in _parts(batches):
            _, term, block, *_ = _blocks(part)
            y = project(*sparse_rows(term, block, idf), basis)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["part", "data"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.float64) for x in table["data"].to_pylist())
    return pa.table({"part": table["part"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def summed(df: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the partitions' arrays; as many numbers as one partition's reach the driver."""
    rows = df.groupBy("part").applyInArrow(_sum, "part int, data binary").collect()
    return {r.part: np.frombuffer(r.data, dtype=np.float64) for r in rows}


def bench_rows(probes: list[Probe]):
    """Terms and rows of the probes, a row for each."""
    term = np.array([i for p in probes for i in p.ids], dtype=np.int64)
    block = np.repeat(np.arange(len(probes)), [len(p.ids) for p in probes])
    return term, block


def latent_basis(known: DataFrame, probes: list[Probe], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (terms by ``rank``) of corpus and benchmark passages."""
    sc = known.sparkSession.sparkContext
    n_terms = len(idf)
    wide = min(n_terms, rank + OVERSAMPLE)
    w = np.random.default_rng(7).standard_normal((n_terms, wide)).astype(np.float32)
    bench = sparse_rows(*bench_rows(probes), idf)
    z_bench = np.zeros((n_terms, wide), dtype=np.float32)
    accumulate(z_bench, *bench, w)
    parts = summed(known.select("n", "at", "term").mapInArrow(_range(sc.broadcast((idf, w))), "part int, data binary"))
    rows = max(1.0, float(parts.pop(-1, np.zeros(1))[0]))
    z = z_bench.astype(np.float64) / max(1, bench[3])
    for a, x in parts.items():
        z[a : a + 256] += x.reshape(-1, wide) / rows
    q = np.linalg.qr(z)[0].astype(np.float32)
    gram = summed(known.select("n", "at", "term").mapInArrow(_gram(sc.broadcast((idf, q))), "part int, data binary"))
    y = project(*bench, q)
    total = gram.get(0, np.zeros(wide * wide)).reshape(wide, wide) / rows + (y.T @ y) / max(1, bench[3])
    value, vector = np.linalg.eigh(total)
    lead = np.argsort(-value)[:rank]
    return (q @ vector[:, lead[value[lead] > 1e-12]]).astype(np.float32)


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash for each ``LEAST_WORDS`` ids in a row."""
    n = max(0, len(ids) - LEAST_WORDS + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(LEAST_WORDS):
        h = h * np.uint64(0x100000001B3) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return mix(h)


class Index:
    """What a task needs of the probes it searches for: ids, latent vectors, hashes of their runs."""

    def __init__(self, probes: list[Probe], vectors: np.ndarray):
        self.probes, self.vectors = probes, vectors
        self.size = np.array([len(p.ids) for p in probes], dtype=np.int64)
        self.ids = np.array([i for p in probes for i in p.ids], dtype=np.int32)
        self.offset = np.cumsum(self.size) - self.size
        runs = [np.unique(run_hashes(np.array(p.ids))) for p in probes]
        hashes, owner = np.concatenate(runs), np.repeat(np.arange(len(probes)), [len(r) for r in runs])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def sharing(self, at: np.ndarray, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the terms, probe) wherever a probe's run of words stands in a document."""
        h = run_hashes(term)
        n, k = len(h), LEAST_WORDS - 1
        ok = np.flatnonzero((at[k : k + n] - at[:n] == k) & (doc[k : k + n] == doc[:n]))
        lo, hi = (np.searchsorted(self.hashes, h[ok], side=x) for x in ("left", "right"))
        some = np.flatnonzero(hi > lo)
        count = (hi - lo)[some]
        place = np.repeat(ok[some], count)
        return place, self.owner[np.repeat(lo[some] - np.cumsum(count) + count, count) + np.arange(len(place))]

    def held(self, window: np.ndarray, probe: np.ndarray, term: np.ndarray, start: np.ndarray, stop: np.ndarray, n_terms: int) -> np.ndarray:
        """For pairs of a window (rising) and a probe, how many of the probe's words are in the window ``term[start:stop]``."""
        out = np.zeros(len(window), dtype=np.int32)
        step = max(1, _SEEN // n_terms)
        for a in range(0, len(start), step):
            n = (stop - start)[a : a + step]
            row = np.repeat(np.arange(len(n)), n)
            seen = np.zeros(len(n) * n_terms, dtype=bool)
            seen[row * n_terms + term[np.repeat(start[a : a + step] - np.cumsum(n) + n, n) + np.arange(len(row))]] = True
            first, last = np.searchsorted(window, [a, a + step])
            for k in range(first, last, _PAIRS):
                w, p = window[k : min(last, k + _PAIRS)] - a, probe[k : min(last, k + _PAIRS)]
                size = self.size[p]
                begin = np.cumsum(size) - size
                ids = self.ids[np.repeat(self.offset[p] - begin, size) + np.arange(size.sum())]
                out[k : k + len(p)] = np.add.reduceat(seen[np.repeat(w * n_terms, size) + ids], begin, dtype=np.int32)
        return out


def _windows(have: np.ndarray, sums: np.ndarray, first: np.ndarray):
    """Vectors, first blocks and documents of all windows that hold a known word.

    A window is a block and the next one of the same document, if there is one.
    """
    owner = np.searchsorted(first, have, side="right") - 1
    follows = np.r_[(have[1:] == have[:-1] + 1) & (owner[1:] == owner[:-1]), False]
    win = sums.copy()
    win[follows] += sums[1:][follows[:-1]]
    # A block whose predecessor has no known word still begins the window before it.
    lone = np.flatnonzero(~np.r_[False, follows[:-1]] & (have > first[owner]))
    return np.vstack([win, sums[lone]]), np.r_[have, have[lone] - 1], np.r_[owner, owner[lone]]


def _candidates(index: Index, win: np.ndarray, at_block: np.ndarray, shared: tuple[np.ndarray, np.ndarray], n_blocks: int):
    """(window, probe, cosine) of the pairs to look at, by window."""
    norm = np.maximum(np.linalg.norm(win, axis=1), 1e-12)
    unit, n = win / norm[:, None], len(index.probes)
    keys = []
    for a in range(0, n, ITEMS):
        k, p = np.nonzero(unit @ index.vectors[a : a + ITEMS].T >= COSINE)
        keys.append(k * n + p + a)
    # Probes with a run of words that stands there, whatever the words weigh.
    window = np.full(n_blocks + 1, -1, dtype=np.int64)
    window[at_block] = np.arange(len(at_block))
    block, probe = shared
    for k in (window[block], window[block - 1]):
        keys.append(k[k >= 0] * n + probe[k >= 0])
    key = np.concatenate(keys)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    k, p = key // max(1, n), key % max(1, n)
    return k, p, np.einsum("ij,ij->i", unit[k], index.vectors[p])


def _search(shared):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.bool_()]

    def run(batches):
        scaled, index = shared.value
        for part in _parts(batches, ("doc_id", "n", "at", "term")):
            at, term, block, size, first = _blocks(part)
            if not len(term):
                continue
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sums = run_sums(scaled, term, None, start, np.r_[start[1:], len(term)])
            win, at_block, own = _windows(block[start], sums, first)
            place, probe = index.sharing(at, term, np.repeat(np.arange(len(part)), size))
            wk, wp, cos = _candidates(index, win, at_block, (block[place], probe), int(first[-1]))
            ends, out = np.cumsum(size), []
            if not len(wk):
                continue
            runs = np.r_[True, wk[1:] != wk[:-1]]
            window = wk[runs]
            doc = own[window]
            start, stop = np.searchsorted(block, [at_block[window], at_block[window] + 2])
            start, stop = np.maximum(start, (ends - size)[doc]), np.minimum(stop, ends[doc])
            # No common subsequence is longer than the number of words that occur at all.
            held = index.held(np.cumsum(runs) - 1, wp, term, start, stop, len(scaled))
            few = np.flatnonzero(held >= WEAK * index.size[wp])
            wk, wp, cos = wk[few], wp[few], cos[few]
            runs = np.flatnonzero(np.r_[True, wk[1:] != wk[:-1]][: len(wk)])
            for i, j in zip(runs, [*runs[1:], len(wk)]):
                doc, w0 = own[wk[i]], at_block[wk[i]]
                lo, hi = ends[doc] - size[doc], ends[doc]

                def words_at(a: int, z: int) -> np.ndarray:
                    a, z = np.searchsorted(block[lo:hi], [a, z])  # noqa: B023
                    return term[lo + a : lo + z]  # noqa: B023

                seen = words_at(w0, w0 + 2)
                for p, c in zip(wp[i:j].tolist(), cos[i:j].tolist()):
                    x = index.probes[p]
                    n = lcs(x.masks, len(x.ids), seen.tolist())
                    ratio = n / len(x.ids)
                    if ratio < WEAK:
                        continue
                    near = seen if not x.reach else words_at(w0 - x.reach, w0 + 2 + x.reach)
                    found = lcs(x.answer_masks, len(x.answer), near.tolist()) >= ANSWER * len(x.answer)
                    if ratio >= STRONG or found:
                        out.append((part[doc][0], x.item, int(w0 - first[doc]) * STRIDE, round(c, 5), n, ratio, found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def weights(known: DataFrame, n_terms: int) -> np.ndarray:
    """Every term's inverse document frequency over the corpus' passages; never zero."""
    df = np.zeros(n_terms + 1)
    counts = known.select("n", "at", "term").mapInArrow(_frequencies(n_terms), "term int, df bigint")
    for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return np.maximum(np.log((1 + df[-1]) / (1 + df[:-1])), LEAST_IDF).astype(np.float32)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which documents hold which benchmark items (see above)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    sc, scratch = spark.sparkContext, Scratch(spark)
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    probes, vocab = probes_of((r.item_id, r.text) for r in items.toLocalIterator())
    if not probes:
        return spark.createDataFrame([], SCHEMA)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    known = scratch.put(texts.mapInArrow(_known(sc.broadcast(vocab)), "doc_id bigint, n int, at binary, term binary"), "known")
    # One weighting and one basis for the whole benchmark, so how it is cut into rounds changes nothing.
    idf = weights(known, len(vocab))
    basis = latent_basis(known, probes, idf)
    scaled = basis * idf[:, None]
    found = None
    for a in range(0, len(probes), ROUND):
        some = probes[a : a + ROUND]
        term, block = bench_rows(some)
        vectors = project(block, term, idf[term], len(some), basis)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
        more = scratch.put(known.mapInArrow(_search(sc.broadcast((scaled, Index(some, vectors)))), SCHEMA), f"leaks{a}")
        found = more if found is None else found.unionByName(more)
    scratch.drop("known")
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs_ratio"), "start", F.desc("cosine")))
    return found.withColumn("place", best).where("place = 1").drop("place")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; each row is judged by itself."""
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs, scratch)
    return without_rows(rows, scratch.put(find_leaks(by_row(rows), benchmark).select("doc_id").distinct(), "leaking"))
