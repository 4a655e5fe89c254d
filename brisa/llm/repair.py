"""Operator 8, token-id output: Re-Pair grammar compression.

Method: Re-Pair. Documents are tokenized and gathered into shards; in each shard the most frequent
pairs of adjacent ids are replaced by new nonterminals, again and again, until no pair is frequent
enough to pay for its rule; there is no limit to their number. Of the grammars on the way, the one
with the smallest size is kept, as one more rule may make all symbols a bit wider. Where symbols became
wider, the search ends once the counts of pairs prove that no further rules lead to a smaller one
(``no_better``); this changes no result. Pairs never cross documents. A round takes all pairs at least half as frequent as the most frequent one at once, where
they overlap the more frequent one; tests hold the size that comes of it to within 5 % of strict
one-by-one replacement.

Rules are stored with the length of their expansion, and every ``BLOCK`` symbols of a document with
the number of ids before them, so a range of a document's ids is decoded without expanding, or even
looking at, what lies before its block.

Rows: one of kind ``doc`` for each document (``symbols``: ``width`` bits each, first bit first, padded to
bytes; ``offsets``: little-endian 4-byte counts) and one of kind ``grammar`` for each shard (``rules``:
pairs of symbols in the same form; ``lengths``: little-endian 4-byte counts).

Defined results
- Null text: a ``doc`` row with null ``symbols`` and 0 ids. Empty text: empty ``symbols``.
- Null ``doc_id``: kept. Repeated rows are separate documents, told apart by ``pos`` in the shard.
- A text longer than a shard's size is a shard by itself. An empty table gives no rows. Ties between
  pairs go to the smaller ids. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm import bpe
from brisa.llm.text import chunked
from brisa.session import ensure_importable

#: Characters in a shard: its grammar is learned on, and stored with, this much text.
SHARD_CHARS = 4_000_000
#: A pair seen less often in a shard is left alone: a rule takes two symbols and the bits of its length,
#: and at 16 bits a symbol five replacements are the fewest that save more.
MIN_COUNT = 5
LENGTH_BITS = 32
#: Symbols between two stored offsets of a document.
BLOCK = 256
#: When a round shortens the shard by less than this share, the next ones take rarer pairs, at last counting
#: them one by one, which goes on until there is none (or ``no_better``).
LEAST_GAIN = 0.01
SCHEMA = "shard_id bigint, kind string, pos int, doc_id bigint, n_tokens bigint, width int, symbols binary, offsets binary, first_id int, rules binary, lengths binary"
_BITS = 20
#: A round replaces the pairs that are at least this fraction as frequent as its most frequent one.
_STEP = 2


def symbol_bits(first: int, n_rules: int) -> int:
    """Bits of a symbol, with ``n_rules`` nonterminals from ``first`` on."""
    return max(1, int(first + n_rules - 1).bit_length())


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below ``1 << _BITS`` for each pair of symbols."""
    return (((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - _BITS)).astype(np.int64)


def _last(starts: np.ndarray, n: int) -> np.ndarray:
    """The last symbols of documents, among ``n`` symbols."""
    last = np.r_[starts, n] - 1
    return last[(last >= 0) & (last < n)]


def no_better(best: int, n: int, first: int, n_rules: int, count: np.ndarray) -> bool:
    """Whether no further rules can lead from ``n`` symbols and ``n_rules`` rules to a size below ``best``.

    ``count``: how often each pair stands in the symbols, or those pairs that may get a rule. A replacement removes
    the border between two of these symbols for good, and, however rules are nested, all replacements by one rule
    remove borders of one pair. So a pair gives at most its count of replacements for at least one rule, and symbols
    only become wider.
    """
    width = symbol_bits(first, n_rules + 1)
    rule = 2 * width + LENGTH_BITS
    gain = count * width - rule
    return n * width + n_rules * rule - int(gain[gain > 0].sum()) >= best


def compress(ids: np.ndarray, starts: np.ndarray, first: int, limit: int, min_count: int = MIN_COUNT):
    """Symbols, each document's start among them, and rules (two ids a row).

    ``starts``: where documents begin; ``limit``: nonterminals are below it.
    """
    seq = ids.astype(np.uint32)
    starts = np.asarray(starts, dtype=np.int64)
    rules: list[np.ndarray] = []
    nxt, buckets = first, 1 << _BITS
    # The bucket of each pair and the pairs in each bucket are kept from round to round: few of them change.
    h = _bucket(seq, np.r_[seq[1:], seq[:1]])
    h[_last(starts, len(seq))] = buckets  # a document's last symbol begins none
    count = np.bincount(h, minlength=buckets + 1).astype(np.int32)
    slot, heavy = np.zeros(buckets + 1, dtype=np.int64), np.zeros(buckets + 1, dtype=bool)
    here, one = np.zeros(len(h), dtype=bool), np.ones(len(h), dtype=np.int32)
    # Rarer pairs may change once the frequent ones are gone, so they wait.
    least, exact = max(min_count, int(count[:buckets].max()) // _STEP), False
    cost = lambda n, k: n * symbol_bits(first, k) + k * (2 * symbol_bits(first, k) + LENGTH_BITS)
    best = (cost(len(seq), 0), seq, starts, 0)
    while nxt < limit and len(seq) > 1:
        if symbol_bits(first, nxt - first + 1) > symbol_bits(first, best[3]):
            at = np.flatnonzero((count >= min_count)[h] & (h < buckets))
            key = np.sort((seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1])
            n = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True][-len(key) - 1 :]))
            if no_better(best[0], len(seq), first, nxt - first, n[n >= min_count]):
                break
        np.greater_equal(count, least, out=heavy)
        heavy[buckets] = False
        used = np.flatnonzero(heavy)
        at = np.flatnonzero(heavy.take(h, out=here[: len(h)], mode="wrap")) if len(used) else used
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        if exact:
            pairs, kind, n = np.unique(key, return_inverse=True, return_counts=True)
        else:
            # A bucket stands for one of its pairs; others that fall into it have their turn later.
            slot[used] = np.arange(len(used))
            kind, pairs = slot[h[at]], np.zeros(len(used), dtype=np.uint64)
            pairs[kind] = key
            kind[key != pairs[kind]] = len(used)
            n = np.bincount(kind, minlength=len(used))[: len(used)]
        good = np.flatnonzero(n >= least)
        good = good[np.lexsort((pairs[good], -n[good]))]
        rank = np.full(len(n) + 1, -1, dtype=np.int64)
        rank[good] = np.arange(len(good))
        rank = rank[kind]
        ranked = np.flatnonzero(rank >= 0)
        at, rank = at[ranked], rank[ranked]
        # Of pairs that overlap, the more frequent one is taken; of equal ones, every second from the left.
        touch = np.diff(at) == 1
        turn, again = 2 * rank, touch & (rank[1:] == rank[:-1])
        if again.any():
            begin = np.flatnonzero(np.r_[True, ~again])
            turn += (np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) % 2
        taken = np.ones(len(at), dtype=bool)
        fall = turn[1:] < turn[:-1]
        taken[1:] &= ~touch | fall
        taken[:-1] &= ~(touch & fall)
        # Pairs of which too little is left this way wait. A round ends where symbols become a bit wider,
        # so that the grammar just before that is among the choices.
        enough = np.flatnonzero(np.bincount(rank[taken], minlength=len(good)) >= least)
        room = min(limit, 1 << int(nxt).bit_length()) - nxt
        cut, enough = len(enough) > room, enough[:room]
        new = np.zeros(len(good), dtype=np.uint32)
        new[enough] = np.arange(nxt, nxt + len(enough), dtype=np.uint32)
        to = new[rank]
        taken = np.flatnonzero(taken & (to > 0))
        at, to, good = at[taken], to[taken], good[enough]
        if len(at):
            # Pairs at, before and after a replaced one are gone; those at and before its symbol are new.
            apart = np.flatnonzero(np.r_[at[0] > 0, np.diff(at) > 2])
            for gone in (at[apart] - 1, at, at + 1):
                np.subtract.at(count, h[gone], one[: len(gone)])
            keep = np.ones(len(seq), dtype=bool)
            keep[at + 1] = False
            keep = np.flatnonzero(keep)
            starts = starts - np.searchsorted(at + 1, starts, side="left")
            seq, h, at = seq.take(keep, mode="wrap"), h.take(keep, mode="wrap"), at - np.arange(len(at))
            seq[at] = to
            made = np.concatenate([at[apart] - 1, at])
            h[made] = _bucket(seq[made], seq.take(made + 1, mode="clip"))
            h[_last(starts, len(seq))] = buckets
            np.add.at(count, h[made], one[: len(made)])
        pairs = pairs[good]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        nxt += len(good)
        best = min(best, (cost(len(seq), nxt - first), seq, starts, nxt - first), key=lambda b: b[0])
        if len(at) <= LEAST_GAIN * len(seq) and not cut:  # little came of it: go on to rarer pairs, then one by one
            if exact and not len(good):
                break
            least, exact = max(min_count, least // _STEP), exact or least == min_count
    _, seq, starts, n = best
    return seq, starts, np.concatenate([np.zeros((0, 2), dtype=np.uint32), *rules])[:n]


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for. A rule only refers to earlier rounds' rules."""
    size = np.zeros(len(rules), dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[k] = (size[a - first] if a >= first else 1) + (size[b - first] if b >= first else 1)
    return size


def decode_range(symbols: np.ndarray, first: int, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of a document, expanding only the rules that overlap them."""
    size = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= first
    size[big] = lengths[symbols[big] - first]
    ends = np.cumsum(size)
    out: list[int] = []
    k = int(np.searchsorted(ends, start, side="right"))
    at = int(ends[k - 1]) if k else 0
    while k < len(symbols) and at < stop:
        stack, here = [int(symbols[k])], at
        while stack:
            s = stack.pop()
            n = int(lengths[s - first]) if s >= first else 1
            if here + n <= start or here >= stop:
                here += n
            elif s < first:
                out.append(s)
                here += 1
            else:
                stack += [int(rules[s - first, 1]), int(rules[s - first, 0])]
        at = int(ends[k])
        k += 1
    return out


def pack(symbols: np.ndarray, starts: np.ndarray, width: int) -> list[bytes]:
    """Each document's symbols, ``width`` bits each."""
    big = symbols.astype(">u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(big, axis=1)[:, 32 - width :]
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(symbols)])]


def unpack(data: bytes, width: int, start: int, stop: int | None = None) -> np.ndarray:
    """Symbols ``start`` to ``stop`` of a document, reading no others."""
    stop = len(data) * 8 // width if stop is None else min(stop, len(data) * 8 // width)
    a, z = start * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[a:z])[start * width - 8 * a :][: (stop - start) * width].reshape(-1, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def block_offsets(symbols: np.ndarray, starts: np.ndarray, first: int, lengths: np.ndarray) -> list[bytes]:
    """For each document, how many ids come before each of its blocks."""
    size = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= first
    size[big] = lengths[symbols[big].astype(np.int64) - first]
    before = np.r_[0, np.cumsum(size)]
    return [(before[a : max(b, a + 1) : BLOCK] - before[a]).astype("<u4").tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(symbols)])]


def decode(row: dict, grammar: dict, start: int = 0, stop: int | None = None) -> list[int]:
    """Ids of a ``doc`` row, with its shard's ``grammar`` row; only blocks that hold some of them are read."""
    stop = row["n_tokens"] if stop is None else min(stop, row["n_tokens"])
    if start >= stop:
        return []
    offsets = np.frombuffer(row["offsets"], dtype="<u4")
    a, z = int(np.searchsorted(offsets, start, side="right")) - 1, int(np.searchsorted(offsets, stop, side="left"))
    # A document's bits are padded to bytes, which may look like one more symbol; ``stop`` ends before it.
    symbols = unpack(row["symbols"], row["width"], a * BLOCK, z * BLOCK)
    lengths = np.frombuffer(grammar["lengths"], dtype="<u4").astype(np.int64)
    rules = unpack(grammar["rules"], row["width"], 0, 2 * len(lengths)).reshape(-1, 2)
    base = int(offsets[a])
    return decode_range(symbols, grammar["first_id"], rules, lengths, start - base, stop - base)


def _run(vocab: str, shard_chars: int, min_count: int):
    def run(batches):
        from pyspark import TaskContext

        tok, pid, shard = bpe.load(vocab), TaskContext.get().partitionId(), 0
        first = tok.eos + 1
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for part in chunked(rows, lambda r: len(r[1] or ""), shard_chars):
            coded = [tok.encode(t or "") for _, t in part]
            size = np.array([len(c) // tok.dtype.itemsize for c in coded], dtype=np.int64)
            ids = np.frombuffer(b"".join(coded), dtype=tok.dtype)
            seq, starts, rules = compress(ids, np.cumsum(size) - size, first, 1 << 32, min_count)
            width, sizes = symbol_bits(first, len(rules)), expansion_lengths(rules, first)
            known = [t is not None for _, t in part]
            symbols = [x if ok else None for x, ok in zip(pack(seq, starts, width), known)]
            offsets = [x if ok else None for x, ok in zip(block_offsets(seq, starts, first, sizes), known)]
            n, sid = len(part), (pid << 32) | shard
            lengths = sizes.astype("<u4").tobytes()
            cols = [
                pa.array([sid] * (n + 1), pa.int64()), pa.array(["doc"] * n + ["grammar"]), pa.array([*range(n), None], pa.int32()), pa.array([*(d for d, _ in part), None], pa.int64()),
                pa.array([*size.tolist(), int(size.sum())], pa.int64()), pa.array([width] * (n + 1), pa.int32()), pa.array([*symbols, None], pa.binary()), pa.array([*offsets, None], pa.binary()),
                pa.array([None] * n + [first], pa.int32()), pa.array([None] * n + pack(rules.ravel(), np.zeros(1, np.int64), width), pa.binary()), pa.array([None] * n + [lengths], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])
            shard += 1

    return run


def repair_tokens(docs: DataFrame, vocab: str = bpe.DEFAULT_VOCAB, shard_chars: int = SHARD_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """Grammar-compressed token ids of every document (see above). No shuffle: shards are local."""
    ensure_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_run(vocab, shard_chars, min_count), SCHEMA)
