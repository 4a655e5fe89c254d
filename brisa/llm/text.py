"""Vectorised text primitives that run inside Python workers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Characters handled at once: bounds a worker's memory whatever the Arrow batch holds.
CHUNK_CHARS = 3_000_000
_CACHE_WORDS = 300_000


class WordHash(dict):
    """Word to 63-bit hash; emptied when it outgrows its bound, so it changes speed and never results."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.clear()


def chunked(rows: Iterable[tuple], size_of, budget: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows in lists of about ``budget`` characters; one longer row is a list by itself."""
    out, used = [], 0
    for row in rows:
        n = size_of(row)
        if out and used + n > budget:
            yield out
            out, used = [], 0
        out.append(row)
        used += n
    if out:
        yield out


def words(text: str) -> list[str]:
    """Runs of word characters in lower case: the tokens of every word-level operator here."""
    return WORD.findall(text.lower())


def word_ids(texts: list[str], table: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts, one after another, and where each text starts (one more than texts)."""
    get, find = table.__getitem__, WORD.findall
    flat: list[int] = []
    ends = [0]
    for text in texts:
        flat.extend(map(get, find(text.lower())))
        ends.append(len(flat))
    table.trim()
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every character, whether ``WORD`` matches it, and a number that stands for it."""
    kind = np.fromiter((c == 0x5F or chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return kind, mix(np.arange(1, 0x110001, dtype=np.uint64))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_ids``, with 64-bit hashes of another kind: of all words at once, so new ones cost no more."""
    kind, value = _characters()
    lower = [t.lower() + "\n" for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = kind[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.r_[0, edge] if len(code) and inside[0] else edge  # the last character is no word's
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, dtype=np.uint64))
    hashes = mix(np.add.reduceat(value[code[at]] * power[place], first)) if len(size) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(start, np.cumsum([0, *map(len, lower)]))


def first_of_overlapping(found: Iterable[tuple], key) -> list[tuple]:
    """Spans ``(start, end, ...)`` by place: of those that overlap, the first by ``key`` stays."""
    starts: list[int] = []
    out: list[tuple] = []
    for hit in sorted(found, key=key):
        # What is kept doesn't overlap, so only the neighbours can.
        k = bisect_right(starts, hit[0])
        if (not k or out[k - 1][1] <= hit[0]) and (k == len(out) or hit[1] <= starts[k]):
            starts.insert(k, hit[0]), out.insert(k, hit)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
