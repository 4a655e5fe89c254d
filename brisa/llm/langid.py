"""Operator 10, language identification.

Method: language-bitmask n-gram filters. Every language's frequent character n-grams go into one
bit-sliced Bloom filter: a row holds a bit for each language, an n-gram sets its language's bit in
``HASHES`` rows, and the AND of those rows gives all languages that contain an n-gram. A document's
n-grams are looked up; each language's count of set bits is corrected for the filter's false
positives, ``(count - n * fp) / (1 - fp)``, and the largest decides.

Fitting reads labelled rows: about ``TRAIN_DOCS`` a language, chosen by a hash of ``doc_id``. An
n-gram counts as a language's own if it makes up ``LEAST_SHARE`` of the language's n-grams, which
bounds the filter at ``1 / LEAST_SHARE`` entries a language however large the corpus is.

Rows: ``doc_id, predicted, n_ngrams, score, runner_up, runner_up_score``; a row for each document.

Defined results
- Null, empty and letterless texts: ``predicted`` is ``und``, ``n_ngrams`` 0, scores 0.
- Ties: the language first in alphabetical order. Null ``doc_id``: kept. Repeated rows: a row each.
- Rows with a null label aren't fitted on. No labelled row at all: every text is ``und``.
- Any number of languages: beyond 64, rows of the filter are longer. Every label is a language.
- Very long texts are read whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.text import chunked, mix
from brisa.session import ensure_importable

TRAIN_DOCS = 2000
LEAST_SHARE = 1e-5
N = 4
HASHES = 3
#: Rows of the filter for each n-gram of the language that has most.
ROWS_PER_GRAM = 10
#: Languages in a word of a filter's row.
_WORD = 64
SCHEMA = "doc_id bigint, predicted string, n_ngrams bigint, score double, runner_up string, runner_up_score double"
_OTHER = re.compile(r"[\W\d_]+")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words with their edges, and each text's number of them."""
    clean = [_OTHER.sub(" ", f" {t.lower()} ") if t else "" for t in texts]
    size = np.array([len(c) for c in clean], dtype=np.int64)
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(code) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    wide = code.astype(np.uint64)
    h = np.zeros(len(code) - N + 1, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + wide[k : len(code) - N + 1 + k]
    doc = np.repeat(np.arange(len(texts)), size)
    ok = doc[: len(h)] == doc[N - 1 :]
    return mix(h[ok]), np.bincount(doc[: len(h)][ok], minlength=len(texts))


def _count(batches):
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for part in chunked(((t,) for t in texts), lambda r: len(r[0])):
                g, n = np.unique(grams([t for (t,) in part])[0], return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Filter:
    """The bit-sliced filter: ``rows[i]`` has bit ``l`` set if language ``l`` has an n-gram there.

    A row is one word for up to 64 languages, an array of words for more.
    """

    def __init__(self, languages: list[str], members: list[np.ndarray], hashes: int = HASHES):
        self.languages, self.hashes = languages, hashes
        most = max([len(m) for m in members], default=1)
        self.bits = max(10, int(np.ceil(np.log2(max(1, most) * ROWS_PER_GRAM))))
        n_words = -(-len(languages) // _WORD)
        self.rows = np.zeros((1 << self.bits, n_words) if n_words > 1 else 1 << self.bits, dtype=np.uint32 if len(languages) <= 32 else np.uint64)
        for l, m in enumerate(members):
            column, bit = self._slice(self.rows, l)
            for at in self._at(m):
                column[at] |= bit
        self.false_positive = np.array([np.count_nonzero(self._has(self.rows, l)) for l in range(len(languages))]) / len(self.rows)
        self.false_positive **= hashes

    def _slice(self, rows: np.ndarray, l: int):
        """The words that hold language ``l``, and its bit in them."""
        return (rows if rows.ndim == 1 else rows[:, l // _WORD]), self.rows.dtype.type(1 << l % _WORD)

    def _has(self, rows: np.ndarray, l: int) -> np.ndarray:
        column, bit = self._slice(rows, l)
        return (column & bit) != 0

    def _at(self, g: np.ndarray):
        step = g >> np.uint64(32) | np.uint64(1)
        for k in range(self.hashes):
            yield ((g + np.uint64(k) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def languages_of(self, g: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that contain it (or seem to)."""
        out = None
        for at in self._at(g):
            out = self.rows[at] if out is None else out & self.rows[at]
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language's n-grams in each text, and the texts' n-gram counts."""
        g, n = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(g):
            mask, doc = self.languages_of(g), np.repeat(np.arange(len(texts)), n)
            for l, fp in enumerate(self.false_positive):
                hits = np.bincount(doc, weights=self._has(mask, l), minlength=len(texts))
                out[:, l] = np.clip((hits - n * fp) / (1 - fp if fp < 1 else 1) / np.maximum(n, 1), 0, None)
        return out, n


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, least_share: float = LEAST_SHARE) -> Filter:
    """The filter from rows with ``lang``. Only frequent n-grams reach the driver."""
    ensure_importable(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return Filter([], [])
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / v)))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = counts.withColumn("all", F.expr("sum(n) over (partition by lang)")).where(F.col("n") >= F.greatest(F.lit(2), F.col("all") * least_share))
    table = own.select("lang", "gram").toArrow()
    lang, gram = np.array(table["lang"].to_pylist(), dtype=object), table["gram"].to_numpy().view(np.uint64)
    names = sorted(n)
    return Filter(names, [gram[lang == x] for x in names])


def _apply(shared):
    def run(batches):
        model: Filter = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for part in chunked(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), lambda r: len(r[1] or "")):
                s, n = model.scores([t for _, t in part])
                # Missing places count as "und" with score 0, so that one language or none will do.
                s = np.hstack([s, np.zeros((len(part), 2))])
                order = np.argsort(-s, axis=1, kind="stable")[:, :2]
                best = np.take_along_axis(s, order, 1)
                order = np.where(best > 0, np.minimum(order, len(names) - 1), len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array(names[order[:, 0]], pa.string()), pa.array(n.astype(np.int64)), pa.array(best[:, 0]), pa.array(names[order[:, 1]], pa.string()), pa.array(best[:, 1])], names=columns)

    return run


def identify(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """The language of every document.

    Applying the filter is one pass without a shuffle. Fitting it reads labels and the chosen rows' texts and
    shuffles their n-gram counts. The filter grows with the number of languages, not with the corpus.
    """
    model = model or fit(docs)
    ensure_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)
