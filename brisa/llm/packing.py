"""Operator 9, packing: concatenate all documents' token ids and cut fixed windows.

Method: concatenate and cut. Pass 1 tokenizes every partition once and writes its chunks with
their offset inside the partition. The partitions' token totals (one number each) are summed to
global offsets. Pass 2 cuts windows at multiples of ``window``; a window that spans chunks is put
together from the chunks' first and last ids, which are columns of their own, so that only those
are read and shuffled.

Defined results
- Order: the table's storage order (partition, then position), documents followed by ``eos`` each.
- Null text: the document is left out. Empty text: just its ``eos``. Null ``doc_id``: kept, as null.
- Repeated rows and ties are separate documents. Very long texts span as many windows as they need.
- The last window may be short. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.llm import bpe
from brisa.llm.text import chunked
from brisa.session import Scratch, ensure_importable

WINDOW = 2048
#: Offsets of up to this many partitions (12 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_PARTITIONS = 1_000_000
BOUND = "struct<doc_id: bigint, start: int, length: int, doc_offset: bigint>"
SCHEMA = f"window_id bigint, n_tokens int, tokens array<int>, boundaries array<{BOUND}>"
_CHUNK = "pid int, local_off bigint, n bigint, width int, doc_ids array<bigint>, doc_lens array<bigint>, ids binary, head binary, tail binary"
_BOUND_ARROW = pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("doc_offset", pa.int64())])


def _tokenize(vocab: str, window: int):
    def run(batches):
        from pyspark import TaskContext

        tok, pid, off = bpe.load(vocab), TaskContext.get().partitionId(), 0
        width = tok.dtype.itemsize
        eos = np.array([tok.eos], dtype=tok.dtype).tobytes()
        edge = (window - 1) * width
        for batch in batches:
            rows = (r for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if r[1] is not None)
            for part in chunked(rows, lambda r: len(r[1])):
                coded = [tok.encode(t) + eos for _, t in part]
                ids = b"".join(coded)
                n = len(ids) // width
                cols = [[pid], [off], [n], [width], [[d for d, _ in part]], [[len(c) // width for c in coded]], [ids], [ids[:edge]], [ids[-edge:] if edge else b""]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pid", "local_off", "n", "width", "doc_ids", "doc_lens", "ids", "head", "tail"])
                off += n

    return run


def _bounds(lo: np.ndarray, hi: np.ndarray, ends: np.ndarray):
    """For spans [lo, hi) of a chunk: which document pieces each holds, as flat arrays and counts."""
    first = np.searchsorted(ends, lo, side="right")
    last = np.searchsorted(ends, hi, side="left")
    count = last - first + 1
    base = np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(first, count) + np.arange(count.sum()) - base
    begin = np.r_[0, ends[:-1]]
    a = np.maximum(begin[doc], np.repeat(lo, count))
    b = np.minimum(ends[doc], np.repeat(hi, count))
    return count, doc, a - np.repeat(lo, count), b - a, a - begin[doc]


def _bound_array(count, ids: pa.Array, doc, start, length, offset) -> pa.Array:
    flat = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(offset)], fields=list(_BOUND_ARROW))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), flat)


def _whole(window: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g, n = row["base"] + row["local_off"], row["n"]
                first, stop = -(-g // window), (g + n) // window
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
                ends, docs = np.cumsum(np.array(row["doc_lens"], dtype=np.int64)), pa.array(row["doc_ids"], pa.int64())
                for w0 in range(first, stop, 64):
                    w = np.arange(w0, min(stop, w0 + 64))
                    lo = w * window - g
                    data = ids[lo[0] : lo[-1] + window].astype(np.int32)
                    tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * window), pa.array(data))
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), window, np.int32)), tokens, _bound_array(*_with_ids(_bounds(lo, lo + window, ends), docs))], names=["window_id", "n_tokens", "tokens", "boundaries"])

    return run


def _with_ids(parts, docs):
    count, doc, start, length, offset = parts
    return count, docs, doc, start, length, offset


def _edges(window: int):
    """The pieces of windows that a chunk shares with its neighbours: two at most."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g, n = row["base"] + row["local_off"], row["n"]
                spans = []
                if g % window:
                    spans.append((0, min(n, window - g % window)))
                tail = (g + n) // window * window
                if tail < g + n and tail >= g:
                    spans.append((tail - g, n))
                if not spans:
                    continue
                ends, docs = np.cumsum(np.array(row["doc_lens"], dtype=np.int64)), pa.array(row["doc_ids"], pa.int64())
                head, last = (np.frombuffer(row[k], dtype=f"<u{row['width']}").astype(np.int32) for k in ("head", "tail"))
                data = [head[:b] if a == 0 and b <= len(head) else last[len(last) - (n - a) :] for a, b in spans]
                lo, hi = (np.array([s[k] for s in spans], dtype=np.int64) for k in (0, 1))
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int32)), pa.array(np.concatenate(data)))
                yield pa.RecordBatch.from_arrays([pa.array((g + lo) // window), pa.array(((g + lo) % window).astype(np.int32)), tokens, _bound_array(*_with_ids(_bounds(lo, hi, ends), docs))], names=["window_id", "start", "tokens", "boundaries"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocab: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """Windows of ``window`` token ids with the pieces of documents that each holds (see above)."""
    spark: SparkSession = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    chunks = scratch.put(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_tokenize(vocab, window), _CHUNK), "chunks")
    # One row a partition reaches the driver; the running sum over them gives global offsets.
    totals = chunks.groupBy("pid").agg(F.sum("n").alias("n")).orderBy("pid").collect()
    bases, at = [], 0
    for row in totals:
        bases.append((row.pid, at))
        at += row.n
    offsets = spark.createDataFrame(bases, "pid int, base bigint")
    placed = chunks.join(F.broadcast(offsets) if len(bases) <= BROADCAST_PARTITIONS else offsets, "pid")
    whole = placed.select("base", "local_off", "n", "width", "doc_ids", "doc_lens", "ids").mapInArrow(_whole(window), SCHEMA)
    edges = placed.select("base", "local_off", "n", "width", "doc_ids", "doc_lens", "head", "tail").mapInArrow(_edges(window), f"window_id bigint, start int, tokens array<int>, boundaries array<{BOUND}>")
    parts = edges.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("start", "tokens", "boundaries"))).alias("p"))
    joined = parts.select(
        "window_id",
        F.flatten("p.tokens").alias("tokens"),
        F.flatten(F.transform("p", lambda x: F.transform(x.boundaries, lambda b: F.struct(b.doc_id.alias("doc_id"), (b.start + x.start).alias("start"), b.length.alias("length"), b.doc_offset.alias("doc_offset"))))).alias("boundaries"),
    )
    return whole.unionByName(joined.select("window_id", F.size("tokens").alias("n_tokens"), "tokens", "boundaries"))
