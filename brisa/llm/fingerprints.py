"""Operator 7, document fingerprints.

Method: invertible Bloom lookup sketches. A document's fingerprint is a table of cells; every
paragraph's digest is added to ``HASHES`` of them (count, XOR of digests, XOR of check hashes). The
cells of one version minus those of another leave only the digests in which they differ, and
peeling cells that hold a single digest gives them back. Where peeling gets stuck, the pair is tried
again with larger sketches.

Versions: documents whose first paragraph (their heading) is the same, by ``doc_id``; each is
compared with the one before it, the first with an empty sketch. They are found by one range sort,
so that a heading that very many documents share is spread over partitions.

Rows: ``doc_id, prev_id, n_paragraphs, removed, added``: sorted digests of distinct paragraphs.

Defined results
- Paragraphs: the non-empty lines. Null ``doc_id`` or null text: no row. A text without a paragraph:
  empty lists, and it is a version of nothing.
- Repeated rows: rows with the same ``doc_id`` and paragraphs are one version. Rows with the same
  ``doc_id`` and other paragraphs are versions of each other, ordered by their digests (a tie).
- Very long texts only need larger sketches. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.text import mix
from brisa.session import Scratch, ensure_importable

CELLS = 24
GROWTH = 4
HASHES = 3
_BUDGET = 4_000_000  # cells handled at once in a worker
RESULT = "row_id bigint, done boolean, removed array<bigint>, added array<bigint>"


def digest(paragraph):
    """60 bits of MD5, which SQL engines can compute alike."""
    return F.conv(F.substring(F.md5(paragraph), 1, 15), 16, 10).cast("bigint")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, heading, digests, n_paragraphs``, without the texts."""
    lines = F.filter(F.split("text", "\n"), lambda p: p != "")
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.transform(lines, digest).alias("d"))
    return d.select("doc_id", F.try_element_at("d", F.lit(1)).alias("heading"), F.array_sort(F.array_distinct("d")).alias("digests"), F.size("d").alias("n_paragraphs")).distinct()


class Cells:
    """Sketches of many documents, ``m`` cells each, as flat arrays."""

    def __init__(self, n: int, m: int, salt: int):
        self.n, self.part, self.salt = n, max(1, m // HASHES), salt
        self.m = self.part * HASHES
        self.count = np.zeros(n * self.m, dtype=np.int64)
        self.keys = np.zeros(n * self.m, dtype=np.uint64)
        self.checks = np.zeros(n * self.m, dtype=np.uint64)

    def places(self, doc: np.ndarray, key: np.ndarray):
        for k in range(HASHES):
            h = mix(key + np.uint64((self.salt * HASHES + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            yield doc * self.m + k * self.part + (h % np.uint64(self.part)).astype(np.int64)

    @staticmethod
    def check(key: np.ndarray) -> np.ndarray:
        return mix(key ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)

    def add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = self.check(key)
        for at in self.places(doc, key):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, key)
            np.bitwise_xor.at(self.checks, at, check)

    def dump(self) -> list[bytes]:
        a = np.hstack([self.count.astype("<i4").view(np.uint8).reshape(self.n, -1), self.keys.view(np.uint8).reshape(self.n, -1), self.checks.astype("<u4").view(np.uint8).reshape(self.n, -1)])
        return [r.tobytes() for r in a]

    @classmethod
    def load(cls, rows: list[bytes | None], m: int, salt: int) -> "Cells":
        c = cls(len(rows), m, salt)
        a = np.frombuffer(b"".join(r if r is not None else bytes(16 * c.m) for r in rows), dtype=np.uint8).reshape(len(rows), 16 * c.m)
        c.count = np.ascontiguousarray(a[:, : 4 * c.m]).view("<i4").astype(np.int64).ravel()
        c.keys = np.ascontiguousarray(a[:, 4 * c.m : 12 * c.m]).view("<u8").ravel().copy()
        c.checks = np.ascontiguousarray(a[:, 12 * c.m :]).view("<u4").astype(np.uint64).ravel()
        return c

    def minus(self, other: "Cells") -> None:
        self.count -= other.count
        self.keys ^= other.keys
        self.checks ^= other.checks

    def peel(self):
        """(document, digest, sign) of the differences, and which documents came out whole."""
        docs, keys, signs = [], [], []
        for _ in range(self.m + 1):
            one = np.flatnonzero(np.abs(self.count) == 1)
            one = one[self.check(self.keys[one]) == self.checks[one]]
            if not len(one):
                break
            doc, key, sign = one // self.m, self.keys[one], self.count[one]
            _, first = np.unique(np.stack([doc.astype(np.uint64), key], 1), axis=0, return_index=True)
            doc, key, sign = doc[first], key[first], sign[first]
            docs.append(doc), keys.append(key), signs.append(sign)
            self.add(doc, key, -sign)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(self.n, self.m).any(1)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(docs, np.int64), cat(keys, np.uint64), cat(signs, np.int64), done


def _pieces(n: int, m: int):
    step = max(1, _BUDGET // m)
    return ((a, min(n, a + step)) for a in range(0, n, step))


def _filled(b: pa.RecordBatch, a: int, z: int, m: int, salt: int) -> Cells:
    """Sketches of the rows ``a`` to ``z`` of a batch."""
    part = b.column("digests").slice(a, z - a)
    c = Cells(z - a, m, salt)
    size = np.diff(part.offsets.to_numpy())
    c.add(np.repeat(np.arange(z - a), size), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return c


def _sketch(m: int, salt: int):
    def run(batches):
        for b in batches:
            for a, z in _pieces(b.num_rows, m):
                sketches = pa.array(_filled(b, a, z, m, salt).dump(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, z - a) for c in ("row_id", "prev_row")] + [sketches], names=["row_id", "prev_row", "sketch"])

    return run


def _result(c: Cells, ids: pa.Array) -> pa.RecordBatch:
    doc, key, sign, done = c.peel()
    order = np.lexsort((key, doc))
    doc, key, sign = doc[order], key[order].view(np.int64), sign[order]
    lists = []
    for want in (-1, 1):
        at = np.bincount(doc[sign == want], minlength=c.n)
        lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(at)].astype(np.int32)), pa.array(key[sign == want])))
    return pa.RecordBatch.from_arrays([ids, pa.array(done), *lists], names=["row_id", "done", "removed", "added"])


def _alone(m: int, salt: int):
    """Against the empty sketch."""

    def run(batches):
        for b in batches:
            for a, z in _pieces(b.num_rows, m):
                yield _result(_filled(b, a, z, m, salt), b.column("row_id").slice(a, z - a))

    return run


def _compare(m: int, salt: int):
    def run(batches):
        for b in batches:
            new, old = b.column("sketch").to_pylist(), b.column("prev_sketch").to_pylist()
            for a, z in _pieces(b.num_rows, m):
                c = Cells.load(new[a:z], m, salt)
                c.minus(Cells.load(old[a:z], m, salt))
                yield _result(c, b.column("row_id").slice(a, z - a))

    return run


def compare_versions(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Each document's differences from the version before it (see above)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    ordered = paragraphs(docs).repartitionByRange("heading", "doc_id", "digests").sortWithinPartitions("heading", "doc_id", "digests")
    # Ids follow the order: the partition in the upper bits, the place in it in the lower ones.
    table = scratch.put(ordered.withColumn("row_id", F.monotonically_increasing_id()), "paragraphs")
    pid = F.shiftright("row_id", 33)
    inner = table.select("row_id", "heading", pid.alias("pid")).withColumn("before", F.lag(F.struct("row_id", "heading")).over(Window.partitionBy("pid").orderBy("row_id")))
    # A partition's first row follows the last row of the partition before it: one row each, on the driver.
    edges = table.groupBy(pid.alias("pid")).agg(F.max(F.struct("row_id", "heading")).alias("last")).orderBy("pid").collect()
    linked = [(b.pid, a.last.row_id, a.last.heading) for a, b in zip(edges, edges[1:])]
    carried = spark.createDataFrame(linked, "pid bigint, c_row bigint, c_heading bigint")
    before = F.when(F.col("before").isNull(), F.struct(F.col("c_row").alias("row_id"), F.col("c_heading").alias("heading"))).otherwise(F.col("before"))
    pairs = inner.join(carried, "pid", "left").select("row_id", F.when(before.heading == F.col("heading"), before.row_id).alias("prev_row"))
    pairs = scratch.put(pairs, "pairs")
    pending, done, m, k = pairs, [], cells, 0
    while True:
        # First versions need no partner, so their sketches go nowhere; of a pair, each side's goes once.
        here = table.select("row_id", "digests").join(pending, "row_id")
        first = here.where("prev_row IS NULL").select("row_id", "digests").mapInArrow(_alone(m, k), RESULT)
        new = here.where("prev_row IS NOT NULL").select("row_id", "prev_row", "digests").mapInArrow(_sketch(m, k), "row_id bigint, prev_row bigint, sketch binary")
        wanted = pending.where("prev_row IS NOT NULL").select(F.col("prev_row").alias("row_id"))
        old = table.select("row_id", F.col("row_id").alias("prev_row"), "digests").join(wanted, "row_id", "left_semi").mapInArrow(_sketch(m, k), "row_id bigint, prev_row bigint, sketch binary")
        both = new.join(old.select("prev_row", F.col("sketch").alias("prev_sketch")), "prev_row")
        pairs_tried = both.select("row_id", "sketch", "prev_sketch").mapInArrow(_compare(m, k), RESULT)
        tried = scratch.put(first.unionByName(pairs_tried), f"tried{k}")
        done.append(tried.where("done").drop("done"))
        failed = tried.where("NOT done").select("row_id")
        if failed.isEmpty():
            break
        pending, m, k = pending.join(failed, "row_id", "left_semi"), m * GROWTH, k + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    who = table.select("row_id", "doc_id", "n_paragraphs")
    prev = pairs.join(table.select(F.col("row_id").alias("prev_row"), F.col("doc_id").alias("prev_id")), "prev_row", "left")
    return found.join(who, "row_id").join(prev.select("row_id", "prev_id"), "row_id").select("doc_id", "prev_id", "n_paragraphs", "removed", "added")

