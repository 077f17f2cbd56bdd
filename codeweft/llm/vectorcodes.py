"""Compression of vectors to short codes: one codebook for each part position.

Components become integers, floor(scale * x). A vector is cut into `parts` equal runs. Codebooks start
as the parts of the first `entries` vectors in order of id and move through `rounds` of assignment and
componentwise floor of the mean; then every part is assigned a last time. All sums are integers, so the
result depends neither on the order of rows nor on how they are partitioned.

Vectors are packed into columnar blocks (one row of integers a dimension), written once. A round is one
`treeAggregate` over the blocks: distances grow dimension by dimension in an (vectors x entries) table
of at most `SLICE` rows, `np.add.at` adds the parts to int64 sum and count tensors, and the tensors
merge through a tree whose depth follows the number of partitions. What moves is a tensor a task
(entries x length numbers), never a vector; what reaches the driver and the executors is one tensor.

Nulls: a vector that is null, empty, or has a null or non-finite component takes no part, nor does one
of another length than most have (ties: the longer). Null ids come last and are coded too; equal ids
are ordered by their components. With fewer vectors than `entries`, codebooks are as small. A length
that is no multiple of `parts` is filled up with zeros. Integers are held within a bound of about 2**27
(for 64 dimensions), so that squared distances stay exact. Null labels are one label. An empty table
gives an empty result. Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import cut

SLICE = 4096


def finite(frame: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, v, label) of the vectors that may take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = frame.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.col(label).alias("label")).where(F.col("v").isNotNull())
    return rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def bound(dim: int) -> int:
    """Components up to it have squared distances over `dim` dimensions that fit 62 bits."""
    return min(2**31 - 1, math.isqrt(2**62 // dim) // 2)


def integers(flat: np.ndarray, dim: int, parts: int, scale: float) -> np.ndarray:
    """dimensions x vectors, filled up with zeros to a multiple of `parts`."""
    most = bound(dim)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat.reshape(-1, dim) * scale), -most, most).astype(np.int32)
    return np.ascontiguousarray(np.pad(whole, ((0, 0), (0, -dim % parts))).T)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a part (width x vectors) the nearest entry (entries x width), the first of equals, and the squared distance."""
    distance = np.zeros((part.shape[1], len(book)), np.int64)
    for d, values in enumerate(part):
        gap = values.astype(np.int64)[:, None] - book[None, :, d]
        distance += gap * gap
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def slices(data: bytes, rows: int) -> Iterator[np.ndarray]:
    block = np.frombuffer(data, np.int32).reshape(rows, -1)
    for at in range(0, block.shape[1], SLICE):
        yield block[:, at : at + SLICE]


class Tally:
    """Sums (parts x entries x width) and counts (parts x entries) of what is nearest to each entry."""

    def __init__(self, books: np.ndarray):
        self.sums, self.counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)

    def add(self, data: bytes, books: np.ndarray) -> Tally:
        parts, _, width = books.shape
        for block in slices(data, parts * width):
            for p in range(parts):
                part = block[p * width : (p + 1) * width]
                best, _ = nearest(part, books[p])
                np.add.at(self.sums[p], best, part.T.astype(np.int64))
                np.add.at(self.counts[p], best, 1)
        return self

    def merge(self, other: Tally) -> Tally:
        self.sums += other.sums
        self.counts += other.counts
        return self

    def means(self, books: np.ndarray) -> np.ndarray:
        """Floors of the means; entries that nothing is nearest to stay."""
        return np.where(self.counts[:, :, None] > 0, self.sums // np.maximum(self.counts, 1)[:, :, None], books)


def packed(rows: DataFrame, dim: int, parts: int, scale: float) -> DataFrame:
    """(ids, labels, data): columnar blocks of some ten thousand vectors."""
    label = rows.schema["label"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                data = integers(batch.column("v").flatten().to_numpy(zero_copy_only=False), dim, parts, scale).tobytes()
                ends = pa.array([0, batch.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary())], names=["ids", "labels", "data"])

    return rows.mapInArrow(pack, f"ids array<long>, labels array<{label}>, data binary")


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after `rounds`; each is one tree of merged tensors."""
    data = blocks.select("data").rdd.map(lambda row: bytes(row.data))
    depth = 2 + (data.getNumPartitions() > 1000) + (data.getNumPartitions() > 100_000)
    for _ in range(rounds):
        sent = blocks.sparkSession.sparkContext.broadcast(books)  # entries x length numbers
        tally = data.treeAggregate(Tally(books), lambda held, block, sent=sent: held.add(block, sent.value), Tally.merge, depth)
        books = tally.means(books)
    return books


def compress(
    frame: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0
) -> tuple[DataFrame, str, np.ndarray]:
    """(id, label, code, error) of every vector that takes part, the digest of the codebooks, and the codebooks
    (parts x entries x width). `code` has two hex digits a part; `error` is its squared distance in all."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = frame.sparkSession
    rows = finite(frame, key, vector, label)
    kind = rows.schema["label"].dataType.simpleString()
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if top is None:
        return spark.createDataFrame([], f"id long, label {kind}, code string, error long"), hashlib.sha256(b"").hexdigest(), np.zeros((parts, 0, 0), np.int64)
    dim = top["n"]
    rows = rows.where(F.size("v") == dim)
    firsts = np.array([r.v for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()])  # `entries` rows
    books = np.stack(np.split(integers(firsts.ravel(), dim, parts, scale).T.astype(np.int64), parts, axis=1))
    blocks = cut(packed(rows, dim, parts, scale))
    books = trained(blocks, books, rounds)
    width = books.shape[2]
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def assigned(batches):
        for batch in batches:
            for ids, labels, data in zip(batch.column("ids"), batch.column("labels"), batch.column("data"), strict=True):
                codes, errors = [], []
                for block in slices(data.as_py(), parts * width):
                    found = [nearest(block[p * width : (p + 1) * width], books[p]) for p in range(parts)]
                    codes.append(digits[np.stack([best for best, _ in found], axis=1)].view(f"S{2 * parts}").ravel())
                    errors.append(sum(distance for _, distance in found))
                code = pa.array(np.concatenate(codes).astype(str))
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, code, pa.array(np.concatenate(errors))], names=["id", "label", "code", "error"])

    coded = blocks.mapInArrow(assigned, f"id long, label {kind}, code string, error long")
    return coded, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest(), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels in all. Written tables on both sides: Spark sees their true
    sizes, sends the sums to all tasks if they are small and else joins by label, splitting hot ones."""
    coded = cut(coded)
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, coded.label.eqNullSafe(sums["of"])).drop("of")
