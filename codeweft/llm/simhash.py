"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints. Words of the whole text (ASCII lower case) make k-word shingles, repeats included; a
shingle's XXH64 votes on 64 bits, and a bit is set if over half of the votes set it. With several
lanes, each further lane takes the votes of the hash remixed with the lane's number, for finer
distances. A text with fewer than k words is one shingle; without words its fingerprint is zero.

Index. Equal fingerprints are folded first (combined map-side), so copies cost one row. The top
level of the hierarchy has nodes whose pattern is shared exactly under the mask of a bit subset
(`masks`). With one lane and d differences, d+1 disjoint masks find every link: among d+1 parts one
is free of differences. Rows of a top node are sorted by the Gray rank of their fingerprint, where
neighbours share long bit patterns; leaves of `LEAF` fingerprints and parents of `FAN` children
keep the mask and pattern that all below share. Two nodes are compared by the differences in bits
that both masks share: if these exceed d, the whole pair of groups is pruned; only surviving leaf
pairs are compared in full. A top node of over `TILE` rows is dealt into tiles by a hash, and every
pair of tiles is searched in a task of its own: nothing is capped. A node's links are emitted as
the edges of a spanning forest, never as all pairs.

Nulls: a null text has no words. Null and repeated ids are kept: each row gets its fingerprint and
the least non-null id of its component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import cut, partitions
from codeweft.llm.graph import components

SEED = 42
LEAF, FAN, TILE = 16, 16, 4096
PIECE = 1 << 16
Masks = Sequence[Sequence[int]]


def remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash: the finaliser of SplitMix64 over the hash plus a lane constant."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, k: int, lanes: int = 1) -> bytes:
    """Big-endian bytes of the lanes, one after another."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * lanes)
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - k + 1)
    votes = np.zeros((lanes, 64), np.int64)
    for at in range(0, count, PIECE):
        part = words[at : min(at + PIECE, count) + k - 1]
        joined = b" ".join(part)
        ends, end = [], -1
        for word in part:
            end += len(word) + 1
            ends.append(end)
        starts = [0, *[e + 1 for e in ends[:-1]]]
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :] or ends[-1:], strict=False)], np.uint64)
        for lane in range(lanes):
            own = (remix(hashes, lane) if lane else hashes).astype(">u8").view(np.uint8).reshape(-1, 8)
            votes[lane] += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > count, axis=1).tobytes()


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 3, lanes: int = 1) -> DataFrame:
    """(key, fp binary), a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x, k, lanes) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp binary")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _nodes(mask: np.ndarray, pattern: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents of `width` nodes each: the bits in which all their children are known and equal."""
    at = np.arange(0, len(mask), width)
    known = np.bitwise_and.reduceat(mask, at)
    ones = np.bitwise_and.reduceat(pattern, at)
    zeros = np.bitwise_and.reduceat(~pattern, at)
    known &= ones | zeros
    return known, ones & known


def links(fps: np.ndarray, most: int) -> np.ndarray:
    """For the distinct rows of fps (n x lanes): the index of the least row of each one's component."""
    n = len(fps)
    order = np.lexsort([gray_rank(fps[:, i]) for i in reversed(range(fps.shape[1]))])
    data = fps[order]
    levels = [(np.full_like(data, 0xFFFFFFFFFFFFFFFF), data)]
    width = LEAF
    while len(levels[-1][0]) > FAN:
        levels.append(_nodes(*levels[-1], width))
        width = FAN
    label = np.arange(n)
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    pairs = [(i, j)]
    for depth in range(len(levels) - 1, -1, -1):
        mask, pattern = levels[depth]
        grown = []
        for i, j in pairs:
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]).sum(axis=1)
                near = apart <= most
                a, b = a[near], b[near]
                if depth == 0:
                    own = a != b
                    label = _merge(label, a[own], b[own])
                    continue
                below, size = (LEAF if depth == 1 else FAN), len(levels[depth - 1][0])
                step = max(1, (1 << 20) // (below * below))
                x, y = (g.ravel() for g in np.meshgrid(np.arange(below), np.arange(below), indexing="ij"))
                for s in range(0, len(a), step):
                    c = (a[s : s + step, None] * below + x).ravel()
                    d = (b[s : s + step, None] * below + y).ravel()
                    ok = (c <= d) & (c < size) & (d < size)
                    grown.append((c[ok], d[ok]))
                    if depth == 1:  # leaf pairs are compared at once: their pairs are not kept
                        c, d = grown.pop()
                        close = np.bitwise_count(data[c] ^ data[d]).sum(axis=1) <= most
                        close &= c != d
                        label = _merge(label, c[close], d[close])
        if depth == 1:
            break
        pairs = grown
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after adding edges: least labels spread over edges, then pointers are followed."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def bands(bits: int, count: int) -> list[list[int]]:
    """`count` disjoint runs of bits that cover all."""
    cuts = [round(i * bits / count) for i in range(count + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def edges(fps: DataFrame, most: int, masks: Masks, lanes: int = 1) -> DataFrame:
    """(a, b): the edges of a forest in every top node that joins what lies within `most` bits.

    `fps`: distinct fingerprints in a binary column fp.
    """
    picks = [np.array(m) for m in masks]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8 * lanes)
            on = np.unpackbits(raw, axis=1)
            if not len(on):
                continue
            for number, pick in enumerate(picks):
                value = on[:, pick].astype(np.int64) @ (1 << np.arange(len(pick), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), number, np.int32)), pa.array(value), batch.column(0)], names=["mask", "value", "fp"])

    rows = fps.select("fp").mapInArrow(keyed, "mask int, value long, fp binary")
    counts = rows.groupBy("mask", "value").count().where(F.col("count") > TILE)
    # A table, so that its true size decides how it is joined.
    large = cut(counts.select(F.col("mask").alias("m"), F.col("value").alias("v"), F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    on = (F.col("mask") == F.col("m")) & (F.col("value") == F.col("v"))
    small = rows.join(large, on, "left_anti").select("mask", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = rows.join(large, on).withColumn("own", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("mask", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    work = small.unionByName(dealt).repartition(partitions(fps.sparkSession), "mask", "value", "x", "y").sortWithinPartitions("mask", "value", "x", "y")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(table: pa.Table) -> pa.RecordBatch:
            raw = b"".join(table.column("fp").to_pylist())
            data = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, lanes)
            keys = np.stack([table.column(c).to_numpy() for c in ("mask", "value", "x", "y")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            froms, tos = [], []
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if e - s > 1:
                    root = links(data[s:e], most)
                    moved = np.flatnonzero(root != np.arange(e - s))
                    froms.append(moved + s)
                    tos.append(root[moved] + s)
            pick = lambda at: pa.array([raw[i * 8 * lanes : (i + 1) * 8 * lanes] for i in (np.concatenate(at).tolist() if at else [])], pa.binary())
            return pa.RecordBatch.from_arrays([pick(froms), pick(tos)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if len(last):  # all but the last group are complete
                end = int(last[-1]) + 1
                yield closed(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = [batch.slice(end)]
            elif held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(4)):
                yield closed(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield closed(pa.Table.from_batches(held))

    return work.mapInArrow(search, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 3, most: int = 2, lanes: int = 1, masks: Masks | None = None
) -> DataFrame:
    """(key, fp, component): the least key of all documents linked to this one, directly or not.

    Without `masks` the search is exact: most+1 disjoint parts of the bits.
    """
    printed = cut(fingerprints(docs, key=key, text=text, k=k, lanes=lanes))
    distinct = cut(printed.groupBy("fp").agg(F.min("key").alias("least")))
    found = edges(distinct, most, masks or bands(64 * lanes, most + 1), lanes)
    roots = cut(components(found))
    linked = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = linked.join(least, "root").select("fp", "component")
    every = distinct.join(of.withColumnRenamed("fp", "node"), F.col("fp") == F.col("node"), "left")
    # A table, so that a fingerprint of many documents can be split in the join.
    every = cut(every.select(F.col("fp").alias("node"), F.coalesce("component", "least").alias("component")))
    return printed.join(every, printed.fp == every.node).select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: links that fingerprints show, then all others (see `jaccard`)."""
    from codeweft.llm import jaccard

    return jaccard.one_of_each(docs)
