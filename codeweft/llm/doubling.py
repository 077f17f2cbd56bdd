"""Substring dedup: words covered by a window of `window` words that also starts anywhere else.

Level-wise doubling. The lengths go down from the wanted one by halves (35, 18, 9 words); the levels
go up. Level by level, windows of one length that occur twice, and no others, are extended to twice
that length, until no candidates survive or the wanted length is reached. Every full window holds one
chosen window of each shorter length: of the half-length windows in it the one with the least hash, of
that one's halves the least again; equal full windows hold equal ones, so none is lost when a level
drops what occurs once. At the last step from 18 words to 35, neighbouring full windows around one
half window are first compared as a run, which settles copies of whole runs at once; single full
windows of runs that are still open follow.

Short windows are told apart by 64 bits, which only finds candidates. Runs and full windows are told
apart by the 64 bits that found them together with an XXH3 of their bytes.

Windows are judged on the input. Nulls: a null text has no words. Repeated rows count as occurrences
of one another. Null ids are kept. Words are kept unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeweft.llm import repeats as R
from codeweft.llm.common import partitions
from codeweft.llm.sequences import SPACES, Words, pieces

WINDOW, SHORTEST = 35, 8
FOUND, LEVEL = 9, 10


def lengths(window: int) -> list[int]:
    """The lengths below the wanted one, longest first."""
    found = [(window + 1) // 2]
    while (found[-1] + 1) // 2 >= SHORTEST:
        found.append((found[-1] + 1) // 2)
    return found


def _anchors(held: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of every run, and the place of its half window."""
    half = (window + 1) // 2
    return R.runs(held.rolling.every(half), held.fits(window), window - half + 1)


def _chosen(held: Words, at: np.ndarray, window: int, level: int) -> np.ndarray:
    """Hashes of the windows of lengths(window)[level] that are chosen in the half windows at `at`."""
    sizes = lengths(window)
    for longer, shorter in zip(sizes, sizes[1 : level + 1], strict=False):
        places, back = np.unique(at, return_inverse=True)
        at = R.least_place(held.rolling.every(shorter), places, longer - shorter + 1)[back]
    return R.signed(held.hashes(at, sizes[level]))


def _runs(held: Words, window: int):
    """First start, last start, hash of the half window, hash of the content of every run."""
    first, last, anchor = _anchors(held, window)
    return first, last, _chosen(held, anchor, window, 0), R.signed(held.strong(first, last - first + window))


def _full(held: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows: the rolling hash, and the strong one of the bytes."""
    return R.signed(held.hashes(at, window)), R.signed(held.strong(at, window))


def _texts(table: pa.Table) -> list:
    return table.column("text").to_pylist()


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]): a row a document; kept words joined by one space."""
    spark = docs.sparkSession
    n = partitions(spark)
    dealt = R.blocks(docs, key, text)

    sizes = lengths(window)

    def asking(g: int, a: list, c: list) -> pa.RecordBatch:
        x, y, many = R.folded(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *c]))
        return R.request(g, x.view(np.uint64), y.view(np.uint64), many)

    def shortest(g: int, bodies: list) -> Iterator[pa.RecordBatch]:
        a = []
        for _, part in pieces(bodies):
            held = Words(SPACES, part)
            a.append(_chosen(held, np.unique(_anchors(held, window)[2]), window, len(sizes) - 1))
        yield asking(g, a, [np.zeros(len(x), np.int64) for x in a])

    def extended(level: int):
        """What repeated one level below, at this level; at -1 as runs."""

        def made(documents: pa.Table, replies: pa.Table) -> pa.Table:
            seen = np.unique(replies.column("a").to_numpy())
            a, c = [], []
            for _, part in pieces(_texts(documents)) if len(seen) else ():
                held = Words(SPACES, part)
                first, last, anchor = _anchors(held, window)
                if level >= 0:
                    anchor = np.unique(anchor)
                on = np.isin(_chosen(held, anchor, window, level + 1), seen)
                a.append(_chosen(held, anchor[on], window, max(level, 0)))
                c.append(R.signed(held.strong(first[on], last[on] - first[on] + window)) if level < 0 else np.zeros(len(a[-1]), np.int64))
            return pa.Table.from_batches([asking(documents.column("g")[0].as_py() if documents.num_rows else 0, a, c)])

        return made

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.groups(batches, ["a"]):
            yield R.judged_windows(table, LEVEL)

    asked = R.in_blocks(dealt, R.ROW, shortest)
    for level in range(len(sizes) - 2, -2, -1):
        seen = asked.repartition(n, "a").sortWithinPartitions("a", "c", "g").mapInArrow(twice, R.REPLY)
        asked = R.with_replies(dealt, seen, R.ROW, extended(level))
    asked = asked.repartition(n, "a").sortWithinPartitions("a", "c", "g")
    known = asked.mapInArrow(lambda batches: R.judged_runs(batches, 1 << 62, 0), R.REPLY)

    def wholes(documents: pa.Table, replies: pa.Table) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        open_ = np.flatnonzero((kind == R.OPEN) | (kind == R.SPEAKER))
        ka, kc = (replies.column(x).to_numpy()[open_] for x in ("a", "c"))
        h1, h2, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for _, part in pieces(_texts(documents)) if len(open_) else ():
            held = Words(SPACES, part)
            first, last, anchor, content = _runs(held, window)
            row = R.lookup(anchor, content, ka, kc)
            mine = np.flatnonzero(row >= 0)
            at, run = R.spread(first[mine], last[mine])
            x, y = _full(held, at, window)
            h1.append(x)
            h2.append(y)
            many.append(kind[open_[row[mine]]][run] == R.SPEAKER)
        g = documents.column("g")[0].as_py() if documents.num_rows else 0
        x, y, z = R.folded(np.concatenate(h1), np.concatenate(h2), np.concatenate(many))
        return pa.Table.from_batches([R.request(g, x.view(np.uint64), y.view(np.uint64), z)])

    sent = R.with_replies(dealt, known, R.ROW, wholes).repartition(n, "a").sortWithinPartitions("a", "c", "g")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.groups(batches, ["a"]):
            yield R.judged_windows(table, FOUND)

    replies = known.where("kind in (1, 2)").unionByName(sent.mapInArrow(settled, R.REPLY))

    def finish(documents: pa.Table, answers: pa.Table) -> pa.Table:
        kind, a, c = (answers.column(x).to_numpy() for x in ("kind", "a", "c"))
        full, single = kind != FOUND, kind == FOUND
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for _, part in pieces(_texts(documents)):
            held = Words(SPACES, part)
            first, last, anchor, content = _runs(held, window)
            whole = R.lookup(anchor, content, a[full], c[full]) >= 0
            at, _ = R.spread(first[whole], last[whole])
            if single.any():
                rest, _ = R.spread(first[~whole], last[~whole])
                x, y = _full(held, rest, window)
                at = np.concatenate([at, rest[R.lookup(x, y, a[single], c[single]) >= 0]])
            gone = R.covered(at, window, len(held.starts))
            removed = np.bincount(held.text_of[gone], minlength=len(part))
            end = np.cumsum(held.counts)
            for i, t in enumerate(part):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                if removed[i]:
                    words = compress(words, (~gone[end[i] - held.counts[i] : end[i]]).tolist())
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode("utf-8", "surrogatepass"))
            n_words += held.counts.tolist()
            n_removed += removed.tolist()
        made = {"key": documents.column("key"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(made | ({"kept": pa.array(kept_texts, pa.string())} if texts else {}))

    kind = dealt.schema["key"].dataType.simpleString()
    out = R.with_replies(dealt, replies, f"key {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts, finish)
    return out.withColumnRenamed("key", key)
