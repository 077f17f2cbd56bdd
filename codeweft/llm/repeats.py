"""Exchange of window hashes between blocks of documents, for finding what repeats across a corpus.

Shared by the suffix-array and the substring deduplication. Units are bytes or words; a window is
`window` consecutive units of one document. Documents are dealt into blocks of bounded size by a
hash of id and text, shuffled once; all passes read that one exchange.

1. Anchors. Of the `window - gram + 1` grams in a window, the one with the least hash (the first of
   equal ones) is its anchor. Equal windows have equal anchors at equal places, so a window can only
   repeat if its anchor repeats. Consecutive windows with one anchor form a run.
2. A block sends one row for each distinct (anchor, run content); copies are folded there. All rows
   of an anchor meet, sorted, and are streamed. A run whose content occurs twice repeats as a whole,
   and one block goes on to represent it; an anchor with one run in all is settled; other runs of a
   repeated anchor are open.
3. Blocks send what open and representing runs hold, to be settled window by window (`settle`).

Replies go to blocks by content, never by row number, so retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import partitions

BLOCKS_PER_PARTITION = 8
SEGMENT = 1 << 22
WAITING = 1 << 18
OPEN, WHOLE, SPEAKER = 0, 1, 2
ROW = "a long, c long, g int, many boolean"
REPLY = "g int, kind int, a long, c long, data binary"


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, n = 1, len(x)
    out = x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out[: n - width + 1]


def runs(gram: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows with one anchor, and the anchor's place.

    gram: the hash of the gram at each place; valid: starts of windows, ascending; width: grams a window.
    """
    firsts, lasts, anchors = [], [], []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, len(gram), SEGMENT):
        own = valid[np.searchsorted(valid, at) : np.searchsorted(valid, at + SEGMENT)]
        if not len(own):
            continue
        part = gram[at : at + SEGMENT + width - 1]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), width)
        anchor = (least[own - at] & low).astype(np.int64) + at
        new = np.concatenate([[True], (np.diff(own) != 1) | (np.diff(anchor) != 0)])
        first = np.flatnonzero(new)
        firsts.append(own[first])
        lasts.append(own[np.concatenate([first[1:] - 1, [len(own) - 1]])])
        anchors.append(anchor[first])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


def least_place(gram: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each place (ascending): that of the least of the `width` grams from there on, the first of equal ones."""
    low, found = np.uint64((1 << 24) - 1), [np.zeros(0, np.int64)]
    for start in range(0, len(gram), SEGMENT):
        own = at[np.searchsorted(at, start) : np.searchsorted(at, start + SEGMENT)]
        if len(own):
            part = gram[start : start + SEGMENT + width - 1]
            least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), width)
            found.append((least[own - start] & low).astype(np.int64) + start)
    return np.concatenate(found)


def folded(a: np.ndarray, c: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, c) and whether each occurred more than once."""
    order = np.lexsort([c, a])
    a, c = a[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(a)]])) > 1
    if many is not None and len(a):
        count |= np.logical_or.reduceat(many[order], new)
    return a[new], c[new], count


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(g, key, text), hash-partitioned by the block g."""
    n = partitions(docs.sparkSession)
    body = F.col(text).cast("string")
    g = F.pmod(F.xxhash64(F.col(key), body), F.lit(n * BLOCKS_PER_PARTITION)).cast("int")
    return docs.select(g.alias("g"), F.col(key).alias("key"), body.alias("text")).repartition(n, "g")


def in_blocks(frame: DataFrame, schema: str, made: Callable[[int, list], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`made(g, texts)` over every block."""

    def run(table: pa.Table) -> pa.Table:
        found = list(made(table.column("g")[0].as_py(), table.column("text").to_pylist()))
        return pa.Table.from_batches(found, found[0].schema)

    return frame.groupBy("g").applyInArrow(run, schema)


def with_replies(frame: DataFrame, replies: DataFrame, schema: str, made: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """`made(documents, replies)` over every block that has documents."""
    replies = replies.repartition(partitions(frame.sparkSession), "g")
    return frame.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(made, schema)


def request(g: int, a: np.ndarray, c: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(c)), pa.array(np.full(len(a), g, np.int32)), pa.array(many)], names=["a", "c", "g", "many"])


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal `columns` of sorted batches; only the last group waits."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        other = np.zeros(batch.num_rows, bool)
        for k in keys:
            other |= k != k[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        first = tuple(k[0] for k in keys)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and last != first:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
        last = tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def reply(g: np.ndarray, kind: np.ndarray, a: np.ndarray, c: np.ndarray, data: list | None = None) -> pa.RecordBatch:
    body = pa.array(data, pa.binary()) if data is not None else pa.nulls(len(g), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(a), pa.array(c), body], names=["g", "kind", "a", "c", "data"])


def judged_runs(batches: Iterator[pa.RecordBatch], hot: int, hot_bit: int) -> Iterator[pa.RecordBatch]:
    """What blocks learn of their runs (rows of ROW sorted by a, c, g).

    kind is OPEN, WHOLE or SPEAKER; plus `hot_bit` where an anchor has over `hot` different runs. Rows
    of an anchor wait for one another up to `WAITING`; beyond that they pass as hot ones, run by run.
    """
    held: list[pa.Table] = []
    waiting, passing, current = 0, False, None

    def told(tables: list[pa.Table], passing: bool) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        a, c, g = (table.column(x).to_numpy() for x in ("a", "c", "g"))
        many = table.column("many").to_numpy(zero_copy_only=False).astype(bool)
        anchor = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])])
        content = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (c[1:] != c[:-1]))])
        first = np.concatenate([[True], content[1:] != content[:-1]])
        twice = (np.bincount(content)[content] > 1) | np.bincount(content, many)[content].astype(bool)
        kinds = np.bincount(anchor, first)[anchor]
        several, bit = (np.ones(len(a), bool), hot_bit) if passing else (kinds > 1, np.where(kinds > hot, hot_bit, 0))
        sent = several | twice
        kind = np.where(twice, np.where(first & several, SPEAKER, WHOLE), OPEN) + bit
        return reply(g[sent], kind[sent], a[sent], c[sent])

    for table in groups(batches, ["a", "c"]):  # whole runs: a row a block at most for each
        a = table.column("a").to_numpy()
        head = int(np.searchsorted(a, current, side="right")) if current is not None and a[0] == current else 0
        if head:
            held.append(table.slice(0, head))
            waiting += head
        if head < len(a):  # the anchor before is complete, and so are all here but the last
            if held:
                yield told(held, passing)
            last = int(np.searchsorted(a, a[-1]))
            if last > head:
                yield told([table.slice(head, last - head)], False)
            held, waiting, passing, current = [table.slice(last)], len(a) - last, False, a[-1]
        if waiting > WAITING:
            yield told(held, True)
            held, waiting, passing = [], 0, True
    if held:
        yield told(held, passing)


def judged_windows(table: pa.Table, kind: int) -> pa.RecordBatch:
    """The windows (a, c: two hashes of one content) that occur more than once, for every block that asked."""
    a, c, g = (table.column(x).to_numpy() for x in ("a", "c", "g"))
    many = table.column("many").to_numpy(zero_copy_only=False).astype(bool)
    content = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (c[1:] != c[:-1]))]) if len(a) else np.zeros(0, np.int64)
    hit = ((np.bincount(content) > 1) | np.bincount(content, many).astype(bool))[content]
    return reply(g[hit], np.full(hit.sum(), kind), a[hit], c[hit])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the given runs, and the run of each."""
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def lookup(a: np.ndarray, c: np.ndarray, known_a: np.ndarray, known_c: np.ndarray) -> np.ndarray:
    """For each (a, c) the row of `known`, or -1."""
    if not len(known_a) or not len(a):
        return np.full(len(a), -1)
    order = np.lexsort([known_c, known_a])
    ka, kc = known_a[order], known_c[order]
    at = np.searchsorted(ka, a)
    found = np.full(len(a), -1)
    todo = np.flatnonzero((at < len(ka)) & (ka[np.minimum(at, len(ka) - 1)] == a))
    at = at[todo]
    while len(todo):  # rows of one anchor stand together
        same = kc[at] == c[todo]
        found[todo[same]] = order[at[same]]
        todo, at = todo[~same], at[~same] + 1
        more = (at < len(ka)) & (ka[np.minimum(at, len(ka) - 1)] == a[todo])
        todo, at = todo[more], at[more]
    return found


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Units covered by windows at `starts` (distinct)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0
