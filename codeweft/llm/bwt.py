"""Suffix-array dedup: bytes covered by a `window`-byte string that also starts anywhere else.

A repeated window shares its anchor (see `repeats`), so texts are compared per anchor: the different
runs around one anchor, each sent once, meet in a task and are indexed together, some `CHUNK` bytes
at a time. Of the chunk a Burrows-Wheeler transform is made, and common prefixes are derived from it
by increasing value: starting from the whole range, intervals are extended backward breadth-first by
every byte that precedes them; an interval of strings of length l+1 that ends where no value is set
yet fixes the value l there and is extended in turn, others are dropped. The expansion stops at
`window`: where still no value is set, neighbours share a prefix of at least `window` bytes, so both
strings repeat. Runs whose content occurs twice as a whole are settled by folding copies before,
and one of them takes part in the index; anchors with over `HOT` different runs are settled window
by window by 128-bit hashes in the same exchange, which any number of tasks share.

Texts are judged as UTF-8 bytes; matches never cross documents; strings are judged on the input.
Nulls: a null text is empty. Repeated rows are occurrences of one another. Null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import repeats as R
from codeweft.llm.common import partitions
from codeweft.llm.sequences import Rolling, mix, pieces, strong

WINDOW = 400
HOT = 2000
CHUNK = 1 << 20
BITMAP, FOUND, HOT_BIT = 8, 9, 16
SENT = "kind int, a long, c long, g int, many boolean, data binary"


class Bytes:
    """The bytes of some texts laid end to end."""

    def __init__(self, texts: list[str | None], window: int):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"".join(raw)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        flat = np.frombuffer(self.data, np.uint8)
        self.rolling = Rolling(mix(np.arange(1, 257, dtype=np.uint64))[flat])
        long = np.flatnonzero(self.sizes >= window)
        self.valid, _ = R.spread(self.offsets[long], self.offsets[long] + self.sizes[long] - window)

    def runs(self, window: int):
        """First start, last start, hash of the anchor, hash of the content of every run."""
        half = window // 2
        gram = self.rolling.every(half)
        first, last, anchor = R.runs(gram, self.valid, window - half + 1)
        return first, last, R.signed(gram[anchor]), R.signed(strong(self.data, first, last + window))

    def full(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows: the rolling hash, and the strong one of the bytes."""
        return R.signed(self.rolling.at(at, window)), R.signed(strong(self.data, at, at + window))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols at least, by prefix doubling; only unsettled ones are sorted again."""
    n = len(text)
    symbols, code = np.unique(text, return_inverse=True)
    bits = max(1, int(len(symbols)).bit_length())
    width = 63 // bits
    key = np.zeros(n + width, np.uint64)
    key[:n] = code.astype(np.uint64) + np.uint64(1)
    packed = np.zeros(n, np.uint64)
    for i in range(width):
        packed = (packed << np.uint64(bits)) | key[i : i + n]
    order = np.argsort(packed, kind="stable")
    sorted_ = packed[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # places in order that are not settled
    while len(at) and width < depth:
        own = order[at]
        follow = own + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[own]
        again = np.argsort(group * (n + 2) + second, kind="stable")
        own, group, second = own[again], group[again], second[again]
        order[at] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.concatenate([new[1:], [True]]))]
        width *= 2
    return order


def repeated_starts(text: np.ndarray, window: int) -> np.ndarray:
    """For each place of text (symbols; 0 ends a run): does its window start elsewhere too?"""
    n = len(text)
    order = suffix_order(text, window)
    last = text[order - 1]  # the transform; the first suffix is preceded by the closing 0
    by_symbol = np.argsort(last, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(window):
        if not len(low):
            break
        element, interval = R.spread(low, high - 1)
        ends = np.flatnonzero(following[element] >= high[interval])
        edge = lf[element[ends]] + 1
        fresh = unset[edge]
        unset[edge] = False
        begins = np.flatnonzero(preceding[element] < low[interval])
        start = lf[element[begins]]
        # A range of rows with one symbol before them maps to one range: begins and ends pair up in order.
        start.sort()
        both = np.argsort(edge, kind="stable")
        high = edge[both]
        fresh = fresh[both]
        low, high = start[fresh], high[fresh]
    deep = np.flatnonzero(unset)
    out = np.zeros(n, bool)
    out[order[deep]] = True
    out[order[deep - 1]] = True
    return out


def indexed(runs: pa.Table, window: int) -> pa.RecordBatch:
    """Which starts of the open runs repeat, by the index of all runs of their anchors."""
    raw = runs.column("data").to_pylist()
    sizes = np.array([len(x) for x in raw])
    offsets = np.cumsum(sizes + 1) - sizes - 1
    flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.int16) + 1
    flat[offsets + sizes] = 0
    hit = repeated_starts(flat, window)
    many = runs.column("many").to_numpy(zero_copy_only=False).astype(bool)
    g, a, c = (runs.column(x).to_numpy() for x in ("g", "a", "c"))
    rows, data = [], []
    for i in np.flatnonzero(~many).tolist():
        own = hit[offsets[i] : offsets[i] + sizes[i] - window + 1]
        if own.any():
            rows.append(i)
            data.append(np.packbits(own).tobytes())
    return R.reply(g[rows], np.full(len(rows), BITMAP), a[rows], c[rows], data)


def by_window(anchor: np.ndarray, content: np.ndarray, whole: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The runs whose windows are judged one by one: of those that do not repeat as a whole, the open ones (a, c) of hot anchors."""
    return np.flatnonzero(~whole & (R.lookup(anchor, content, a, c) >= 0))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, kept: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]): a row a document."""
    n = partitions(docs.sparkSession)
    dealt = R.blocks(docs, key, text)

    def anchors(g: int, bodies: list) -> Iterator[pa.RecordBatch]:
        a, c = [], []
        for _, part in pieces(bodies):
            _, _, anchor, content = Bytes(part, window).runs(window)
            a.append(anchor)
            c.append(content)
        yield R.request(g, *(lambda x, y, z: (x.view(np.uint64), y.view(np.uint64), z))(*R.folded(np.concatenate(a), np.concatenate(c))))

    asked = R.in_blocks(dealt, R.ROW, anchors).repartition(n, "a").sortWithinPartitions("a", "c", "g")
    known = asked.mapInArrow(lambda batches: R.judged_runs(batches, hot, HOT_BIT), R.REPLY)

    def contents(documents: pa.Table, replies: pa.Table) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        open_ = np.flatnonzero((kind & 3) != R.WHOLE)
        ka, kc = (replies.column(x).to_numpy()[open_] for x in ("a", "c"))
        g = documents.column("g")[0].as_py() if documents.num_rows else 0
        h1, h2, twice = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        done = np.zeros(len(open_), bool)
        rows: dict[str, list] = {"a": [], "c": [], "many": [], "data": []}
        for _, part in pieces(documents.column("text").to_pylist()) if len(open_) else ():
            held = Bytes(part, window)
            first, last, anchor, content = held.runs(window)
            row = R.lookup(anchor, content, ka, kc)
            mine = np.flatnonzero(row >= 0)
            state = kind[open_[row[mine]]]
            single = mine[state >= HOT_BIT]
            at, run = R.spread(first[single], last[single])
            x, y = held.full(at, window)
            h1.append(x)
            h2.append(y)
            twice.append((kind[open_[row[single]]] & 3 == R.SPEAKER)[run])
            for i, s in zip(mine.tolist(), state.tolist(), strict=True):
                if s < HOT_BIT and not done[row[i]]:
                    done[row[i]] = True
                    rows["a"].append(anchor[i])
                    rows["c"].append(content[i])
                    rows["many"].append(s == R.SPEAKER)
                    rows["data"].append(held.data[first[i] : last[i] + window])
        x, y, z = R.folded(np.concatenate(h1), np.concatenate(h2), np.concatenate(twice))
        m = len(rows["a"])
        return pa.table(
            {
                "kind": pa.array([0] * m + [1] * len(x), pa.int32()),
                "a": pa.array(np.concatenate([np.array(rows["a"], np.int64), x])),
                "c": pa.array(np.concatenate([np.array(rows["c"], np.int64), y])),
                "g": pa.array(np.full(m + len(x), g, np.int32)),
                "many": pa.array([*rows["many"], *z.tolist()], pa.bool_()),
                "data": pa.array(rows["data"] + [None] * len(x), pa.binary()),
            }
        )

    sent = R.with_replies(dealt, known, SENT, contents).repartition(n, "a").sortWithinPartitions("kind", "a", "c", "g")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in R.groups(batches, ["kind", "a"]):
            kind = table.column("kind").to_numpy()
            windows = int(np.searchsorted(kind, 1))
            if windows < len(kind):
                yield R.judged_windows(table.slice(windows), FOUND)
            own = table.slice(0, windows)
            if not windows:
                continue
            # Anchors stay together; a chunk ends with the anchor in which it reaches CHUNK bytes.
            a = own.column("a").to_numpy()
            ends = np.concatenate([np.flatnonzero(a[1:] != a[:-1]) + 1, [windows]])
            lengths = np.cumsum(pc.binary_length(own.column("data")).to_numpy())
            start = 0
            for end in ends.tolist():
                if size + lengths[end - 1] - (lengths[start - 1] if start else 0) >= CHUNK:
                    held.append(own.slice(start, end - start))
                    yield indexed(pa.concat_tables(held), window)
                    held, size, start = [], 0, end
            if start < windows:
                held.append(own.slice(start))
                size += int(lengths[-1] - (lengths[start - 1] if start else 0))
        if held:
            yield indexed(pa.concat_tables(held), window)

    told = known.where(F.col("kind").bitwiseAND(3).isin(R.WHOLE, R.SPEAKER) | (F.col("kind") >= HOT_BIT))
    replies = told.unionByName(sent.mapInArrow(settled, R.REPLY))

    def finish(documents: pa.Table, answers: pa.Table) -> pa.Table:
        kind, a, c = (answers.column(x).to_numpy() for x in ("kind", "a", "c"))
        maps = answers.column("data")
        single, marked = np.flatnonzero(kind == FOUND), np.flatnonzero(kind == BITMAP)
        full, hot = np.flatnonzero(np.isin(kind & ~HOT_BIT, (R.WHOLE, R.SPEAKER))), np.flatnonzero(kind == R.OPEN | HOT_BIT)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if kept else {})
        for _, part in pieces(documents.column("text").to_pylist()):
            held = Bytes(part, window)
            first, last, anchor, content = held.runs(window)
            whole = R.lookup(anchor, content, a[full], c[full]) >= 0
            at = [R.spread(first[whole], last[whole])[0]]
            row = R.lookup(anchor, content, a[marked], c[marked])
            for i in np.flatnonzero((row >= 0) & ~whole).tolist():
                bits = np.unpackbits(np.frombuffer(maps[int(marked[row[i]])].as_py(), np.uint8), count=last[i] - first[i] + 1)
                at.append(np.flatnonzero(bits) + first[i])
            if len(single):
                asked = by_window(anchor, content, whole, a[hot], c[hot])
                rest, _ = R.spread(first[asked], last[asked])
                x, y = held.full(rest, window)
                at.append(rest[R.lookup(x, y, a[single], c[single]) >= 0])
            gone = R.covered(np.unique(np.concatenate(at)), window, len(held.data))
            flat = np.frombuffer(held.data, np.uint8)
            for offset, size in zip(held.offsets.tolist(), held.sizes.tolist(), strict=True):
                mask = gone[offset : offset + size]
                removed = int(np.count_nonzero(mask))
                rest = flat[offset : offset + size][~mask].tobytes() if removed else held.data[offset : offset + size]
                out["n_bytes"].append(size)
                out["n_removed"].append(removed)
                out["n_spans"].append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if removed else 0)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if kept:
                    out["kept"].append(rest)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({"key": documents.column("key")} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    kind = dealt.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return R.with_replies(dealt, replies, schema, finish).withColumnRenamed("key", key)
