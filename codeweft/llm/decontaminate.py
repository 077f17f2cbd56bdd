"""Benchmark decontamination: a prefix-filtered set join of item windows with document windows.

Words are runs of ASCII letters, digits and non-ASCII characters, in ASCII lower case. A window is
`size` consecutive words of an item; a shorter item is one window. A window's set is its shingles of
up to `SHINGLE` words. Since a match must contain all of them, one necessary prefix token is enough:
the window's rarest shingle by its count over all documents (ties: the earliest in the window).

First pass: shingles of the benchmark are counted in every document (a count a task and shingle,
summed by Spark). Second pass: each document word position whose shingle is a prefix token is a
candidate; the token's place in the window fixes where the window would start (positional bound),
it must fit in the document (length bound), and its words are compared for equality of 64-bit
sequence hashes, then of bytes. Only verified windows count.

The benchmark is read to the driver in chunks of `CHUNK` windows at most, each broadcast on its own
(some 20 MB); documents are mapped, never shuffled, so frequent tokens skew nothing.

Nulls: a null text has no words; an item without words has no windows; null item ids match like
others and are left out of the list of items. Repeated rows are judged alike. An empty benchmark
hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.sequences import Words, pieces

SIZE, SHINGLE, CHUNK, ROWS = 10, 3, 100_000, 1024
#: Bytes that are in words (digits, lower-case letters, all of non-ASCII), and folding.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def windows(items: list[tuple], size: int) -> dict[bytes, tuple[int, dict]]:
    """Words of each window -> its width and the items that have it."""
    found: dict[bytes, tuple[int, dict]] = {}
    for item, text in items:
        words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
        width = min(size, len(words))
        for at in range(len(words) - width + 1) if width else ():
            found.setdefault(b" ".join(words[at : at + width]), (width, {}))[1][item] = True
    return found


def _shingles(keys: list[bytes], widths: list[int]):
    """Hash, window and place of every shingle of the windows."""
    held = Words(FOLD, [k.decode("utf-8", "surrogatepass") for k in keys])
    first = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
    hashes, owner, place = [], [], []
    for i, (at, width) in enumerate(zip(first, widths, strict=True)):
        k = min(SHINGLE, width)
        n = width - k + 1
        hashes.append(held.hashes(np.arange(at, at + n), k))
        owner.append(np.full(n, i))
        place.append(np.arange(n))
    return held, first, np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)


def _bitmap(sorted_hashes: np.ndarray) -> np.ndarray:
    """A table over the top 22 bits: most words of a document fall outside at once."""
    table = np.zeros(1 << 22, bool)
    table[sorted_hashes >> np.uint64(42)] = True
    return table


def _seen(held: Words, sizes: list[int], wanted: np.ndarray, table: np.ndarray):
    """For each shingle width: positions whose shingle is wanted, and which one."""
    for k in sizes:
        at = held.fits(k)
        h = held.hashes(at, k)
        maybe = np.flatnonzero(table[h >> np.uint64(42)])
        place = np.searchsorted(wanted, h[maybe])
        real = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == h[maybe])
        yield k, at[maybe[real]], place[real]


def count_shingles(docs: DataFrame, text: str, vocabulary: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each shingle of the (bounded) vocabulary occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        table, total = _bitmap(wanted), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0).to_pylist()):
                for _, _, which in _seen(Words(FOLD, part), sizes, wanted, table):
                    total += np.bincount(which, minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    return {row.i: row.n for row in counts.collect()}  # at most one row a shingle of the chunk


def _chunks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[dict]:
    """The benchmark's windows, in pieces of CHUNK at most: items are dealt by a hash."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t"))
    upper = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0  # a word and its gap take two characters
    parts = int(upper // CHUNK) + 1
    for part in range(parts):
        found = windows([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).toLocalIterator()], size)
        if found:
            yield found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE
) -> DataFrame:
    """Columns `keep` of docs with n_words, n_hit, items (sorted strings; they replace columns so named)."""
    made = ["n_words", "n_hit", "items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    found = _judged(docs, benchmark, keep, text, item, item_text, size)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made)


def _judged(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item: str, item_text: str, size: int) -> DataFrame:
    """Columns `keep` as k0, k1, ... with n_words, n_hit and items."""
    context = docs.sparkSession.sparkContext
    sent = []
    for found in _chunks(benchmark, item, item_text, size):
        keys = list(found)
        widths = [found[k][0] for k in keys]
        held, first, hashes, owner, place = _shingles(keys, widths)
        sizes = sorted({min(SHINGLE, w) for w in widths})
        vocabulary, which = np.unique(hashes, return_inverse=True)
        counts = count_shingles(docs, text, vocabulary, sizes)
        rarity = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)[which]
        order = np.lexsort([place, rarity, owner])
        prefix = order[np.concatenate([[True], np.diff(owner[order]) > 0])]  # each window's rarest shingle
        prefix = prefix[rarity[prefix] > 0]  # a window whose rarest shingle is nowhere occurs nowhere
        prefix = prefix[np.argsort(hashes[prefix], kind="stable")]
        tokens, start = np.unique(hashes[prefix], return_index=True)
        whole = held.hashes(first, np.array(widths)) if keys else np.zeros(0, np.uint64)
        sent.append(
            context.broadcast(
                {
                    "tokens": tokens,
                    "start": np.concatenate([start, [len(prefix)]]),
                    "window": owner[prefix],
                    "place": place[prefix],
                    "width": np.array(widths),
                    "whole": whole,
                    "keys": keys,
                    "items": [[str(i) for i in found[k][1] if i is not None] for k in keys],
                    "sizes": sizes,
                }
            )
        )

    own = keep.index(text) if text in keep else -1  # a text that is kept is sent once

    def mark(part: list) -> tuple[np.ndarray, np.ndarray, list[set]]:
        held = Words(FOLD, part)
        cover = np.zeros(len(held.starts) + 1, np.int32)
        items: list[set] = [set() for _ in part]
        for one in sent:
            b = one.value
            if not len(b["tokens"]):
                continue
            table = b.setdefault("table", None)
            if table is None:
                table = b["table"] = _bitmap(b["tokens"])
            for _, at, token in _seen(held, b["sizes"], b["tokens"], table):
                many = b["start"][token + 1] - b["start"][token]
                row = np.repeat(np.arange(len(at)), many)
                entry = np.repeat(b["start"][token], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                window, begin = b["window"][entry], at[row] - b["place"][entry]
                end = begin + b["width"][window]
                ok = (begin >= 0) & (end <= len(held.starts))
                ok[ok] = held.text_of[begin[ok]] == held.text_of[end[ok] - 1]
                window, begin, end = window[ok], begin[ok], end[ok]
                same = held.hashes(begin, end - begin) == b["whole"][window]
                for w, s, e in zip(window[same].tolist(), begin[same].tolist(), end[same].tolist(), strict=True):
                    if held.bytes_at(s, e - s) == b["keys"][w]:
                        cover[s] += 1
                        cover[e] -= 1
                        items[held.text_of[s]].update(b["items"][w])
        hit = np.cumsum(cover[:-1]) > 0
        return held.counts, np.bincount(held.text_of[hit], minlength=len(part)), items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices of the batch: neither its texts as objects nor the rows made of it stand at once.
            for begin in range(0, batch.num_rows, ROWS):
                some = batch.slice(begin, ROWS)
                n_words, n_hit, items = [], [], []
                for _, part in pieces(some.column(own).to_pylist()):
                    counts, hits, found = mark(part)
                    n_words += counts.tolist()
                    n_hit += hits.tolist()
                    items += [sorted(x) for x in found]
                made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *made], names=[*(f"k{i}" for i in range(len(keep))), "n_words", "n_hit", "items"])

    more = [F.col(text).cast("string").alias("__text")] if own < 0 else []
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *more)
    schema = "".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return rows.mapInArrow(run, schema + "n_words long, n_hit long, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns."""
    passed = _judged(docs, benchmark, docs.columns, "text", "item_id", "text", SIZE).where("n_hit = 0")
    return passed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
