"""Groups of texts whose shingle sets have a Jaccard similarity of at least 0.8, all of them.

Sets. Words of the whole text (ASCII lower case) make k-word shingles; a text with fewer than k words
is one shingle. A set holds the XXH64 of its shingles. Equal sets are folded first, and the empty set
(a text without words) is a class of its own.

First links. A 64-bit SimHash of each set goes through the Gray-order index of `simhash`; sets whose
fingerprints are equal or differ in `NEAR` bits at most are tested. That finds close copies and keeps
large groups of them from being compared pair by pair, but misses others near the bound.

All links. Sets of n and m shingles reach 0.8 only if 9 * shared >= 4 * (n + m), so both have a
shingle in common among their first n // 5 + 1 in any order that all documents share (prefix filter);
the places of the first such shingle bound what can be shared behind it (positional filter). Rare
shingles come first here: of those whose hash is in the lower `COUNTED` of its range the number of
sets that have them is counted over all sets, the others follow by hash. Shingles of one set alone
lead to no pair and are dropped. No pair is missed, whatever the order and the number of documents.

Every link is verified by the true Jaccard similarity, in whole numbers. Members of a shared shingle
are first compared with four leaders, in two rounds if the first pays, so that a large group of near
copies costs a few rows a member. What remains of different components meets by shingle and class of
size: a set looks for partners no larger than itself, in the classes that the place of the shingle still
allows, so sets that share a passage too late in their prefixes do not meet at all. Pairs whose parity
sketches (bits that an odd number of a set's shingles fall on) differ in more bits than the sets may differ
in shingles go; the others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.llm.common import cut
from codeweft.llm.graph import components
from codeweft.llm.simhash import bands, edges

SEED = 42
NEAR, COUNTED, ROUNDS, LEADERS, PARTS = 3, 0.35, 2, 4, 16
#: The largest hash of all and the largest that is counted first, as the signed numbers that Spark compares.
ALL = (1 << 63) - 1
LAST = int(COUNTED * (1 << 64)) - (1 << 63)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds the shingles of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, end = b" ".join(words), [], -1
    for word in words:
        end += len(word) + 1
        ends.append(end)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :] or ends[-1:], strict=False)], np.uint64))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """A Jaccard similarity of 0.8 or more, of sorted sets."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _folded(rows: DataFrame, k: int) -> DataFrame:
    """(key, row, print, fp): 128 bits of the set, empty for the empty set, and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingles(t, k) for t in batch.column(2).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
            made = [pa.array(prints, pa.binary()), pa.array([voted(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "row", "print", "fp"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "row")]
    return rows.mapInArrow(run, ", ".join([*kinds, "print binary, fp binary"]))


def voted(hashes: np.ndarray) -> bytes:
    """The SimHash of a set: bits that over half of its hashes set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def _tokens(texts: DataFrame, k: int, last: int, counts: bool) -> DataFrame:
    """(token, node, size) of the shingles that are counted or in a prefix by hash; or (token, c) a batch.

    Tokens keep the order of the hashes; size is n and how many of the n are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            token, node, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (shingles(t, k) ^ np.uint64(1 << 63)).view(np.int64)
                low = int(np.searchsorted(own, last, side="right"))
                first = own[: max(low, len(own) // 5 + 1)]
                token.append(first)
                if not counts:
                    node.append(np.full(len(first), i))
                    size.append(np.full(len(first), len(own) << 32 | low))
            if counts:
                made = np.unique(np.concatenate(token), return_counts=True)
            else:
                made = [np.concatenate(c) for c in (token, node, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["token", "c"] if counts else ["token", "node", "size"])

    return texts.select("node", "text").mapInArrow(run, "token long, c long" if counts else "token long, node long, size long")


def _prefixes(texts: DataFrame, k: int, last: int) -> DataFrame:
    """(token, node, n, at): of the first n // 5 + 1 shingles of each set, rare ones first, those that others have, with their places."""
    # Combined map-side, then a table: its true size decides the join, and hot shingles can be split there.
    shared = cut(_tokens(texts, k, last, True).groupBy("token").agg(F.sum("c").alias("c")).where("c > 1"))
    every = cut(_tokens(texts, k, last, False).join(shared, "token"))
    low = F.col("token") <= last
    own = W.partitionBy("node")
    every = every.withColumns(
        {
            "lows": F.count_if(low).over(own),
            "place": F.row_number().over(own.orderBy(~low, F.when(low, F.col("c")), "token")),
            "n": F.shiftright("size", 32).cast("int"),
            "counted": F.col("size").bitwiseAND((1 << 32) - 1),
        }
    )
    # Shingles of one set alone come first among the counted; behind them the place is a lower bound.
    at = F.when(low, F.col("counted") - F.col("lows") + F.col("place") - 1).otherwise(F.col("counted") + F.col("place") - F.col("lows") - 1)
    return every.select("token", "node", "n", at.cast("int").alias("at")).where(F.col("at") <= F.floor(F.col("n") / 5))


def _fits(n: str, at: str, m: str, to: str):
    """Whether sets of n and m whose first common shingle is at these places can reach 0.8."""
    rest = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to))
    return rest * 9 >= (F.col(n) + F.col(m)) * 4


def _sizes(n: Column) -> Column:
    """The class of a set's size: some 5 % wide, so a size and four fifths of it are at most five classes apart."""
    return F.floor(F.log(n.cast("double")) * 20).cast("int")


def _sketches(texts: DataFrame, k: int) -> DataFrame:
    """(node, s0, s1, ...): bits that an odd number of the set's shingles fall on. Two sets differ in more shingles than bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = np.zeros((batch.num_rows, PARTS), np.int64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                odd = np.bincount((shingles(t, k) % np.uint64(64 * PARTS)).astype(np.int64), minlength=64 * PARTS) & 1
                made[i] = np.packbits(odd.astype(bool)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T.copy())], names=["node", *(f"s{i}" for i in range(PARTS))])

    return texts.select("node", "text").mapInArrow(run, "node long, " + ", ".join(f"s{i} long" for i in range(PARTS)))


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) with `ok`, the true comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(256)(lambda t: shingles(t, k))
        for batch in parts(batches):
            ok = [alike(held(x), held(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long, ok boolean")


def _links(texts: DataFrame, k: int) -> DataFrame:
    """(node, root) of all nodes that are linked to another."""
    tested = roots = None

    def tried(pairs: DataFrame) -> tuple[int, int]:
        """Tests what was not yet tested; how many pairs, and how many of them are links."""
        nonlocal tested, roots
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        found = cut(_verified(cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")), near, k))
        count, new = found.agg(F.count("*"), F.count_if("ok")).first()
        tested = found if tested is None else tested.unionByName(found)
        if new:
            roots = cut(components(tested.where("ok").select("a", "b")))
        return count, new

    def rooted(rows: DataFrame) -> DataFrame:
        """With the root of each node as it is now known."""
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        named = roots.select(F.col("node").alias("x"), F.col("root").alias("r"))
        return rows.join(named, F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("r", "node")).drop("x", "r")

    def still_open(rows: DataFrame) -> DataFrame:
        """Without the tokens whose nodes are all in one component."""
        mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        return rows.join(mixed, "token", "left_semi")

    worded = texts.where("print != X''").select("node", "fp")
    one = cut(worded.groupBy("fp").agg(F.min("node").alias("other")))
    close = edges(one.select("fp"), NEAR, bands(64, NEAR + 1))
    ends = [one.select(F.col("fp").alias(c), F.col("other").alias(n)) for c, n in (("a", "node"), ("b", "other"))]
    close = close.join(ends[0], "a").join(ends[1], "b").select("node", "other")
    close = cut(close.unionByName(worded.join(one, "fp").where("node != other").select("node", "other")))
    prefixes = cut(_prefixes(texts, k, LAST))
    nodes = prefixes.select("node").unionByName(close.select("node")).unionByName(close.select(F.col("other").alias("node"))).distinct()
    near = cut(texts.select("node", "text").join(cut(nodes), "node", "left_semi"))
    # Only these can be in a pair: with their own counts, of all shingles, the places bound more.
    held = cut(_prefixes(near, k, ALL).withColumn("root", F.col("node")))
    others = [F.col(c).alias(d) for c, d in (("node", "other"), ("n", "m"), ("at", "to"), ("root", "its"))]
    for number in range(ROUNDS):
        leader = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), *others))
        leaders = F.array(*[leader(number * LEADERS + i) for i in range(LEADERS)])
        lead = held.groupBy("token").agg(leaders.alias("l")).select("token", F.explode("l").alias("l"))
        lead = cut(lead.select("token", "l.other", "l.m", "l.to", "l.its").distinct())
        pairs = held.join(lead, "token").where((F.col("root") != F.col("its")) & _fits("n", "at", "m", "to")).select("node", "other")
        count, new = tried(pairs if number else pairs.unionByName(close))
        if new:
            held = cut(still_open(rooted(held.drop("root"))))
        if new * 10 < count or not new:  # leaders no longer pay
            break
    held = held.join(cut(_sketches(near, k)), "node")
    other = held.select("token", *others, *[F.col(f"s{i}").alias(f"t{i}") for i in range(PARTS)])
    apart = reduce(add, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(PARTS)])
    larger = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("other")))
    open_ = larger & (F.col("root") != F.col("its")) & _fits("n", "at", "m", "to") & (apart * 9 <= F.col("n") + F.col("m"))
    # A set of n meets sets of m <= n only where m is at least 0.8 n and 9 * (n - at) >= 4 * (n + m) leaves room for them.
    least, most = F.ceil(F.col("n") * 0.8), F.least(F.col("n"), F.floor((F.col("n") * 5 - F.col("at") * 9) / 4))
    asking = held.where(least <= most).withColumn("sizes", F.explode(F.sequence(_sizes(least), _sizes(most))))
    tried(asking.join(other.withColumn("sizes", _sizes(F.col("m"))), ["token", "sizes"]).where(open_))
    return roots if roots is not None else texts.sparkSession.createDataFrame([], "node long, root long")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """One row of docs (of the least key, null before all) for each group that links join, directly or not.

    Rows equal in key and text are one document: any one of them stays. Input columns of any name are
    kept as they are. Whole rows are shuffled once, to fold equal sets; what goes is a list of numbers.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    body = F.col(names[docs.columns.index(text)]).cast("string")
    id_ = F.col(names[docs.columns.index(key)])
    rows = inner.select(F.struct(id_.isNotNull().alias("some"), id_.alias("id"), F.xxhash64(body).alias("at")).alias("key"), F.struct(*names).alias("row"), body.alias("text"))
    folded = _folded(rows, k).groupBy("print", "fp").agg(F.min("key").alias("key"), F.min_by("row", "key").alias("row"))
    whole = cut(folded.select(F.monotonically_increasing_id().alias("node"), "key", "print", "fp", "row"))
    texts = whole.select("node", "print", "fp", F.col(f"row.{names[docs.columns.index(text)]}").cast("string").alias("text"))
    linked = _links(texts, k).join(whole.select("node", "key"), "node")
    first = linked.groupBy("root").agg(F.min_by("node", "key").alias("first"))
    gone = cut(linked.join(first, "root").where("node != first").select("node"))  # its true size decides the join
    return whole.join(gone, "node", "left_anti").select("row.*").toDF(*docs.columns)
