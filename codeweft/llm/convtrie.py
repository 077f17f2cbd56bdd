"""Prefix trie over rebuilt conversations, merged family by family.

A conversation c belongs to the family of its base c - c % `family` (remainders have the sign of c). It
is rebuilt: the first h turns of the base, h = crc32(decimal c) % `shared`, then its own turns after its
first h. Every distinct sequence of first d rebuilt turns is a node of depth d; the root has no turns.

1. Turns are sorted by conversation and turn over ranges of rows and numbered there; a conversation that
   spans ranges gets an offset. From here on a turn is a digest and a number of bytes: texts move once.
2. A cogroup by base id brings the first turns of the bases to the first `HEAD` turns of all members. A task holds
   `FAMILIES` neighbouring families, some 100 bytes a turn, and builds the small trie of each. The turns
   beyond are numbered on in segments of `SEGMENT` rows, so a conversation of any length is many tasks.
3. Only the combined nodes of families are shuffled and merged. A node is known by its depth and the sums,
   modulo 2**62, of two hashes of (turn digest, depth) over its path.

Sums over subtrees need no walk over the trie. The least member of a node owns it; what a conversation c
owns is the end of its path, after `lent(c)` bytes of nodes that smaller conversations own. Then
saved_tokens(v) is the sum of lent(c) over the members c of v but its owner, minus (members - 1) times the
bytes above v; n_leaves(v) is the number of members that own a childless node. Both are sums over members:
a second round of family sums, merged alike. The number of jobs does not depend on depth or branching.

The digest of a node's ends is made from id ranges: ids of one node are sorted and joined to pieces of
`CHUNK` ids over many tasks; only the pieces pass through one hash in order, one at a time.

Nulls: rows without conv_id take no part; null roles and texts are empty; turns are ordered by turn (null
first), then role, then text; equal rows all count. Very long texts are hashed where they are read and
count by their bytes. A conversation without turns of its own left ends where the base's turns end, or at
the root. An empty table has no nodes, not even the root. Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.llm.common import cut, whole_text

HEAD, FAMILIES, SEGMENT, CHUNK = 64, 256, 4096, 65_536
LANES = 1 << 62
KEY = ["depth", "a", "b"]
NODE = "base long, depth int, a long, b long, pa long, pb long, bytes long, path long, convs array<long>, ends array<long>, open array<long>"


def numbered(frame: DataFrame) -> DataFrame:
    """(conv, part, at, turn, bytes): the turns of range `part`, numbered from 1 within it for each conversation."""
    rows = frame.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("t"), whole_text("role").alias("role"), whole_text("text").alias("text")).where("conv is not null")
    order = [F.asc("conv"), F.asc_nulls_first("t"), F.asc("role"), F.asc("text")]
    digest = F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    lined = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("part"), digest.alias("turn"), F.octet_length("text").cast("long").alias("bytes"))

    def number(batches):
        last, seen = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if len(conv):
                first = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
                at = np.arange(1, len(conv) + 1) - np.repeat(first, np.diff(np.append(first, len(conv))))
                if conv[0] == last:
                    at[: first[1] if len(first) > 1 else len(at)] += seen
                last, seen = conv[-1], int(at[-1])
                yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(at), batch.column("turn"), batch.column("bytes")], names=["conv", "part", "at", "turn", "bytes"])

    return cut(lined.mapInArrow(number, "conv long, part int, at long, turn string, bytes long"))


def pieces(turns: DataFrame, family: int, shared: int) -> DataFrame:
    """One row for each conversation and range: what numbers its turns there and rebuilds it.

    before: its turns in earlier ranges; n: all its turns; taken: how many turns of the base come first;
    shift: what a later turn's place loses; length: turns when rebuilt.
    """
    base = F.col("conv") - F.col("conv") % family
    counted = turns.groupBy(base.alias("base"), "conv", "part").agg(F.max("at").alias("here")).repartition("base")
    own, kin = W.partitionBy("base", "conv"), W.partitionBy("base")
    earlier = F.sum("here").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    h = F.crc32(F.col("conv").cast("string")) % shared
    out = counted.withColumns({"n": F.sum("here").over(own), "before": F.coalesce(earlier, F.lit(0)), "h": h})
    out = out.withColumn("taken", F.least("h", F.coalesce(F.max(F.when(F.col("conv") == F.col("base"), F.col("n"))).over(kin), F.lit(0))))
    return cut(out.withColumns({"shift": F.col("h") - F.col("taken"), "length": F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))}))


def lanes(depth: Column) -> list[Column]:
    """Two hashes, of 62 bits, of a turn at a depth."""
    depth = depth.cast("long")
    return [F.xxhash64("turn", depth).bitwiseAND(F.lit(LANES - 1)).alias("a"), F.xxhash64(depth, F.lit("path"), "turn").bitwiseAND(F.lit(LANES - 1)).alias("b")]


def lists(of: np.ndarray, chosen: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """The chosen values as one list a group; groups ascend."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(group[chosen], minlength=groups))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(of[chosen]))


def family_tries(bases: pa.Table, members: pa.Table) -> pa.Table:
    """The nodes of each family in a block: bases (base, at, a, b, bytes); members (conv, base, depth, a, b,
    bytes, taken, length, cut), with one row of depth 0 for each conversation, which holds the last three."""
    get = lambda t, c: t.column(c).to_numpy()
    depth = get(members, "depth")
    root = np.flatnonzero(depth == 0)
    taken = get(members, "taken")[root]
    order = np.lexsort([get(bases, "at"), get(bases, "base")])
    start = np.searchsorted(get(bases, "base")[order], get(members, "base")[root])
    within = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
    copied = order[np.repeat(start, taken) + within]
    columns = {c: np.concatenate([get(members, c), get(bases, c)[copied]]) for c in ("a", "b", "bytes")}
    columns["depth"] = np.concatenate([depth, within + 1])
    columns |= {c: np.concatenate([get(members, c), np.repeat(get(members, c)[root], taken)]) for c in ("conv", "base", "length", "cut")}
    order = np.lexsort([columns["depth"], columns["conv"]])
    columns = {c: v[order] for c, v in columns.items()}
    first = np.flatnonzero(columns["depth"] == 0)
    size = np.diff(np.append(first, len(order)))
    columns |= {c: np.repeat(columns[c][first], size) for c in ("length", "cut")}
    along = lambda v: (total := np.cumsum(v)) - np.repeat(total[first], size)  # noqa: E731  the root's share is 0
    for lane in "ab":
        columns[lane] = (along(columns[lane].astype(np.uint64)) & np.uint64(LANES - 1)).astype(np.int64)
        columns["p" + lane] = np.concatenate([[0], columns[lane][:-1]])
        columns["p" + lane][first] = 0
    columns["path"] = along(columns["bytes"])
    order = np.lexsort([columns[c] for c in ("conv", "b", "a", "depth", "base")])
    columns = {c: v[order] for c, v in columns.items()}
    new = np.concatenate([[True], np.any([np.diff(columns[c]) != 0 for c in ("base", "depth", "a", "b")], axis=0)])
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    ended, goes_on = columns["depth"] == columns["length"], columns["depth"] == columns["cut"]
    out = {c: pa.array(columns[c][head]) for c in ("base", "depth", "a", "b", "pa", "pb", "bytes", "path")}
    out["depth"] = out["depth"].cast(pa.int32())
    for name, chosen in (("convs", np.ones(len(group), bool)), ("ends", ended), ("open", goes_on)):
        out[name] = lists(columns["conv"], chosen, group, len(head))
    return pa.table(out)


def long_tails(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes beyond `HEAD` own turns, one member each: sums go on from the last node of the head, segment by segment."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    tail = rows.where(F.col("at") > HEAD).select("conv", "base", "length", (F.col("at") / SEGMENT).cast("long").alias("segment"), (F.col("at") - F.col("shift")).alias("depth"), "turn", "bytes")
    tail = tail.select("*", *lanes(F.col("depth")))
    sums = tail.groupBy("conv", "segment").agg(*[F.sum(wide(c)).alias(f"all_{c}") for c in ("a", "b", "bytes")])
    before = W.partitionBy("conv").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv", "segment", *[F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"sum_{c}") for c in ("a", "b", "bytes")])
    start = heads.where(F.size("open") > 0).select(F.explode("open").alias("conv"), F.col("a").alias("from_a"), F.col("b").alias("from_b"), F.col("path").alias("from_bytes"))
    sums = cut(sums.join(start, "conv").select("conv", "segment", *[(F.col(f"sum_{c}") + wide(f"from_{c}")).alias(f"sum_{c}") for c in ("a", "b", "bytes")]))
    so_far = W.partitionBy("conv", "segment").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = lambda c: F.sum(wide(c)).over(so_far) + F.col(f"sum_{c}")
    held = lambda x: F.pmod(x, F.lit(LANES).cast("decimal(20,0)")).cast("long")
    out = tail.join(sums, ["conv", "segment"]).select("*", *[total(c).alias(f"to_{c}") for c in ("a", "b", "bytes")])
    me, none = F.array("conv"), F.array().cast("array<long>")
    return out.select(
        "base", F.col("depth").cast("int").alias("depth"), *[held(F.col(f"to_{c}")).alias(c) for c in "ab"], *[held(F.col(f"to_{c}") - wide(c)).alias("p" + c) for c in "ab"], "bytes",
        F.col("to_bytes").cast("long").alias("path"), me.alias("convs"), F.when(F.col("depth") == F.col("length"), me).otherwise(none).alias("ends"), none.alias("open"),
    )


def family_nodes(frame: DataFrame, family: int, shared: int) -> DataFrame:
    """The nodes of all families, each with its members and those that end there."""
    turns = numbered(frame)
    known = pieces(turns, family, shared)
    rows = turns.join(known.select("conv", "part", "base", "before", "h", "shift", "length", "taken"), ["conv", "part"]).withColumn("at", F.col("at") + F.col("before"))
    block = F.floor(F.col("base") / (FAMILIES * family)).alias("block")
    bases = rows.where((F.col("conv") == F.col("base")) & (F.col("at") < shared)).select(block, *[F.col(c).alias(c) for c in ("base", "at")], *lanes(F.col("at")), F.col("bytes").alias("bytes"))
    last = F.when(F.col("n") > HEAD, HEAD - F.col("shift")).otherwise(-1).alias("cut")
    roots = known.where("before = 0").select(block, "conv", "base", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")], "taken", "length", last)
    own = rows.where((F.col("at") > F.col("h")) & (F.col("at") <= HEAD)).withColumn("depth", F.col("at") - F.col("shift"))
    none = [F.lit(0).cast("long").alias(c) for c in ("taken", "length", "cut")]  # a root row says them for its conversation
    members = roots.unionByName(own.select(block, "conv", "base", "depth", *lanes(F.col("depth")), "bytes", *none))
    heads = cut(bases.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(family_tries, NODE))
    return cut(heads.unionByName(long_tails(rows, heads)))


def merged(nodes: DataFrame) -> DataFrame:
    """Global nodes from those of families, with the number of their children."""
    whole = cut(nodes.groupBy(*KEY).agg(F.sum(F.size("convs")).alias("n_convs"), F.min(F.array_min("convs")).alias("least"), *[F.max(c).alias(c) for c in ("pa", "pb", "bytes", "path")]))
    children = whole.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    return cut(whole.join(children, KEY, "left").fillna(0, "n_children"))


def owners(nodes: DataFrame) -> DataFrame:
    """(conv, from_depth, lent, leaf, above): where each owner's part of its path starts, the bytes before it, whether
    it ends in a childless node, and the owner of the node above."""
    part = nodes.groupBy(F.col("least").alias("conv")).agg(F.min(F.struct("depth", "pa", "pb", (F.col("path") - F.col("bytes")).alias("lent"))).alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    part = cut(part.select("conv", F.col("top.depth").alias("from_depth"), (F.col("top.depth") - 1).alias("depth"), F.col("top.pa").alias("a"), F.col("top.pb").alias("b"), F.col("top.lent").alias("lent"), "leaf"))
    above = nodes.select(*KEY, F.col("least").alias("above"))
    return cut(part.join(above, KEY, "left").select("conv", "from_depth", "lent", "leaf", "above"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv): ids ascending, in decimal, comma-joined."""
    schema = ends.select(*KEY).schema
    order = [*KEY, "conv"]

    def joined(batches):
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in KEY], axis=1)
            if not len(key):
                continue
            conv = batch.column("conv").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.any(np.diff(key, axis=0) != 0, axis=1)) + 1])
            edges = sorted({*first.tolist(), *range(0, len(key), CHUNK), len(key)})
            text = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(edges, edges[1:], strict=False)]
            at = np.array(edges[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in KEY), pa.array(conv[at]), pa.array(text)], names=[*KEY, "conv", "ids"])

    def hashed(batches):
        last, state = None, None
        rows: list[tuple] = []
        for batch in batches:
            for *key, _, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv", "ids")), strict=True):
                if key == last:
                    state.update(b"," + ids.encode())
                else:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if last is not None:
            rows.append((*last, state.hexdigest()))
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{fields}, conv long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashed, f"{fields}, ends_sha256 string")


def build(frame: DataFrame, *, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node."""
    if not 0 < shared <= HEAD:
        raise ValueError(f"shared is 1 to {HEAD}")
    nodes = family_nodes(frame, family, shared)
    whole = merged(nodes)
    own = owners(whole)
    ends = nodes.where(F.size("ends") > 0).select("base", *KEY, "path", F.explode("ends").alias("conv"))
    # At most 2 * family - 1 conversations share a base.
    told = ends.select("base", "conv", "path").join(own.select("conv", "lent", "leaf"), "conv", "left")
    told = told.select("base", F.struct("conv", F.coalesce("lent", "path").alias("lent"), F.coalesce("leaf", F.lit(0)).alias("leaf")).alias("x"))
    told = cut(told.groupBy("base").agg(F.collect_list("x").alias("x")))
    here = F.filter("x", lambda x: F.array_contains("convs", x["conv"]))
    total = lambda c: F.aggregate(here, F.lit(0).cast("long"), lambda s, x: s + x[c])
    sums = nodes.select("base", *KEY, "convs").join(told, "base").groupBy(*KEY).agg(F.sum(total("lent")).alias("lent"), F.sum(total("leaf")).alias("n_leaves"))
    mine = own.select(F.col("conv").alias("least"), F.col("lent").alias("own_lent"), "from_depth", "above")
    out = whole.join(sums, KEY).join(end_digests(ends.select(*KEY, "conv")), KEY, "left").join(mine, "least")
    return out.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("from_depth"), F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("lent") - F.col("own_lent") - (F.col("n_convs") - 1) * (F.col("path") - F.col("bytes"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
