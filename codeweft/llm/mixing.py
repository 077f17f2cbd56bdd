"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Each source gets a target of words. Documents have unequal probabilities: a document is expected in the
mix `level` * `measure` times, up to `cap`, where its measure falls with the bits of its number of words
(a mix of few long texts is less varied), and the level of its source is such that the expected words
are the target. The whole part of the expected copies is certain. For the rest, each document draws U
from its id and has the inclusion odds p/(1-p), p being its own fractional part; documents are ranked by
their random odds over their inclusion odds, Q = (U/(1-U)) / (p/(1-p)), and the lowest ranks are taken
until their words come nearest to what the source still lacks (at most half of one document off). The
sample is thus fixed by size in words. Ties in Q go by id, then size; copies of a row tie and are
interchangeable.

No source is sorted as a whole: v = Q/(1+Q) falls in one of `BINS` bins; words per (source, bin) are
summed map-side, and only the one bin in which a source's sample ends is ranked, rows that are equal in
(Q, id, size) folded to a count. What comes out is a row a source: the last document taken. Each
document is then judged where it is; only rows equal to a source's last one, if some of them are taken
and some are not, are numbered. So neither sizes nor texts are shuffled by source.

Nulls: a null text has size 0; a null source is a source, last in order; a null id draws like an
empty string. A source without words gets target 0. No document is taken more than `cap` times. An empty table gives an empty result. Other input
columns of any name are left alone; `copies` replaces an input column so named (in `mixed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.llm.common import WORD, cut

BINS = 4096
SEED = "mix"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)).cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size, target) by water-filling; a row a source, ordered in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    totals = totals.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    by_cap = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    level = totals.withColumns(
        {
            "place": F.row_number().over(by_cap),
            "capped": F.coalesce(F.sum("most").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
            "all": F.sum("source_size").over(W.partitionBy()),
        }
    ).withColumn("level", (F.col("all") * F.lit(share) - F.col("capped")) / F.col("open"))
    fits = F.col("most") > F.col("level") * F.col("weight")
    every = W.partitionBy()
    level = level.withColumn("first", F.min(F.when(fits, F.col("place"))).over(every))
    level = level.withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(every))
    target = F.when(F.col("place") >= F.col("first"), F.col("final") * F.col("weight")).otherwise(F.col("most").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def measure(size: Column) -> Column:
    """What a document's expected copies are proportional to: 60 for one word, 8 for 8192 and more."""
    return F.greatest(64 - 4 * F.length(F.bin(size)), F.lit(8)).cast("long")


def expected(light: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """(of, kind, source_size, target, whole, part, lack): copies of each source's documents by their measure.

    Water-filling within a source, over its few measures from the largest down: those that the level lifts beyond
    `cap` copies stay at it, and the level is what the others then need.
    """
    kinds = light.groupBy("source", F.col("measure").alias("kind")).agg(F.sum("size").alias("held"))
    kinds = kinds.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    every, down = W.partitionBy("source"), W.partitionBy("source").orderBy(F.desc("kind"))
    full = F.coalesce(F.sum("held").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * cap
    open_ = F.sum(F.col("held") * F.col("kind")).over(down.rowsBetween(0, W.unboundedFollowing))
    kinds = kinds.withColumns({"place": F.row_number().over(down), "level": F.when(open_ > 0, (F.col("target") - full) / open_)})
    kinds = kinds.withColumn("first", F.min(F.when(F.col("level") * F.col("kind") <= cap, F.col("place"))).over(every))
    kinds = kinds.withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(every))
    copies = F.when(F.col("source_size") == 0, 0.0).when(F.col("first").isNull() | (F.col("place") < F.col("first")), float(cap)).otherwise(F.col("final") * F.col("kind"))
    kinds = kinds.withColumn("whole", F.floor(copies)).withColumn("part", copies - F.col("whole"))
    kinds = kinds.withColumn("lack", F.col("target") - F.sum(F.col("whole") * F.col("held")).over(every))
    return kinds.select("of", "kind", "source_size", "target", "whole", "part", "lack")


def drawn(key: Column) -> Column:
    """U of a document, between 0 and 1."""
    random = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 12), 16, 10)
    return (random.cast("double") + 0.5) / F.lit(float(1 << 48))


def ranked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rows` with what is known of their source, their rank q (null where no document is drawn) and its bin."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    # Names differ on the two sides: the source may be null, and the join must keep that row.
    joined = rows.join(wanted, F.col("source").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("kind"))).drop("of", "kind").withColumn("q", F.when(F.col("part") > 0, odds))
    return joined.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))


def ends(light: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` with the place where each source's sample ends: the bin, and in it the last document taken,
    of whose equals (`same` in all) so many are taken. A row a source and measure."""
    placed = ranked(light, wanted).where("q is not null")
    bins = placed.groupBy("source", "bin", "lack").agg(F.sum("size").alias("held"))
    running = W.partitionBy("source").orderBy("bin")
    edges = (
        bins.withColumn("upto", F.sum("held").over(running))
        .where((F.col("upto") > F.col("lack")) & (F.col("upto") - F.col("held") <= F.col("lack")))
        .groupBy(F.col("source").alias("edge_of"))
        .agg(F.min("bin").alias("edge"), F.min_by(F.col("upto") - F.col("held"), F.col("bin")).alias("before"))
    )
    # A table, here and below: its true size decides whether it is broadcast, and documents stay where they are.
    edges = cut(edges)
    inside = placed.join(edges, F.col("source").eqNullSafe(F.col("edge_of")) & (F.col("bin") == F.col("edge")))
    equal = inside.groupBy("source", "lack", "before", "q", "key", "size").agg(F.count("*").alias("same"))
    order = W.partitionBy("source").orderBy("q", "key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("before") + F.sum(F.col("size") * F.col("same")).over(order) - F.col("size") * F.col("same")
    # The i-th of equal ones is taken if the middle of its words is not beyond what lacks.
    many = F.when(F.col("size") == 0, F.when(start <= F.col("lack"), F.col("same")).otherwise(0)).otherwise(F.floor((F.col("lack") - start) / F.col("size") + 0.5))
    last = equal.withColumn("many", F.least(F.greatest(many, F.lit(0)), F.col("same"))).where("many > 0")
    last = last.groupBy(F.col("source").alias("last_of")).agg(F.max(F.struct("q", "key", "size", "many", "same")).alias("last"))
    found = wanted.join(edges.drop("before"), F.col("of").eqNullSafe(F.col("edge_of")), "left").join(last, F.col("of").eqNullSafe(F.col("last_of")), "left")
    return cut(found.drop("edge_of", "last_of"))


def allotted(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """`rows` (key, source, size, u and others) with source_size, target and copies."""
    own, last = F.struct("q", "key", "size"), F.struct("last.q", "last.key", "last.size")
    extra = (
        F.when(F.col("q").isNull(), 0)
        .when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), 1)
        .when((F.col("bin") > F.col("edge")) | F.col("last").isNull() | (own > last), 0)
        .when((own < last) | (F.col("last.many") == F.col("last.same")), 1)
    )
    judged = ranked(rows, ended).withColumn("extra", extra.cast("long"))
    sure = judged.where("extra is not null")
    if not ended.where("last.many < last.same").isEmpty():
        number = F.row_number().over(W.partitionBy("source").orderBy("key"))
        sure = sure.unionByName(judged.where("extra is null").withColumn("extra", (number <= F.col("last.many")).cast("long")))
    made = {"copies": F.col("whole") + F.col("extra")}
    return sure.withColumns(made).drop("measure", "whole", "part", "lack", "edge", "last", "q", "bin", "extra")


def _prepared(docs: DataFrame, key: Column, source: Column, text: str, *more: str) -> DataFrame:
    return docs.select(*more, key.alias("key"), source.cast("string").alias("source"), words(text).alias("size"), drawn(key).alias("u")).withColumn("measure", measure(F.col("size")))


def _ended(light: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    return ends(light, cut(expected(light, cut(targets(light, weights, share, cap)), cap)))


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): one row a document."""
    light = cut(_prepared(docs, F.col(key), F.col(source), text))
    found = allotted(light, _ended(light, weights, share, cap))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", taken)


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The documents that the mix takes, with their columns and how many copies of each.

    Documents draw by id and text, so that repeated ids draw apart.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    of = lambda column: F.col(names[docs.columns.index(column)])
    key = F.concat_ws(":", of("doc_id"), F.xxhash64(of("doc_id"), of("text")))
    rows = _prepared(inner, key, of("source"), names[docs.columns.index("text")], *names)
    light = cut(rows.select("key", "source", "size", "u", "measure"))
    found = allotted(rows, _ended(light, weights, share, cap)).where("copies > 0").select(*names, "copies")
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c.lower() != "copies"]
    return found.select(*[F.col(n).alias(c) for n, c in kept], "copies")
