"""Parquet tables of one data directory, read lazily so that pruning and pushdown reach the scan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors see; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeweft-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def settled(frame: DataFrame) -> DataFrame:
    """The frame as written to the checkpoint folder, so that it is computed once and its plan ends there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def spread(frame: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores: a small file is one split, and work on its rows would be one task."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


#: What Python holds of a task at once: bytes of text (and one longer text), and rows made of them.
PIECE, ROWS = 1 << 20, 1 << 16
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def pieces(batches: Iterable[pa.RecordBatch], *texts: str, share: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of `share` times `PIECE` bytes of the columns `texts`, and one longer row, at most."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            size += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size) // (share * PIECE))) + 1
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            if begin < end:
                yield batch.slice(begin, end - begin)


def unfolded(frame: DataFrame, keep: list[str], make: Callable[..., Iterable[tuple]], schema: str, texts: list[str], more: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row beside every tuple of `schema` that `make` gives for its `texts` (and columns `more`).

    Texts reach Python some `PIECE` bytes and rows leave it `ROWS` at a time, so what a task holds does not grow with the
    rows of a batch or with what is made of a row.
    """
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    given = [*texts, *(more or [])]

    def run(batches):
        for piece in pieces(batches, *texts):

            def table(at: list, made: list, piece=piece) -> pa.RecordBatch:
                kept = [piece.column(c).take(pa.array(at, pa.int64())) for c in keep]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, KINDS[k]) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=[*keep, *names])

            at, made = [], []
            for i, row in enumerate(zip(*(piece.column(c).to_pylist() for c in given), strict=True)):
                for one in make(*row):
                    at.append(i)
                    made.append(one)
                    if len(made) == ROWS:
                        yield table(at, made)
                        at, made = [], []
            if made:
                yield table(at, made)

    kept = [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep]
    return frame.select(*dict.fromkeys([*keep, *given])).mapInArrow(run, ", ".join([*kept, schema]))


def dealt(frame: DataFrame, *keys: str, share: int = 8) -> DataFrame:
    """The frame by keys in partitions whose number grows with what is read: `share` for each split of the scan, so a task's part keeps its size."""
    count = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(count, share * frame.rdd.getNumPartitions()), *keys)


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, name: tuple, make: Callable):
    """What `make` gives for a fresh folder below the shared one; made once a session and name."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _MADE:
        _MADE[key] = make(f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}")
    return _MADE[key]


class Rounds:
    """What the rounds of an iteration found, each in a table of its own; every `EVERY` of them become one."""

    EVERY = 8

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)

    def add(self, rows: DataFrame) -> None:
        self.tables.append(rows)
        if len(self.tables) == self.EVERY:
            self.tables = [settled(self.all())]


def reachable(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of all that is reachable from `wanted` (id) over edges (a, b): new ids only, until there is none.

    Edges and ids are merged, not broadcast: a checkpoint's size is a guess, and what is broadcast passes through the driver.
    """
    edges = settled(edges.select("a", "b").distinct())
    new = settled(wanted.select("id").distinct())
    reached = Rounds(new)
    while not new.isEmpty():
        found = new.join(edges.hint("merge"), new.id == edges.a).select(F.col("b").alias("id")).distinct()
        new = settled(found.join(reached.all().hint("merge"), "id", "left_anti"))
        reached.add(new)
    return reached.all().distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) of all b that can be reached from a over edges (a, b), one at least; cycles end, nothing is capped.

    Every round joins what the last one added with all pairs, on either side, so the ways double in length, rounds
    grow with their logarithm, and no two old pairs are joined again.
    """
    new = settled(edges.select("a", "b").where("a is not null and b is not null").distinct())
    pairs = Rounds(new)
    while not new.isEmpty():
        every = pairs.all()
        ahead = new.join(every.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        behind = every.join(new.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        new = settled(ahead.unionByName(behind).distinct().join(every, ["a", "b"], "left_anti"))
        pairs.add(new)
    return pairs.all()


def placed(rows: DataFrame, order: list) -> DataFrame:
    """All rows with their `place` in the order, from 1: ranges are numbered apart, after the rows of those before."""
    parts = settled(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, seen = [], 0
    for part, count in sorted(tuple(r) for r in parts.groupBy("__part").count().collect()):  # a row a partition
        before.append((part, seen))
        seen += count
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.join(offsets, "__part").withColumn("place", within + F.col("__before")).drop("__part", "__before")
