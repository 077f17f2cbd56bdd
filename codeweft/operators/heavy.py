"""The most frequent values, with memory and shuffle bounded by a sketch.

Each task keeps at most `counters` values with counts: what comes in is added, and where there are more, the
count of the first one too many is taken off all, which loses no value by more than what was taken off. The
sketches of all tasks together know every value whose count exceeds the sum of what they took off. A second
pass counts the values exactly that can still be among the first `top`; all others are known to be below.
Where the sketches were too small to tell, they are made anew with four times the counters.

Nulls are a value like others. Of equal counts the lesser value comes first.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.tables import settled, table


def pruned(held: dict, counters: int) -> tuple[dict, int]:
    """The counts above that of the first value too many, less it, and what was taken off."""
    if len(held) <= counters:
        return held, 0
    cut = sorted(held.values(), reverse=True)[counters]
    return {v: n - cut for v, n in held.items() if n > cut}, cut


def sketched(values: DataFrame, counters: int) -> DataFrame:
    """(value, count, lost): the sketch of each task; a row with count 0 says what a task took off."""

    def run(batches):
        held: dict = {}
        lost = 0
        for batch in batches:
            counted = pc.value_counts(batch.column("value"))
            for v, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True):
                held[v] = held.get(v, 0) + n
            held, cut = pruned(held, counters)
            lost += cut
        names, counts = [*held, None], [*held.values(), 0]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array([0] * len(held) + [lost], pa.int64())], names=["value", "count", "lost"])

    return values.mapInArrow(run, "value string, count long, lost long")


def heavy_hitters(values: DataFrame, top: int, counters: int = 4096) -> DataFrame:
    """(value, count) of the `top` most frequent of (value), exactly."""
    while True:
        sketch = settled(sketched(values, counters))
        lost = sketch.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
        least = settled(sketch.where("count > 0").groupBy("value").agg(F.sum("count").alias("least")))
        first = [r.least for r in least.orderBy(F.desc("least")).limit(top).collect()]  # `top` numbers
        # A value that no sketch knows occurs `lost` times at most.
        if not lost or len(first) == top and first[-1] > lost:
            break
        counters *= 4
    bar = first[-1] if len(first) == top else 0
    able = settled(least.where(F.col("least") + lost >= bar).select(F.col("value").alias("able")))
    counted = values.join(able, F.col("value").eqNullSafe(F.col("able")), "left_semi").groupBy("value").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top)


@query("agg12_heavy_hitters", "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word ORDER BY count DESC, word LIMIT 50")
def agg12(spark, root):
    words = table(spark, root, "documents").select(F.explode(F.split("text", " ")).alias("value"))
    return heavy_hitters(words, 50).withColumnRenamed("value", "word")
