"""Hit counting and refresh as streams, with batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.functions.scalars import is_crawler
from codeweft.plans.register import query
from codeweft.sources.store import Store, added, newest
from codeweft.sources.tables import settled, shared_folder, table


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, file, artifact, hits): tumbling windows; with `late`, older events are dropped by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    counted = timed.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("file"), F.col("user_id").alias("artifact")).agg(F.count("*").alias("hits"))
    return counted.select(F.col("window.start").alias("hour"), "file", "artifact", "hits")


def stream_hits(source: DataFrame, path: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Appends closed hours to a Parquet sink once the watermark has passed them; exactly once by its checkpoint."""
    return hourly(source, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def on_update(updates: DataFrame, refreshers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of updated artifacts (artifact_id, requests), each once, goes to every refresher: requests that
    arrive while one runs coalesce into the next batch, so a run follows each of them; a failed batch is replayed."""

    def each(batch: DataFrame, number: int) -> None:
        changed = settled(batch.groupBy("artifact_id").agg(F.count("*").alias("requests")))
        for refresh in refreshers:
            refresh(changed, number)

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("str01_hourly_hits", "SELECT date_trunc('hour', ts) AS hour, event_type AS file, user_id AS artifact, count(*) AS hits FROM events GROUP BY ALL")
def str01(spark: SparkSession, root: str) -> DataFrame:
    """The batch twin of the stream."""
    return hourly(table(spark, root, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


HITS = "day date, hour timestamp, file string, artifact long, hits long"


def upsert_hits(store: Store, source: DataFrame, checkpoint: str, late: str = "2 hours", stream: str = "hits", agent: Column | None = None) -> StreamingQuery:
    """Hourly hits of a stream into the table `hits` of a store.

    Crawlers are dropped first. The state holds the count of every hour, file and artifact that the watermark
    has not passed; every batch brings the counts that changed (update mode), which take the place of the
    stored ones in the days they belong to. A batch that comes again changes nothing.
    """
    people = source if agent is None else source.where(~is_crawler(agent))

    def each(batch: DataFrame, number: int) -> None:
        counted = settled(batch.withColumn("day", F.to_date("hour")))  # once: the state is committed with it, merged before or not
        store.merge("hits", HITS, counted, "day", newest(["day", "hour", "file", "artifact"]), batch=(stream, number))

    return hourly(people, late).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}"


@query("str01_streamed_hits", "SELECT date_trunc('hour', ts) AS hour, event_type AS file, user_id AS artifact, count(*) AS hits FROM events GROUP BY ALL")
def str01_streamed(spark: SparkSession, root: str) -> DataFrame:
    """All events through Structured Streaming, one file a batch, upserted into a store and read back.

    The table is in no order of time, so the watermark waits longer than it spans.
    """
    folder = fresh_folder(spark)
    table(spark, root, "events").repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(table(spark, root, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    upsert_hits(store, source, f"{folder}/checkpoint", late="3650 days").awaitTermination()
    return store.read("hits", HITS).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "file", "artifact", "hits")


@query("snk06_hit_upsert", "SELECT event_type AS file, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY event_type")
def snk06(spark: SparkSession, root: str) -> DataFrame:
    """Hits of two halves of the events, the second added to the first in a store, and then once more, which changes nothing."""
    events = table(spark, root, "events")
    half = lambda rest: events.where(f"event_id % 2 = {rest}").groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("hits"))
    store = Store(spark, fresh_folder(spark))
    for number, rows in enumerate((half(0), half(1))):
        store.merge("hits", "file string, hits long", rows, "file", added(["file"], "hits"), batch=("halves", number))
    store.merge("hits", "file string, hits long", half(1), "file", added(["file"], "hits"), batch=("halves", 1))
    return store.read("hits", "file string, hits long")


@query("str01_without_crawlers", "SELECT date_trunc('hour', ts) AS hour, count(*) AS hits FROM events WHERE event_type <> 'error' GROUP BY ALL")
def str01_people(spark: SparkSession, root: str) -> DataFrame:
    agent = F.when(F.col("event_type") == "error", "Googlebot").otherwise("Mozilla")
    return table(spark, root, "events").where(~is_crawler(agent)).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("hits"))


SUMMARY = "artifact_id long, count long"


@query("str05_refreshed_summary", "SELECT user_id % 50 AS artifact_id, count(*) AS count FROM events GROUP BY ALL")
def str05(spark: SparkSession, root: str) -> DataFrame:
    """A stored summary kept up by a stream of updated artifacts: only their partitions are counted anew and replaced."""
    events = table(spark, root, "events").withColumn("artifact_id", F.col("user_id") % 50)
    counted = lambda rows: rows.groupBy("artifact_id").agg(F.count("*").alias("count"))
    folder = fresh_folder(spark)
    store = Store(spark, f"{folder}/store")
    store.publish({"summary": counted(events.where("event_id % 3 <> 0"))}, "artifact_id")
    # Events of a third arrive: their artifacts are announced on a stream.
    events.where("event_id % 3 = 0").select("artifact_id").repartition(2).write.parquet(f"{folder}/in")
    updates = spark.readStream.schema("artifact_id long").parquet(f"{folder}/in")

    def refresh(changed: DataFrame, number: int) -> None:
        if store.last_batch("updates") < number:
            store.replace({"summary": counted(events.join(changed, "artifact_id", "left_semi"))}, "artifact_id", batch=("updates", number))

    on_update(updates, [refresh], f"{folder}/checkpoint").awaitTermination()
    return store.read("summary", SUMMARY)


@query("str03_listeners", "SELECT artifact_id, listener, count(*) AS requests FROM (SELECT user_id % 50 AS artifact_id FROM events), (VALUES ('artifact'), ('global')) t(listener) WHERE listener = 'artifact' OR artifact_id % 2 = 0 GROUP BY ALL")
def str03(spark: SparkSession, root: str) -> DataFrame:
    """Announced updates, a file a batch, handed to two listeners: one hears every artifact, one the even ones; both store what they heard."""
    folder = fresh_folder(spark)
    table(spark, root, "events").select((F.col("user_id") % 50).alias("artifact_id")).repartition(3).write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    schema = "artifact_id long, listener string, requests long"

    def listener(name: str, only: str) -> Callable[[DataFrame, int], None]:
        def heard(batch: DataFrame, number: int) -> None:
            rows = batch.where(only).select("artifact_id", F.lit(name).alias("listener"), "requests")
            store.merge("heard", schema, rows, "artifact_id", added(["artifact_id", "listener"], "requests"), batch=(name, number))

        return heard

    source = spark.readStream.schema("artifact_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    on_update(source, [listener("artifact", "true"), listener("global", "artifact_id % 2 = 0")], f"{folder}/checkpoint").awaitTermination()
    return store.read("heard", schema)
