"""The versioned store and what streams write into it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeweft.sources.store import PIECES, Conflict, Store, added
from codeweft.streaming import hits

SCHEMA = "k long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(store, version=None):
    return sorted((r.k is not None, r.k or 0, r.v) for r in store.read("t", SCHEMA, version).collect())


def files(store):
    return {r.key: r.piece for r in store.manifest().collect()}


def test_replaced_partitions_and_pinned_readers(spark, store):
    assert store.version() == 0 and held(store) == []
    assert store.publish({"t": rows(spark, (1, "a"), (2, "b"), (2, "c"), (None, "n"), (4, "d"))}, "k") == 1
    before = files(store)
    old = store.read("t", SCHEMA, 1)
    assert store.replace({"t": rows(spark, (2, "B"), (3, "new"), (None, "N"))}, "k", gone=spark.sql("select 4L as key")) == 2
    assert held(store) == [(False, 0, "N"), (True, 1, "a"), (True, 2, "B"), (True, 3, "new")]
    assert sorted(r.v for r in old.collect()) == ["a", "b", "c", "d", "n"] and len(held(store, 1)) == 5
    after = files(store)
    assert after["=1"] == before["=1"] and after["=2"] != before["=2"] and len(after) == 4  # the very folder, where nothing changed


def test_scan_prunes_pieces_that_are_not_named(spark, store):
    store.publish({"t": rows(spark, *((i, "x") for i in range(20)))}, "k")
    store.replace({"t": rows(spark, (3, "y"))}, "k")
    assert "dynamicpruning" in store.read("t", SCHEMA)._jdf.queryExecution().executedPlan().toString()


def test_the_second_of_two_writers_fails(spark, store):
    store.publish({"t": rows(spark, (1, "a"))}, "k")
    seen = set(store._numbers())
    store.replace({"t": rows(spark, (1, "first"))}, "k")
    with pytest.raises(Conflict):
        store._publish(seen, *store._write({"t": rows(spark, (1, "second"))}, "k"))
    assert held(store) == [(True, 1, "first")] and store.version() == 2


def test_a_number_taken_but_not_finished(spark, store, tmp_path):
    """A reader between the steps of a writer sees the old set whole; later writers go on."""
    store.publish({"t": rows(spark, (1, "a"), (2, "b"))}, "k")
    store._write({"t": rows(spark, (1, "half"))}, "k")  # written, not published
    assert held(store) == [(True, 1, "a"), (True, 2, "b")]
    (tmp_path / "store" / "versions" / f"{2:020d}").touch()  # taken, its writer died
    assert held(store) == [(True, 1, "a"), (True, 2, "b")] and store.version() == 1
    assert store.replace({"t": rows(spark, (1, "c"))}, "k") == 3 and held(store) == [(True, 1, "c"), (True, 2, "b")]


def test_batches_are_merged_once(spark, store):
    for number, values in ((0, [(1, 5), (2, 1)]), (1, [(1, 2)]), (1, [(1, 2)]), (0, [(2, 9)])):
        store.merge("n", "k long, n long", spark.createDataFrame(values, "k long, n long"), "k", added(["k"], "n"), batch=("s", number))
    assert sorted(tuple(r) for r in store.read("n", "k long, n long").collect()) == [(1, 7), (2, 1)] and store.last_batch("s") == 1


def test_several_tables_change_together(spark, store):
    store.publish({"t": rows(spark, (1, "a")), "u": rows(spark, (1, "x"), (2, "y"))}, "k")
    store.replace({"t": rows(spark, (1, "b")), "u": rows(spark).limit(0)}, "k", gone=spark.sql("select 2L as key"))
    assert held(store) == [(True, 1, "b")] and [r.v for r in store.read("u", SCHEMA).collect()] == ["x"]
    store.publish({"t": rows(spark, (9, "z"))}, "k")
    assert store.read("u", SCHEMA).count() == 0 and held(store) == [(True, 9, "z")]


def test_vacuum_keeps_what_versions_name(spark, store):
    store.publish({"t": rows(spark, (1, "a"), (2, "b"))}, "k")
    store.replace({"t": rows(spark, (1, "c"))}, "k")
    assert store.vacuum(keep=2) == 0 and store.vacuum() == 1 and held(store) == [(True, 1, "c"), (True, 2, "b")]


def test_folders_do_not_grow_with_keys(spark, store, tmp_path):
    many = spark.range(1000).selectExpr("id k", "'old' v")
    store.publish({"t": many}, "k")
    store.replace({"t": many.where("k % 100 = 7").withColumn("v", F.lit("new"))}, "k", gone=spark.sql("select 5L as key"))
    assert len(list((tmp_path / "store" / "data" / "t").glob("piece=*"))) <= PIECES + 10
    assert held(store) == [(True, k, "new" if k % 100 == 7 else "old") for k in range(1000) if k != 5] and len(held(store, 1)) == 1000
    assert store.vacuum() == 0  # each old folder still holds keys in use


def event(hour, minute, file, artifact, agent="Firefox"):
    return (dt.datetime(2024, 5, 1, hour, minute), file, artifact, agent)


EVENTS = "ts timestamp, event_type string, user_id long, agent string"


def test_stream_of_hits(spark, store, tmp_path):
    """Late events go, crawlers go, counts of open hours change in place; a batch that comes again changes nothing."""
    batches = [
        [event(10, 5, "A", 1), event(10, 50, "A", 1), event(11, 1, "A", 1, "Googlebot/2.1"), event(11, 2, "B", 2)],
        [event(10, 59, "A", 1), event(15, 0, "A", 1)],
        [event(10, 30, "A", 1), event(15, 30, "A", 1)],  # its first event is later than the watermark allows
    ]
    want = [[("A", 10, 2), ("B", 11, 1)], [("A", 10, 3), ("A", 15, 1), ("B", 11, 1)], [("A", 10, 3), ("A", 15, 2), ("B", 11, 1)]]
    source = lambda: spark.readStream.schema(EVENTS).parquet(f"file://{tmp_path}/in")
    now = lambda: sorted((r.file, r.hour.hour, r.hits) for r in store.read("hits", hits.HITS).collect())
    for batch, expected in zip(batches, want, strict=True):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        hits.upsert_hits(store, source(), f"file://{tmp_path}/mark", agent=F.col("agent")).awaitTermination()
        assert now() == expected
    version = store.version()
    hits.upsert_hits(store, source(), f"file://{tmp_path}/other", agent=F.col("agent")).awaitTermination()  # batch 0 again
    assert now() == want[-1] and store.version() == version
