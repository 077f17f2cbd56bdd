"""Queries on rows that the given tables lack: nulls and fractions, and groups that are too large for one task."""

import os

import corpus_pipeline
import duckdb
import pyarrow as pa
from conftest import SMALL
from pyspark.sql import functions as F

from codeweft.llm import decontaminate
from codeweft.llm.common import table
from codeweft.operators import intervals, trees
from codeweft.plans.register import ORACLES


def test_ranges_with_nulls_and_fractions(spark, same, tmp_path):
    con = duckdb.connect()
    rows = "(1, 5.0, '2000-01-01'), (1, NULL, '2000-01-01'), (1, 2.5, '2000-02-01'), (1, 3.5, '2000-02-03'), (2, 0.7, '2000-01-01'), (2, 1.0, '2000-01-03'), (3, NULL, '2000-01-01'), (NULL, 1.0, '2000-01-01')"
    con.execute(f"COPY (SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS TIMESTAMP) AS l_shipdate, CAST(1 AS INT) AS l_linenumber FROM (VALUES {rows}) t(k, q, d)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    same(intervals.win05(spark, str(tmp_path)), con, f"WITH none AS (SELECT 1) {intervals.ISLANDS} SELECT id, start, stop FROM merged")


def test_large_libraries_are_dealt_over_tasks(spark, same, monkeypatch):
    monkeypatch.setattr(trees, "PAIRS", 4)
    root = os.path.dirname(SMALL) + "/sf0.01"
    found = trees.tree06(spark, root)
    assert found.groupBy(F.spark_partition_id()).count().count() > 20
    con = duckdb.connect()
    for name in ("supplier", "nation", "region", "part", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    same(found, con, ORACLES["tree06_alternatives"])


def test_pipeline_stages_bound_what_workers_get(spark, monkeypatch):
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = sorted(r.doc_id for r in decontaminate.clean(docs, benchmark).select("doc_id").collect())
    monkeypatch.setattr(decontaminate, "ROWS", 7)
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    try:
        assert sorted(r.doc_id for r in stage(spark, docs, SMALL).select("doc_id").collect()) == want
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg(F.max("n")).first()[0]
        assert spark.conf.get(corpus_pipeline.BATCH) == corpus_pipeline.BATCH_BYTES and sizes < 5 << 20
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)


def test_counts_of_bindings_take_more_tasks_for_more_splits(spark, same, duck):
    from codeweft.operators import references

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = references.join07(spark, SMALL)
        assert found.rdd.getNumPartitions() >= 16  # four by the session's setting alone
        same(found, duck, ORACLES["join07_counts_of_bindings"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_moves_of_a_search_meet_once_and_take_more_tasks_for_more_splits(spark, tmp_path):
    from codeweft.operators import typesearch as T

    names = spark.createDataFrame([(i, f"pkg.{'Smart' if i % 3 else 'Small'}Ring{'Mall' * (i % 5)}Gear{i}") for i in range(400)], "binding_id long, binding string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = T.jumps(T.written(names, "binding_id", "binding", f"file://{tmp_path}/names"), "smring")
        assert found.rdd.getNumPartitions() >= 16  # four by the session's setting alone
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan  # joins of five rounds held all their sorts in one task
        assert {r.name: r.jumps for r in found.collect()} == {i: 1 for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
