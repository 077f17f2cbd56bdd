"""What a Python worker holds does not grow with the rows of a batch."""

import pyarrow as pa

from codeweft.operators import intervals, postings
from codeweft.sources import tables


def test_batches_are_cut_by_bytes_of_text():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["x" * 700_000, None, "y" * 700_000, "z", "", "w" * 5_000_000, "v"]})
    cut = list(tables.pieces([batch], "t"))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and len(cut) > 2
    sizes = [[len(t or "") for t in p.column("t").to_pylist()] for p in cut]
    assert all(sum(x) - max(x) <= tables.PIECE for x in sizes)


def test_functions_emit_many_small_batches(spark, monkeypatch):
    """A batch of 300 texts leaves the tokenizer and the diff in parts, whole and in order."""
    seen = []
    kind = type(spark.range(1))
    docs = spark.createDataFrame([(1, "a")], "doc long, text string")
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    postings.analysed(docs, "doc", "text", "prose")
    intervals.line_diff(docs.selectExpr("doc key", "text old", "text new"))
    texts = [f"w{i} " + "word\n" * 2000 for i in range(300)]
    index = list(seen[0](iter([pa.RecordBatch.from_pydict({"doc": list(range(300)), "body": texts})])))
    assert sum(b.num_rows for b in index) == 600 and max(b.num_rows for b in index) < 250
    edits = list(seen[1](iter([pa.RecordBatch.from_pydict({"key": list(range(300)), "old": texts, "new": texts})])))
    assert sum(b.num_rows for b in edits) == 300 * 2001 and max(b.num_rows for b in edits) <= tables.ROWS


def test_reachable_broadcasts_nothing(spark, monkeypatch):
    """What a round finds grows with the graph, so no round sends it through the driver."""
    plans, settled = [], tables.settled
    monkeypatch.setattr(tables, "settled", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or settled(frame))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 4)], "a long, b long")
    assert sorted(r.id for r in tables.reachable(spark.sql("select 2L as id"), edges).collect()) == [2, 3, 4]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_tasks_of_ranges_grow_in_number(spark):
    spans = spark.range(0, 100, 1, 12).selectExpr("id % 7 id", "id start", "id + 1 stop")
    found = intervals.coalesced(spans)
    assert found.rdd.getNumPartitions() == 96 and found.count() == 100
