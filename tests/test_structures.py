"""Versions, intervals, diffs, streams and ingest."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.operators import intervals as I
from codeweft.operators import paths as P
from codeweft.operators import trees
from codeweft.operators import versions as V
from codeweft.sources import extract, ingest, tables
from codeweft.streaming import hits


def test_version_order(spark):
    given_ = ["1.2", "1.10", "1.10.1", "1.x", "2.0-rc", "2", "10"]
    got = spark.createDataFrame([(v,) for v in given_], "v string").orderBy(V.version_key(F.col("v"))).collect()
    assert [r.v for r in got] == ["10", "2", "2.0-rc", "1.10", "1.10.1", "1.2", "1.x"]


def test_common_prefix(spark):
    got = spark.createDataFrame([("abc", "abd"), ("", "x"), ("a", "b"), ("same", "same")], "a string, b string").select(P.common_prefix(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["ab", "", "", "same"]


@pytest.mark.parametrize("ranges, want", [([(5, 10), (10, 15)], [(5, 15)]), ([(5, 6), (7, 8)], [(5, 6), (7, 8)]), ([(1, 9), (2, 3), (4, 12)], [(1, 12)]), ([(3, 3), (3, 4)], [(3, 4)])])
def test_coalesced(spark, ranges, want):
    got = I.coalesced(spark.createDataFrame([(1, a, b) for a, b in ranges], "id int, start long, stop long")).collect()
    assert sorted((r.start, r.stop) for r in got) == want


def test_diff_known_answer():
    got = I.histogram_diff(list("abce"), list("aabde"))
    assert got == [("a", "UNCHANGED"), ("a", "INSERTION"), ("b", "UNCHANGED"), ("c", "DELETION"), ("d", "INSERTION"), ("e", "UNCHANGED")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_diff_rebuilds_both_sides(old, new):
    edits = I.histogram_diff(old, new)
    assert [x for x, s in edits if s != "INSERTION"] == old
    assert [x for x, s in edits if s != "DELETION"] == new


def test_streamed_hits_match_batch(spark, tmp_path):
    from conftest import SMALL

    from codeweft.sources.tables import table

    events = table(spark, SMALL, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{SMALL}/events.parquet*")
    hits.stream_hits(source, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {tuple(r) for r in hits.hourly(events).collect()}
    assert closed and closed <= every  # the last hours stay open behind the watermark


def test_refresh_on_update(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "artifact_id long").write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("artifact_id long").parquet(str(tmp_path / "in"))
    hits.on_update(source, [lambda batch, n: seen.extend(r.artifact_id for r in batch.collect())], str(tmp_path / "mark")).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_requests_that_arrive_during_a_run_are_run_again(spark, tmp_path):
    """A request written while a batch is handled is in a later batch; requests of one batch are one run an artifact."""
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "artifact_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(1, 1, 2)
    seen = []

    def refresh(batch, number):
        if not seen:
            put(1)
        seen.append({r.artifact_id: r.requests for r in batch.collect()})

    for _ in range(2):
        hits.on_update(spark.readStream.schema("artifact_id long").parquet(str(tmp_path / "in")), [refresh], str(tmp_path / "mark")).awaitTermination()
    assert seen == [{1: 2, 2: 1}, {1: 1}]


def test_equal_ranges_with_two_references_are_an_error(spark):
    schema = "id long, start long, stop long, style string, ref string"
    fine = [(1, 0, 5, "b", "x"), (1, 0, 5, "a", None), (1, 0, 5, "b", "x"), (1, 0, 6, "c", "y")]
    got = sorted(tuple(r) for r in I.merged_spans(spark.createDataFrame(fine, schema)).collect())
    assert got == [(1, 0, 5, ["a", "b"], "x"), (1, 0, 6, ["c"], "y")]
    with pytest.raises(Exception, match="more than one reference at 1 0 5"):
        I.merged_spans(spark.createDataFrame([*fine, (1, 0, 5, "a", "z")], schema)).collect()


def test_in_place_choice():
    assert ingest.in_place(3, 10) and not ingest.in_place(4, 10) and not ingest.in_place(0, 0)


def test_shredded_rows(spark):
    mark = "named_struct('start', {}, 'length', 1, 'kind', '{}', 'binding', '{}', 'parent', cast(null as string), 'type', 7, 'duplicate', {})"
    files = spark.sql(
        "select 1 artifact_id, 'a/B.java' path, 'class B {{}}\nint x;' text, array({}, {}, {}) annotations".format(
            mark.format(6, "decl", "a.B", "false"), mark.format(11, "ref", "a.C", "false"), mark.format(11, "ref", "a.C", "true")
        )
    )
    rows = ingest.shredded(files)
    assert rows["source_file"].count() == 1
    assert [(r.line, r.type, r.ref_id) for r in rows["binding_reference"].collect()] == [(2, 7, 1)]
    assert [r.binding for r in rows["binding"].collect()] == ["a.B"]
    assert sorted((r.binding, r.binding_id == -1) for r in rows["package"].collect()) == [("", True), ("a", False)]
    normal, plain = (rows["lexeme"].where(f"set = '{s}'").orderBy("pos").collect() for s in ("normal", "no_symbols"))
    assert [r.lexeme for r in normal] == ["class", "b", "{", "}", "int", "x", ";"]
    assert [(r.pos, r.lexeme) for r in plain] == [(0, "class"), (1, "b"), (2, "int"), (3, "x")]


def test_dependencies_up_to_the_fix_point(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(5, 2), (30, 99), (99, 100), (200, 201)], "a long, b long")
    got = ingest.resolved(spark.createDataFrame([(0,), (0,)], "id long"), edges, spark.createDataFrame([(99,)], "id long")).collect()
    assert sorted(r.id for r in got) == list(range(31))


def test_changes_rise_to_the_root(spark):
    rows = [(1, None, "UNCHANGED"), (2, 1, "UNCHANGED"), (3, 2, "UNCHANGED"), (4, 3, "CHANGED"), (5, 1, "UNCHANGED"), (6, None, "UNCHANGED"), (7, 6, "INSERTION"), (8, 7, "DELETION")]
    got = {r.k: r.status for r in trees.changed_inside(spark.createDataFrame(rows, "k long, p long, s string")).collect()}
    inside = {k for k, s in got.items() if s == "CHANGED_INTERNALLY"}
    assert inside == {1, 2, 3, 6} and (got[4], got[5], got[7], got[8]) == ("CHANGED", "UNCHANGED", "INSERTION", "DELETION")


def test_walks_have_no_depth_limit(spark):
    """A chain of 200 below one of 70, a cycle, what hangs on it, and a missing parent."""
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 271)] + [(500, None), (501, 500), (600, 601), (601, 600), (602, 601), (700, 999)]
    got = {r.id: (r.root, r.depth) for r in trees.descend(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: (0, i) for i in range(271)} | {500: (500, 0), 501: (500, 1)}


def test_closure_of_a_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100)] + [(None, 1), (1, None)]
    got = {(r.a, r.b) for r in tables.closure(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, j) for i in range(71) for j in range(i + 1, 71)} | {(i, j) for i in (100, 101, 102) for j in (100, 101, 102)}


def test_overrides_beyond_64_super_types(spark):
    supers = spark.createDataFrame([(i, i + 1) for i in range(80)], "type long, base long")
    got = extract.overridden(supers, spark.createDataFrame([(0, "m"), (75, "m"), (80, "m")], "type long, method string")).collect()
    assert sorted((r.type, r.base) for r in got) == [(0, 75), (75, 80)]


def test_line_diff_of_null_texts(spark):
    pairs = spark.createDataFrame([(1, None, "a\nb"), (2, "a", None), (3, None, None), (4, "", "")], "key long, old string, new string")
    got = sorted((r.key, r.text, r.status) for r in I.line_diff(pairs).collect())
    assert got == [(1, "a", "INSERTION"), (1, "b", "INSERTION"), (2, "a", "DELETION"), (4, "", "UNCHANGED")]


@pytest.mark.parametrize("name", ["sort07_merged_categories", "sort02_own_artifact_first", "src10_dependency_closure", "join10_tree_levels", "join14_longest_prefix"])
def test_twins_at_the_middle_size(name, spark, same):
    import glob
    import os

    import duckdb

    from codeweft.plans.registry import ORACLES, QUERIES

    root, con = "/root/testdata/sf0.01", duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    same(QUERIES[name](spark, root), con, ORACLES[name])
