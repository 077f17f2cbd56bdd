"""Orders, tree diffs, enclosing ranges and heavy hitters against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweft.operators import heavy, nesting, rendering, trees

SMALL = "/root/testdata/sf0.001"


def longest(nodes, edges):
    """Ranks by trying; None on and behind cycles."""
    rank, left = {}, set(nodes)
    while True:
        free = {n for n in left if not any(b == n and a in left for a, b in edges)}
        if not free:
            return rank | dict.fromkeys(left)
        for n in free:
            rank[n] = max((rank[a] + 1 for a, b in edges if b == n and a in rank), default=0)
        left -= free


@pytest.mark.parametrize("seed", range(2))
def test_topological_order(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a < b} | {(30, 31), (31, 30), (5, 5), (99, 1), (2, 98)}
    known = {(a, b) for a, b in edges if a < 40 and b < 40}
    frame = spark.createDataFrame([*edges, (1, None), *list(edges)[:3]], "a long, b long")
    got = {r.id: r.rank for r in trees.topological(spark.createDataFrame([(n,) for n in nodes + nodes[:2]], "id long"), frame).collect()}
    assert got == longest(nodes, known)


def test_topological_order_of_nothing(spark):
    assert trees.topological(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


NODE = "id string, parent string, name string"


def test_trees_of_five_levels(spark):
    old = [("a", None, "App"), ("a1", "a", "core"), ("a2", "a1", "Net"), ("a3", "a2", "x"), ("a4", "a3", "deep"), ("b", None, "lib"), ("b1", "b", "io"), ("c", None, "same"), ("c1", "c", "kept"), ("lost", "nowhere", "q")]
    new = [("A", None, "app"), ("A1", "A", "Core"), ("A2", "A1", "net"), ("A3", "A2", "X"), ("A5", "A3", "other"), ("d", None, "extra"), ("d1", "d", "io"), ("C", None, "Same"), ("C1", "C", "Kept")]
    got = trees.tree_diff(spark.createDataFrame(old, NODE), spark.createDataFrame(new, NODE)).orderBy("names").collect()
    inside = "CHANGED_INTERNALLY"
    assert [("/".join(r.names), r.depth, r.status) for r in got] == [
        ("app", 0, inside), ("app/core", 1, inside), ("app/core/net", 2, inside), ("app/core/net/x", 3, inside), ("app/core/net/x/deep", 4, "DELETION"), ("app/core/net/x/other", 4, "INSERTION"),
        ("extra", 0, "INSERTION"), ("extra/io", 1, "INSERTION"), ("lib", 0, "DELETION"), ("lib/io", 1, "DELETION"), ("same", 0, "UNCHANGED"), ("same/kept", 1, "UNCHANGED"),
    ]
    assert [(r.old_id, r.new_id) for r in got][-2:] == [("c", "C"), ("c1", "C1")]


def test_equal_names_match_in_order(spark):
    """`io` below a deleted parent is no partner of `io` elsewhere; of three equal names two find partners."""
    old = [("r", None, "r"), ("1", "r", "a"), ("2", "r", "A"), ("3", "r", "a")]
    new = [("R", None, "r"), ("x", "R", "a"), ("y", "R", "a"), ("z", "y", "k")]
    got = {(r.old_id, r.new_id): r.status for r in trees.tree_diff(spark.createDataFrame(old, NODE), spark.createDataFrame(new, NODE)).collect()}
    assert got == {("r", "R"): "CHANGED_INTERNALLY", ("2", "x"): "UNCHANGED", ("1", "y"): "CHANGED_INTERNALLY", ("3", None): "DELETION", (None, "z"): "INSERTION"}
    assert trees.tree_diff(spark.createDataFrame([], NODE), spark.createDataFrame([], NODE)).count() == 0


def test_enclosing_ranges(spark):
    rng = random.Random(4)
    texts = {d: "".join(rng.choice("{}x") for _ in range(rng.randint(0, 30))) for d in range(60)} | {99: None}
    marks = nesting.brackets(spark.createDataFrame(list(texts.items()), "doc long, text string"))
    got = {(r.doc, r.start): (r.stop, r.parent) for r in nesting.enclosed(nesting.ranges(marks)).collect()}
    want = {}
    for doc, text in texts.items():
        stack, spans = [], {}
        for i, c in enumerate(text or ""):
            if c == "{":
                stack.append(i)
            elif c == "}" and stack:
                spans[stack.pop()] = i
        for a, b in spans.items():
            want[doc, a] = (b, max((x for x, y in spans.items() if x < a and y > b), default=None))
    balanced = {d for d, t in texts.items() if t and not any(t[:i].count("}") > t[:i].count("{") for i in range(len(t) + 1))}
    assert {k: v for k, v in got.items() if k[0] in balanced} == {k: v for k, v in want.items() if k[0] in balanced} and len(balanced) > 10


def test_kinds_of_blocks(spark):
    source = """class A extends B { /* { */ int x = 1; { y = 2; } static { s = "{"; }
      A(int a) { super(a); } <T> void m() throws E { if (a) { list.forEach(e -> { while (b) { go(new C<T>(1) { void n() { } }); } }); } else { } }
      enum K { P { int f() { return 1; } } } }"""
    found = nesting.declarations(spark.createDataFrame([(1, source)], "doc long, text string")).orderBy("start").collect()
    assert [(r.kind, r.parent_kind) for r in found if r.kind] == [
        ("type", None), ("initializer", "type"), ("initializer", "type"), ("method", "type"), ("method", "type"), ("lambda", "method"), ("anonymous", "lambda"), ("method", "anonymous"), ("type", "type"), ("anonymous", "type"), ("method", "anonymous"),
    ]


@pytest.mark.parametrize("counters", [4, 30, 5000])
def test_heavy_hitters(spark, counters):
    rng = random.Random(1)
    words = [rng.choice(["a"] * 40 + ["b"] * 30 + ["c"] * 20 + ["d"] * 10 + [None] * 5 + [f"w{i}" for i in range(60)]) for _ in range(4000)]
    got = heavy.heavy_hitters(spark.createDataFrame([(w,) for w in words], "value string").repartition(5), 4, counters).collect()
    assert [tuple(r) for r in got] == Counter(words).most_common(4)


def test_heavy_hitters_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(w,) for w in "zyxwzyxw"], "value string")
    assert [tuple(r) for r in heavy.heavy_hitters(rows, 2, 1).collect()] == [("w", 2), ("x", 2)]
    assert heavy.heavy_hitters(rows.limit(0), 2).count() == 0 and heavy.heavy_hitters(rows, 9).count() == 4


def test_a_sketch_is_bounded_and_says_what_it_lost():
    held, lost = {}, 0
    for i in range(500):
        held[f"v{i % 97}"] = held.get(f"v{i % 97}", 0) + 1
        held["top"] = held.get("top", 0) + 1
        held, cut = heavy.pruned(held, 8)
        lost += cut
    assert len(held) <= 8 and 500 - lost <= held["top"] <= 500 and lost <= 1000 / 9


def test_annotations_are_pruned_to_one_leaf(spark):
    from codeweft.plans.registry import QUERIES

    plan = QUERIES["src17_pruned_annotations"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc:bigint,annotations:array<struct<tag:string>>>", plan)
    assert rendering.annotated(spark, SMALL).where(F.size("annotations") > 0).count() > 0
