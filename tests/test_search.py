"""Name search against known answers and brute force."""

import itertools

import pytest

from codeweft.operators import search as S
from codeweft.operators import typesearch as T

def test_components(spark):
    names = ["ConcurrentHashMap", "java.util", "URI", "Jsr320", "JSR320"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(S.components(S.F.col("n"))).collect()
    assert [list(r[0]) for r in got] == [["concurrent", "hash", "map"], ["java.", "util"], ["uri"], ["jsr", "320"], ["jsr", "320"]]


@pytest.mark.parametrize(
    "parts, wanted, jumps, want",
    [
        ("a b ab c", "abc", 2, [0, 0, 2, 1]),
        ("a ab b c", "abc", 2, [0, 1, 1, 1]),
        ("ab a b c", "abc", 2, [0, 1, 1, 1]),
        ("a ab bc x", "abcx", 3, [0, 1, 2, 1]),
        ("a ab bc x", "abcy", 3, None),
        ("concurrent hash map", "chm", 2, [1, 1, 1]),
        ("concurrent hmap", "chmap", 1, [1, 4]),
        ("concurrent hash map", "chmap", 2, [1, 1, 3]),
        ("xxxxx. longer name", "long", 0, [0, 4, 0]),
        ("my name", "myname", 1, [2, 4]),
    ],
)
def test_highlight(parts, wanted, jumps, want):
    assert T.highlight(parts.split(), wanted, jumps) == want


def brute(parts, wanted):
    """Least paid jumps by trying every split of the query and every start of each run."""
    text, heads, at = "".join(parts), [], 0
    for p in parts:
        heads.append(at)
        at += len(p)
    for j in range(len(wanted)):
        for cuts in itertools.combinations(range(1, len(wanted)), j):
            runs = [wanted[a:b] for a, b in zip((0, *cuts), (*cuts, len(wanted)), strict=True)]
            ends = [0]
            for run in runs:
                ends = [h + len(run) for h in heads if text[h : h + len(run)] == run and any(h >= e for e in ends)]
            if ends:
                return j
    return -1


def test_least_jumps(spark):
    """The frontier over written suffixes, for every short query over names of few letters."""
    names = [f"{'A' if i else ''}{x}.{y}{z.capitalize()}" for i, (x, y, z) in enumerate(itertools.product(["a", "ab", "ba"], repeat=3))] + ["java.util.concurrent.ConcurrentHashMap", "io.netty.buffer.ByteBuf", "java.lang.String"]
    frame = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    parts = {r.id: list(r.c) for r in frame.select("id", S.components(S.F.col("n")).alias("c")).collect()}
    table = T.suffixes(frame, "id", "n").cache()
    for wanted in ["a", "ab", "bab", "aba", "abb", "baab", "aaab", "abba", "javuticohamap", "nettybytebuf", "string"]:
        want = {i: brute(c, wanted) for i, c in parts.items()}
        assert {r.name: r.jumps for r in T.jumps(table, wanted).collect()} == {i: j for i, j in want.items() if 0 <= j < T.DEPTH}, wanted
    assert T.jumps(table, "").count() == 0


def test_search_order(spark, tmp_path):
    names = spark.createDataFrame([(1, "xxxxx.LongerName"), (2, "long.ShortName"), (3, "other.Thing"), (4, None)], "binding_id long, binding string")
    found = T.type_search(names, T.written(names, "binding_id", "binding", f"file://{tmp_path}/names"), "long")
    assert [(r.binding, r.depth) for r in found.orderBy(*T.ranked()).collect()] == [("xxxxx.LongerName", 0), ("long.ShortName", 1)]


def test_only_the_letters_buckets_are_read(spark, tmp_path):
    names = spark.createDataFrame([(i, f"pkg{i}.{'abcdef'[i % 6]}Name") for i in range(60)], "binding_id long, binding string")
    plan = T.jumps(T.written(names, "binding_id", "binding", f"file://{tmp_path}/names"), "na")._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and all(f"{ord(c) % T.BUCKETS}" in plan.split("PartitionFilters: [")[1].split("]")[0] for c in "na")
