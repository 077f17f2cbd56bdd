"""The event sweep against a stack machine that walks the characters, and interleaved diffs."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from codeweft.operators import rendering as R

MARKS = "doc long, start int, length int, tag string"


def machine(text, marks):
    """Character by character: what is open is what covers it, outside in; lines close everything."""
    ordered = sorted(((max(0, s), s + n, t) for s, n, t in marks if s + n >= max(0, s)), key=lambda m: (m[0], -m[1], m[2]))
    out, at = [], 0
    for line in text.split("\n"):
        stack, shown = [], ""
        last = at + len(line)
        for p in range(at, last + 1):
            want = [(i, t) for i, (a, b, t) in enumerate(ordered) if a <= p < b] if p < last else []
            keep = 0
            while keep < min(len(stack), len(want)) and stack[keep] == want[keep]:
                keep += 1
            shown += "".join(f"</{t}>" for _, t in reversed(stack[keep:]))
            shown += "".join(f"<{t}></{t}>" for a, b, t in ordered if a == b == p)
            shown += "".join(f"<{t}>" for _, t in want[keep:])
            stack = want
            if p < last:
                shown += html.escape(text[p]).replace("&#x27;", "&#39;")
        out.append(shown)
        at = last + 1
    return out


def made(rng, doc):
    text = "".join(rng.choice(["ab", "<", "&", " ", "\n", "é", "'"]) for _ in range(rng.randint(0, 40)))
    marks = [(doc, s := rng.randint(-2, len(text) + 2), rng.choice([0, 1, 3, 8, 60]), rng.choice(["u", "i", "b"])) for _ in range(rng.randint(0, 9))]
    return text, [m for m in marks if m[1] <= len(text)]


def test_random_marks(spark):
    rng = random.Random(2)
    texts, marks = {}, []
    for doc in range(80):
        texts[doc], more = made(rng, doc)
        marks += more
    texts[99] = None
    marks += [(99, 0, 1, "b"), (77777, 0, 1, "b"), (1, None, 1, "b")]
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    got = {}
    for r in R.rendered(docs, spark.createDataFrame(marks, MARKS)).collect():
        got[r.doc, r.line] = r.html
    want = {(d, i): x for d, t in texts.items() if t is not None for i, x in enumerate(machine(t, [m[1:] for m in marks if m[0] == d and m[1] is not None]))}
    assert got == want


def test_crossing_marks_close_and_open_again(spark):
    docs = spark.createDataFrame([(1, "abcdef\ngh")], "doc long, text string")
    marks = spark.createDataFrame([(1, 0, 4, "u"), (1, 2, 6, "i"), (1, 4, 0, "x")], MARKS)
    assert [r.html for r in R.rendered(docs, marks).orderBy("line").collect()] == ["<u>ab<i>cd</i></u><x></x><i>ef</i>", "<i>g</i>h"]
    assert R.whole(R.rendered(docs, marks)).first().html.count("\n") == 1


def test_interleaved_lines_stand_in_place(spark):
    old, new = "one\ntwo\nthree\nfour", "one\n2\nthree\nfour\nfive"
    docs = spark.createDataFrame([(1, old), (2, new)], "doc long, text string")
    shown = R.rendered(docs, spark.createDataFrame([(1, 4, 3, "b"), (2, 4, 1, "i"), (2, 0, 3, "u")], MARKS))
    pairs = spark.createDataFrame([(1, old, new)], "key long, old string, new string")
    rows = R.interleaved(pairs, shown.where("doc = 1"), shown.where("doc = 2").withColumn("doc", F.lit(1).cast("long"))).orderBy("nth").collect()
    assert [(r.status[0], r.html) for r in rows] == [("U", "<u>one</u>"), ("D", "<b>two</b>"), ("I", "<i>2</i>"), ("U", "three"), ("U", "four"), ("I", "five")]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_show(spark, rows):
    docs = spark.createDataFrame(rows, "doc long, text string")
    assert R.rendered(docs, spark.createDataFrame([(1, 0, 1, "b")], MARKS)).count() == 0


def test_many_marks_on_one_line(spark):
    text = "word " * 3000
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    shown = R.rendered(docs, R.found_marks(docs, {"b": "word"})).first().html
    assert re.sub("</?b>", "", shown) == text and shown.count("<b>word</b>") == 3000


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_not_shuffled_to_be_rendered(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "c\nd")], "doc long, text string")
    marks = spark.createDataFrame([(1, 0, 3, "b"), (2, 0, 1, None)], MARKS)
    html = R.rendered(docs, marks)
    assert exchanges(html) <= 2
    assert sorted(tuple(r) for r in html.collect()) == [(1, 0, "<b>a b</b>"), (1, 1, "c"), (2, 0, "c"), (2, 1, "d")]
    pairs = spark.createDataFrame([(1, "a b\nc", "c\nd")], "key long, old string, new string")
    new = html.where("doc = 2").withColumn("doc", F.lit(1).cast("long"))
    rows = R.interleaved(pairs, html.where("doc = 1"), new)
    assert exchanges(rows) <= 5  # docs and marks for either side, and one for all that meets
    assert sorted((r.nth, r.status[0], r.html) for r in rows.collect()) == [(0, "D", "<b>a b</b>"), (1, "U", "c"), (2, "I", "d")]
