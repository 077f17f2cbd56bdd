"""Annotated texts as markup, line by line, and two versions interleaved.

Marks are ranges (start, length, tag) of a text; they may nest, touch, cross, span lines or be empty. A
line is rendered from opening and closing events: between two neighbouring places of events the open marks
form a stack, the earlier and then the longer mark outside. At a place, what stands above the common part
of the stack before and the stack behind closes, innermost first, and what is new opens. So markup always
nests: a mark that crosses another, or a line's end, closes and opens again. Empty marks open and close at
their place, after what closes there. Text is escaped.

A text meets its marks, in order, in one join by document; then lines are rendered one after another, with what is
open beyond a line's end handed on. Nothing of a line is shuffled before it is rendered.

Null texts have no lines. Marks outside their text are cut to it; of marks equal in range and tag each one
is shown. Tags are taken as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.intervals import line_edits
from codeweft.plans.register import query
from codeweft.sources.tables import once, spread, table, unfolded


def shown(text: str | None, starts: list[int], stops: list[int], tags: list[str | None]) -> Iterator[tuple[int, str]]:
    """(line, html) of a text and its marks, outside in."""
    if text is None:
        return
    opening = [f"<{t}>" if t is not None else "" for t in tags]
    closing = [f"</{t}>" if t is not None else "" for t in tags]
    at, fresh, last = 0, 0, text.count("\n")
    reaching: list[int] = []  # marks of earlier lines that do not end before this one
    for number, body in enumerate(text.split("\n")):
        size = len(body)
        own = reaching
        while fresh < len(starts) and (starts[fresh] <= at + size or number == last):
            own.append(fresh)
            fresh += 1
        ends, opened, points = {}, {}, {}
        for m in own:
            a, b = min(max(starts[m] - at, 0), size), min(max(stops[m] - at, 0), size)
            if a < b:
                ends[m] = b
                opened.setdefault(a, []).append(m)
            elif starts[m] == stops[m]:
                points.setdefault(a, []).append(m)
        places = sorted({0, size, *ends.values(), *opened, *points})
        stack, out = [], []
        for place, following in zip(places, [*places[1:], size], strict=True):
            want = [m for m in stack if ends[m] > place] + opened.get(place, [])
            kept = next((i for i, (x, y) in enumerate(zip(stack, want, strict=False)) if x != y), min(len(stack), len(want)))
            out += [closing[m] for m in reversed(stack[kept:])]
            out += [opening[m] + closing[m] for m in points.get(place, [])]
            out += [opening[m] for m in want[kept:]]
            out.append(escape(body[place:following]).replace("&#x27;", "&#39;"))
            stack = want
        yield number, "".join(out)
        at += size + 1
        reaching = [m for m in own if stops[m] > at]


def rendered(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, line, html) of docs (doc, text) and marks (doc, start, length, tag)."""
    inside = marks.select("doc", F.greatest("start", F.lit(0)).alias("start"), (F.col("start") + F.col("length")).alias("stop"), "tag", "length").where("start is not null and length >= 0 and stop >= start")
    # Outside in: the earlier, then the longer mark.
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("back"), "tag")))
    of = inside.groupBy("doc").agg(order.alias("marks"))
    none = F.array().cast(of.schema["marks"].dataType)
    each = docs.select("doc", "text").where("doc is not null and text is not null").join(of, "doc", "left").withColumn("marks", F.coalesce("marks", none))
    each = each.select("doc", "text", F.col("marks.start").alias("starts"), F.transform("marks", lambda m: -m["back"]).alias("stops"), F.col("marks.tag").alias("tags"))
    return unfolded(each, ["doc"], shown, "line int, html string", ["text"], ["starts", "stops", "tags"])


def whole(rows: DataFrame) -> DataFrame:
    """(doc, html): the lines of each text, joined."""
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "html"))), lambda x: x["html"]), "\n").alias("html"))


def interleaved(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, nth, status, html): the lines of the diff of pairs (key, old, new), in place, each from the rendering
    (doc, line, html) of its side: what is kept or inserted from the new one, what is deleted from the old one.

    Edits and renderings go to the task of their key once, and meet there by side and line."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    side = lambda rows, deleted: rows.select(F.col("doc").alias("key"), F.lit(deleted).alias("deleted"), "line", none("int", "nth"), none("string", "status"), "html")
    edits = line_edits(pairs).select("key", (F.col("status") == "DELETION").alias("deleted"), "line", "nth", "status", none("string", "html"))
    met = edits.unionByName(side(old, True)).unionByName(side(new, False)).where("key is not null").repartition("key")
    both = met.groupBy("key", "deleted", "line").agg(*[F.max(c).alias(c) for c in ("nth", "status", "html")])
    return both.where("nth is not null and html is not null").select("key", "nth", "status", "html")


#: What the queries mark: long words, and sentences around them.
MARKED = {"b": "[a-z]{8,}", "i": "[^.\n]+[.]"}


def found_marks(docs: DataFrame, patterns: dict[str, str] = MARKED) -> DataFrame:
    """(doc, start, length, tag): all matches of each pattern in (doc, text)."""
    compiled = {tag: re.compile(p) for tag, p in patterns.items()}

    matches = lambda text: ((m.start(), len(m[0]), tag) for tag, p in compiled.items() for m in p.finditer(text or ""))
    return unfolded(spread(docs.select("doc", "text")), ["doc"], matches, "start int, length int, tag string", ["text"])


def _documents(spark, root):
    return table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text")


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_HTML = f"array_to_string(list_transform(string_split({{0}}, chr(10)), lambda x: regexp_replace(regexp_replace({_ESCAPED.format('x')}, '([a-z]{{{{8,}}}})', '<b>\\1</b>', 'g'), '([^.]+[.])', '<i>\\1</i>', 'g')), chr(10))"


@query("ivl03_rendered_texts", f"SELECT doc_id AS doc, length({_HTML.format('text')}) AS size, sha256({_HTML.format('text')}) AS sha FROM documents")
def ivl03_rendered(spark, root):
    """Every text with its long words and sentences marked."""
    docs = _documents(spark, root)
    return whole(rendered(docs, found_marks(docs))).select("doc", F.length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha"))


@query("diff05_rendered_sides", f"SELECT a.doc_id AS key, sha256({_HTML.format('a.text')}) AS old_sha, sha256({_HTML.format('b.text')}) AS new_sha FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def diff05_rendered(spark, root):
    """Neighbouring texts, rendered and interleaved; each side read back from the interleaved lines."""
    docs = _documents(spark, root)
    html = rendered(docs, found_marks(docs))
    new = html.select((F.col("doc") - 1).alias("doc"), "line", "html")
    pairs = docs.select(F.col("doc").alias("key"), F.col("text").alias("old")).join(docs.select((F.col("doc") - 1).alias("key"), F.col("text").alias("new")), "key")
    rows = interleaved(pairs, html, new)
    side = lambda skip: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != skip, F.struct("nth", "html")))), lambda x: x["html"]), "\n"), 256)
    return rows.groupBy("key").agg(side("INSERTION").alias("old_sha"), side("DELETION").alias("new_sha"))


def annotated(spark, root) -> DataFrame:
    """Texts stored with their marks as an array of structs, written when first asked for."""

    def write(path: str) -> DataFrame:
        docs = _documents(spark, root)
        mark = F.struct("start", "length", "tag")
        held = found_marks(docs).groupBy("doc").agg(F.array_sort(F.collect_list(mark)).alias("annotations"))
        none = F.array().cast("array<struct<start:int,length:int,tag:string>>")
        docs.join(held, "doc", "left").withColumn("annotations", F.coalesce("annotations", none)).write.parquet(path)
        return spark.read.schema("doc long, text string, annotations array<struct<start:int,length:int,tag:string>>").parquet(path)

    return once(spark, (root, "annotated"), write)


@query("src17_pruned_annotations", "SELECT doc_id AS doc, CAST(len(regexp_extract_all(text, '[a-z]{8,}')) AS INT) AS words, CAST(len(regexp_extract_all(text, '[^.\n]+[.]')) AS INT) AS sentences FROM documents")
def src17(spark, root):
    """Marks of each kind: the scan reads the tags alone, neither texts nor ranges."""
    tags = F.col("annotations.tag")
    count = lambda tag: F.size(F.filter(tags, lambda x: x == tag))
    return annotated(spark, root).select("doc", count("b").alias("words"), count("i").alias("sentences"))
