"""Brackets and what encloses what, by windows over their places.

A bracket's partner and the innermost enclosing one follow from the depth, a running sum over the brackets
of a document in order of place: an opening bracket and the next closing one of its depth belong together;
what encloses a range of depth d is the last one before it that opened at depth d - 1. Both are one window
over (document, depth); there is no join of ranges.

Blocks of sources are declarations of a kind told by what stands before their bracket: types, methods,
lambdas, anonymous bodies and initialisers. Statements' blocks are none, so what they hold belongs to the
declaration around them.

Brackets without a partner, and null texts, take no part; brackets in comments and literals are no brackets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.extract import sources
from codeweft.sources.tables import table, unfolded

#: Comments, strings and characters, and the brackets of blocks.
_SCAN = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[{}]", re.DOTALL)


def brackets(docs: DataFrame, before: int = 200) -> DataFrame:
    """(doc, place, opens, head) of (doc, text): each bracket, and for an opening one what stands between it and the last `{`, `}` or `;`."""

    def found(text):
        code = re.sub(_SCAN, lambda m: m[0] if m[0] in "{}" else re.sub(r"[^\n]", " ", m[0]), text or "")
        for m in re.finditer("[{}]", code):
            head = code[max(0, m.start() - before) : m.start()] if m[0] == "{" else ""
            yield m.start(), m[0] == "{", re.split(r"[{};]", head)[-1].strip()

    return unfolded(docs, ["doc"], found, "place int, opens boolean, head string", ["text"])


def ranges(marks: DataFrame) -> DataFrame:
    """(doc, start, stop, ...) of brackets (doc, place, opens, ...): each opening one with the place of its partner."""
    running = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(W.partitionBy("doc").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    leveled = marks.withColumn("level", running + F.when(F.col("opens"), 0).otherwise(1))
    ahead = W.partitionBy("doc", "level").orderBy("place")
    paired = leveled.withColumns({"stop": F.lead("place").over(ahead), "closed": ~F.lead("opens").over(ahead)})
    return paired.where("opens and closed").drop("opens", "closed", "level").withColumnRenamed("place", "start")


def enclosed(rows: DataFrame) -> DataFrame:
    """Adds `parent`, the start of the innermost range around each of (doc, start, stop, ...); ranges nest, starts are unique."""
    ends = rows.select("doc", F.explode(F.array(F.struct(F.col("start").alias("place"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("place"), F.lit(-1).alias("d")))).alias("e")).select("doc", "e.*")
    depth = F.sum("d").over(W.partitionBy("doc").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    depths = ends.withColumn("depth", depth).where("d = 1").select("doc", F.col("place").alias("start"), "depth")
    # Each range stands among those of its own depth, for what it may enclose, and among those around it.
    both = depths.select("doc", "start", F.explode(F.array(F.struct(F.col("depth").alias("group"), F.lit(True).alias("outer")), F.struct((F.col("depth") - 1).alias("group"), F.lit(False).alias("outer")))).alias("g")).select("doc", "start", "g.*")
    last = F.last(F.when(F.col("outer"), F.col("start")), ignorenulls=True).over(W.partitionBy("doc", "group").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow))
    parents = both.withColumn("parent", last).where("not outer").select("doc", "start", "parent")
    return rows.join(parents, ["doc", "start"])


def kind_of(head: Column) -> Column:
    """What a block declares, by the text before its bracket; null for blocks of statements."""
    return (
        F.when(head.rlike(r"->\s*$"), "lambda")
        .when(head.rlike(r"\bnew\s+[\w.]+\s*(<[^()]*>)?\s*\([^{}]*\)\s*$"), "anonymous")
        .when(head.rlike(r"\b(class|interface|enum|record)\s+\w+"), "type")
        .when((head == "") | (head == "static"), "initializer")
        .when(head.rlike(r"^(else|do|try|finally)$|\b(if|for|while|switch|catch|synchronized|try)\s*\("), None)
        .when(head.rlike(r"\w+\s*\([^{}]*\)\s*(throws\s+[\w., ]+)?$"), "method")
        .when(head.rlike(r"(^|,)\s*\w+$"), "anonymous")  # the body of an enum's constant
    )


def declarations(docs: DataFrame) -> DataFrame:
    """(doc, start, stop, kind, parent, parent_kind) of the declaring blocks of sources (doc, text)."""
    blocks = ranges(brackets(docs)).withColumn("kind", kind_of(F.col("head"))).where("kind is not null").select("doc", "start", "stop", "kind")
    found = enclosed(blocks)
    return found.join(blocks.select("doc", F.col("start").alias("parent"), F.col("kind").alias("parent_kind")), ["doc", "parent"], "left").select("doc", "start", "stop", "kind", "parent", "parent_kind")


@query("udtf07_enclosing_declarations", """, said AS (SELECT conv_id, turn, length(text) % 4 AS n FROM conversations), found AS (
  SELECT conv_id AS doc, 'type' AS kind, NULL AS parent_kind, 1 AS n FROM (SELECT DISTINCT conv_id FROM said) UNION ALL SELECT conv_id, 'initializer', 'type', 1 FROM (SELECT DISTINCT conv_id FROM said)
  UNION ALL SELECT conv_id, k, p, 1 FROM said, (VALUES ('method', 'type'), ('anonymous', 'method'), ('initializer', 'anonymous'), ('method', 'anonymous')) t(k, p)
  UNION ALL SELECT conv_id, 'lambda', 'method', 1 FROM said WHERE n > 0 UNION ALL SELECT conv_id, 'lambda', 'lambda', n - 1 FROM said WHERE n > 1)
SELECT doc, kind, parent_kind, CAST(sum(n) AS BIGINT) AS count FROM found GROUP BY ALL""")
def udtf07(spark, root):
    """What each declaration of the sources is enclosed by."""
    return declarations(sources(spark, root)).groupBy("doc", "kind", "parent_kind").agg(F.count("*").alias("count"))


#: Elements of pages in place of brackets.
_TAGS = r"</?[a-zA-Z][a-zA-Z0-9]*[^<>]*>"


@query("udtf07_enclosing_ranges", f"""
, hits AS (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS h, string_split_regex(html, '{_TAGS}') AS g FROM pages),
tags AS (SELECT page_id, i, hit LIKE '</%' AS closes, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY page_id ORDER BY i) - length(hit) AS INT) AS place FROM (SELECT page_id, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM hits)),
runs AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS after FROM tags),
pairs AS (SELECT o.page_id, o.place AS start, min(c.place) AS stop FROM runs o JOIN runs c ON c.page_id = o.page_id AND c.i > o.i AND c.closes AND c.after = o.after - 1 WHERE NOT o.closes GROUP BY ALL)
SELECT a.page_id AS doc, a.start, a.stop, max(b.start) AS parent FROM pairs a LEFT JOIN pairs b ON a.page_id = b.page_id AND b.start < a.start AND b.stop > a.stop GROUP BY ALL""")
def udtf07_ranges(spark, root):
    """Pages' elements as ranges by the order of their tags, and the innermost one around each."""
    pattern = re.compile(_TAGS)

    tags = lambda html: ((m.start(), not m[0].startswith("</")) for m in pattern.finditer(html or ""))
    marks = unfolded(table(spark, root, "pages"), ["page_id"], tags, "place int, opens boolean", ["html"]).withColumnRenamed("page_id", "doc")
    return enclosed(ranges(marks)).select("doc", "start", "stop", "parent")
