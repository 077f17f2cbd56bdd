"""Interval sets and list diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.tables import dealt, table, unfolded

SPANS = ", spans AS (SELECT l_orderkey AS id, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS start, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) + CAST(l_quantity AS INT) AS stop, l_linenumber AS n FROM lineitem)"
ISLANDS = f"{SPANS}, marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked), merged AS (SELECT id, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY id, island)"


def spans(spark, root) -> DataFrame:
    """(id, start, stop, n): half-open ranges, many an id."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("id"), day.alias("start"), (day + F.rint("l_quantity").cast("int")).alias("stop"), F.col("l_linenumber").alias("n"))


def coalesced(frame: DataFrame) -> DataFrame:
    """Ranges that touch or overlap become one: gaps and islands with a running maximum. Tasks grow in number with the input, not in size."""
    frame = dealt(frame, "id")
    ordered = W.partitionBy("id").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("stop"))
    before = F.max("stop").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    marked = frame.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    island = F.sum("fresh").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


@query("win05_coalesced_ranges", f"{ISLANDS} SELECT id, start, stop FROM merged")
def win05(spark, root):
    return coalesced(spans(spark, root))


@query("ivl01_range_set", f"{ISLANDS} SELECT id, count(*) AS ranges, CAST(sum(stop - start) AS BIGINT) AS covered, max(CASE WHEN start <= 3000 AND stop > 3000 THEN 1 ELSE 0 END) AS contains_day FROM merged GROUP BY id")
def ivl01(spark, root):
    contains = F.max(((F.col("start") <= 3000) & (F.col("stop") > 3000)).cast("int"))
    return coalesced(spans(spark, root)).groupBy("id").agg(F.count("*").alias("ranges"), F.sum(F.col("stop") - F.col("start")).alias("covered"), contains.alias("contains_day"))


@query("join20_interval_overlap", f"{SPANS} SELECT a.id, a.n AS n1, b.n AS n2, count(*) AS c FROM spans a JOIN spans b ON a.id = b.id AND a.n < b.n AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")
def join20(spark, root):
    """Overlaps within an id: equality on the id, the rest as a residual."""
    a = spans(spark, root).select("id", F.col("start").alias("s1"), F.col("stop").alias("e1"), F.col("n").alias("n1"))
    b = spans(spark, root).select("id", F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("n").alias("n2"))
    return a.join(b, "id").where("n1 < n2 and s1 < e2 and s2 < e1").groupBy("id", "n1", "n2").agg(F.count("*").alias("c"))


def merged_spans(frame: DataFrame) -> DataFrame:
    """(id, start, stop, styles, ref) of (id, start, stop, style, ref): one row a range, with the styles of all in order and the
    one reference among them. Two different references on one range are an error that names it."""
    refs = F.collect_set("ref")
    where = F.concat_ws(" ", F.lit("more than one reference at"), F.col("id").cast("string"), F.col("start").cast("string"), F.col("stop").cast("string"))
    out = frame.groupBy("id", "start", "stop").agg(F.array_sort(F.collect_set("style")).alias("styles"), refs.alias("refs"))
    return out.select("id", "start", "stop", "styles", F.when(F.size("refs") > 1, F.raise_error(where)).otherwise(F.get("refs", F.lit(0))).alias("ref"))


@query("ivl02_merge_equal_spans", f"{SPANS} SELECT id, start, stop, array_to_string(list_sort(list(DISTINCT n)), ',') AS styles, CASE WHEN start % 3 = 0 THEN id * 7 + stop END AS ref FROM spans GROUP BY id, start, stop")
def ivl02(spark, root):
    """Styles of equal ranges united; some ranges refer to something, each to one thing."""
    marks = spans(spark, root).select("id", "start", "stop", F.col("n").alias("style"), F.when(F.col("start") % 3 == 0, F.col("id") * 7 + F.col("stop")).alias("ref"))
    return merged_spans(marks).select("id", "start", "stop", F.array_join(F.transform("styles", lambda x: x.cast("string")), ",").alias("styles"), "ref")


@query("ivl03_event_sweep", f"{SPANS}, e AS (SELECT id, start AS place, 1 AS d FROM spans UNION ALL SELECT id, stop, -1 FROM spans), s AS (SELECT id, place, sum(d) AS d FROM e GROUP BY ALL) SELECT id, max(level) AS deepest FROM (SELECT id, sum(d) OVER (PARTITION BY id ORDER BY place) AS level FROM s) GROUP BY id")
def ivl03(spark, root):
    """The greatest nesting depth, by opening and closing events."""
    each = spans(spark, root)
    events = each.select("id", F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(each.select("id", F.col("stop").alias("at"), F.lit(-1).alias("d")))
    steps = events.groupBy("id", "at").agg(F.sum("d").alias("d"))
    return steps.withColumn("open", F.sum("d").over(W.partitionBy("id").orderBy("at"))).groupBy("id").agg(F.max("open").alias("deepest"))


@query("sort08_annotation_order", f"{SPANS} SELECT id, start, stop, n, row_number() OVER (PARTITION BY id ORDER BY start, stop <> start, stop DESC, n) AS place FROM spans")
def sort08(spark, root):
    place = F.row_number().over(W.partitionBy("id").orderBy("start", F.col("stop") != F.col("start"), F.desc("stop"), "n"))
    return spans(spark, root).withColumn("place", place)


def histogram_diff(old: list, new: list) -> list[tuple[object, str]]:
    """Items with UNCHANGED, DELETION or INSERTION; anchored at the rarest common items, deletions first."""
    out: list[tuple[object, str]] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((old[a], "UNCHANGED"))
            a, c = a + 1, c + 1
        tail = 0
        while tail < min(b - a, d - c) and old[b - 1 - tail] == new[d - 1 - tail]:
            tail += 1
        if tail:
            todo += [(b - tail, b, d - tail, d), (a, b - tail, c, d - tail)]
            continue
        places: dict = {}
        for i in range(a, b):
            places.setdefault(old[i], []).append(i)
        best = min(((len(places[new[j]]), j) for j in range(c, d) if new[j] in places), default=None)
        if best is None:
            out += [(x, "DELETION") for x in old[a:b]] + [(x, "INSERTION") for x in new[c:d]]
        else:
            i, j = places[new[best[1]]][0], best[1]
            todo += [(i, b, j, d), (a, i, c, j)]
    return out


def lines(text: str | None) -> list[str]:
    """A null text has no lines, an empty one has one."""
    return text.split("\n") if isinstance(text, str) else []


def line_diff(pairs: DataFrame) -> DataFrame:
    """(key, line, text, status) of each (key, old, new)."""

    edits = lambda old, new: ((i, t, s) for i, (t, s) in enumerate(histogram_diff(lines(old), lines(new))))
    return unfolded(pairs, ["key"], edits, "line int, text string, status string", ["old", "new"])


def line_edits(pairs: DataFrame) -> DataFrame:
    """(key, nth, line, status) of each (key, old, new): every edit's line, counted in the old text if it is deleted, else in the new one."""

    def edits(old, new):
        at = {True: -1, False: -1}
        for nth, (_, status) in enumerate(histogram_diff(lines(old), lines(new))):
            deleted = status == "DELETION"
            at[deleted] += 1
            if status == "UNCHANGED":
                at[True] += 1
            yield nth, at[deleted], status

    return unfolded(pairs, ["key"], edits, "nth int, line int, status string", ["old", "new"])


def _pairs(spark, root):
    docs = table(spark, root, "documents")
    old = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("old"))
    new = docs.select((F.col("doc_id") - 1).alias("key"), F.col("text").alias("new"))
    return old.join(new, "key")


@query("diff01_rebuilt_from_edits", "SELECT a.doc_id AS key, sha256(a.text) AS old_sha, sha256(b.text) AS new_sha FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def diff01(spark, root):
    """Old and new text rebuilt from the edits of their diff: what any right diff must give."""
    edits = line_diff(_pairs(spark, root))
    side = lambda skip: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != skip, F.struct("line", "text")))), lambda x: x["text"]), "\n"), 256)
    return edits.groupBy("key").agg(side("INSERTION").alias("old_sha"), side("DELETION").alias("new_sha"))


@query("diff05_line_totals")
def diff05(spark, root):
    """Inserted and deleted lines between neighbouring documents (no SQL twin: depends on the algorithm)."""
    return line_diff(_pairs(spark, root)).groupBy("key").agg(F.count_if(F.col("status") == "INSERTION").alias("inserted"), F.count_if(F.col("status") == "DELETION").alias("deleted"))


@query("agg15_net_lines", "SELECT a.doc_id AS key, len(string_split(b.text, chr(10))) - len(string_split(a.text, chr(10))) AS net FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def agg15(spark, root):
    return diff05(spark, root).select("key", (F.col("inserted") - F.col("deleted")).alias("net"))
