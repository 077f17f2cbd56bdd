"""Reference lookup: counts, cross-tabs, joins with files and bindings, per-group limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.tables import placed
from codeweft.sources.views import artifacts, bindings, files, references

FILE = ["realm", "artifact_id", "source_file_id"]


def counts(spark: SparkSession, root: str) -> DataFrame:
    """The summary that other queries read: references by realm, target, type and citing artifact."""
    return references(spark, root).groupBy("realm", "target", "type", "source_artifact_id").agg(F.count("*").alias("count"))


COUNTS = "SELECT realm, target, type, source_artifact_id, count(*) AS count FROM refs GROUP BY ALL"


@query("agg01_reference_counts", COUNTS)
def agg01(spark, root):
    return counts(spark, root)


@query("agg02_here_and_elsewhere", "SELECT target, type, CAST(sum(CASE WHEN source_artifact_id = 1 THEN 1 ELSE 0 END) AS BIGINT) AS here, count(*) AS everywhere FROM refs WHERE realm = 0 GROUP BY ALL")
def agg02(spark, root):
    here = F.sum(F.when(F.col("source_artifact_id") == 1, F.col("count")).otherwise(0))
    return counts(spark, root).where("realm = 0").groupBy("target", "type").agg(here.alias("here"), F.sum("count").alias("everywhere"))


@query("agg03_crosstab_with_totals", "SELECT target, source_artifact_id, type, count(*) AS count, CAST(grouping(source_artifact_id) AS INT) AS all_artifacts, CAST(grouping(type) AS INT) AS all_types FROM refs GROUP BY GROUPING SETS ((target, source_artifact_id, type), (target, type), (target, source_artifact_id), (target))")
def agg03(spark, root):
    a, t = F.col("source_artifact_id"), F.col("type")
    tabbed = references(spark, root).groupingSets([["target", "source_artifact_id", "type"], ["target", "type"], ["target", "source_artifact_id"], ["target"]], "target", a, t)
    return tabbed.agg(F.count("*").alias("count"), F.grouping(a).cast("int").alias("all_artifacts"), F.grouping(t).cast("int").alias("all_types"))


@query("agg04_selection_total", "SELECT target, count(*) FILTER (type = 1 AND source_artifact_id = 2) AS by_both, count(*) FILTER (type = 1) AS by_type, count(*) FILTER (source_artifact_id = 2) AS by_artifact, count(*) AS total, count(*) FILTER (type = 1) > 5 AS over_limit FROM refs GROUP BY target")
def agg04(spark, root):
    typed, here = F.col("type") == 1, F.col("source_artifact_id") == 2
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    out = counts(spark, root).groupBy("target").agg(count(typed & here).alias("by_both"), count(typed).alias("by_type"), count(here).alias("by_artifact"), F.sum("count").alias("total"))
    return out.withColumn("over_limit", F.col("by_type") > 5)


REF_FILE = "refs r JOIN files f ON r.realm = f.realm AND r.source_artifact_id = f.artifact_id AND r.source_file_id = f.source_file_id"


def with_files(spark, root, how="inner"):
    return references(spark, root).withColumnRenamed("source_artifact_id", "artifact_id").join(files(spark, root), FILE, how)


@query("join01_references_with_files", f"SELECT r.type, r.source_artifact_id AS artifact_id, f.path, r.ref_id, r.line, r.target FROM {REF_FILE}")
def join01(spark, root):
    return with_files(spark, root).select("type", "artifact_id", "path", "ref_id", "line", "target")


@query("sort01_reference_listing", f"SELECT r.type, r.source_artifact_id AS artifact_id, f.path, r.ref_id, r.line, row_number() OVER (ORDER BY r.type, r.source_artifact_id, f.path, r.ref_id, r.line) AS place FROM {REF_FILE}")
def sort01(spark, root):
    """All references in the order of the listing."""
    listed = with_files(spark, root).select("type", "artifact_id", "path", "ref_id", "line")
    return placed(listed, ["type", "artifact_id", "path", "ref_id", "line"])


@query("sort02_own_artifact_first", "SELECT type, source_artifact_id, source_file_id, ref_id, target, row_number() OVER (ORDER BY type, source_artifact_id <> 3, source_artifact_id, source_file_id, ref_id, target, line) AS place FROM refs")
def sort02(spark, root):
    order = ["type", F.col("source_artifact_id") != 3, "source_artifact_id", "source_file_id", "ref_id", "target", "line"]
    return placed(references(spark, root), order).select("type", "source_artifact_id", "source_file_id", "ref_id", "target", "place")


@query("join02_bindings_with_files", "SELECT b.binding, f.path FROM bindings b JOIN files f USING (realm, artifact_id, source_file_id) WHERE b.include_in_type_search")
def join02(spark, root):
    return bindings(spark, root).where("include_in_type_search").join(files(spark, root), FILE).select("binding", "path")


@query("join03_bindings_artifacts_files", "SELECT b.binding, a.coordinate, a.version, f.path FROM bindings b JOIN artifacts a USING (artifact_id) JOIN files f USING (realm, artifact_id, source_file_id)")
def join03(spark, root):
    return bindings(spark, root).join(files(spark, root), FILE).join(artifacts(spark, root), "artifact_id").select("binding", "coordinate", "version", "path")


@query("join04_bindings_left_files", "SELECT b.binding_id, f.path FROM bindings b LEFT JOIN files f USING (realm, artifact_id, source_file_id)")
def join04(spark, root):
    return bindings(spark, root).join(files(spark, root), FILE, "left").select("binding_id", "path")


@query("join05_left_chain", "SELECT b.binding_id, a.version, f.path FROM bindings b LEFT JOIN artifacts a USING (artifact_id) LEFT JOIN files f USING (realm, artifact_id, source_file_id)")
def join05(spark, root):
    return bindings(spark, root).join(artifacts(spark, root), "artifact_id", "left").join(files(spark, root), FILE, "left").select("binding_id", "version", "path")


@query("join07_counts_of_bindings", "SELECT b.binding, r.type, r.source_artifact_id, count(*) AS count FROM refs r JOIN (SELECT DISTINCT realm, binding_id, binding FROM bindings) b ON r.target = b.binding_id AND r.realm = b.realm GROUP BY ALL")
def join07(spark, root):
    """Bindings are made distinct first: they recur by version, and would multiply the counts. Nearly every reference is a count
    of its own, so both sums are dealt over tasks whose number grows with the scan: what one of them holds keeps its size."""
    refs = references(spark, root)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * refs.rdd.getNumPartitions())
    named = bindings(spark, root).select("realm", F.col("binding_id").alias("target"), "binding").distinct()
    key = ["realm", "target", "type", "source_artifact_id"]
    each = refs.select(key).repartition(tasks, "realm", "target").groupBy(key).agg(F.count("*").alias("count"))
    out = ["binding", "type", "source_artifact_id"]
    return each.join(named, ["realm", "target"]).select(*out, "count").repartition(tasks, *out).groupBy(out).agg(F.sum("count").alias("count"))


TOPN = """, ranked AS (SELECT r.*, source_artifact_id = 1 AS here,
  row_number() OVER (PARTITION BY target, type, source_artifact_id = 1 ORDER BY source_artifact_id, source_file_id, ref_id, line) AS n FROM refs r),
limits AS (SELECT target, type, greatest(0, 3 - count(*) FILTER (source_artifact_id = 1)) AS rest FROM refs GROUP BY ALL)
SELECT target, type, source_artifact_id, source_file_id, ref_id, line FROM ranked JOIN limits USING (target, type)
WHERE CASE WHEN here THEN n <= 3 ELSE n <= rest END"""


@query("join08_dynamic_top_n", TOPN)
def join08(spark, root):
    """Per target and type: references of artifact 1 first, then others up to what is left of three."""
    order = ["source_artifact_id", "source_file_id", "ref_id", "line"]
    refs = references(spark, root).select("target", "type", *order, (F.col("source_artifact_id") == 1).alias("here"))
    # Three of each side at most are of use: tasks drop the rest before the shuffle, and count what is left.
    ranked = refs.withColumn("n", F.row_number().over(W.partitionBy("target", "type", "here").orderBy(*order))).where("n <= 3")
    held = F.count_if("here").over(W.partitionBy("target", "type"))
    return ranked.withColumn("held", held).where("here or n <= 3 - held").select("target", "type", *order)


@query("join09_scalar_subquery", "SELECT target, type, count(*) AS count FROM refs WHERE target = (SELECT min(binding_id) FROM bindings WHERE binding = 'com.small.BlueBolt2') GROUP BY ALL")
def join09(spark, root):
    wanted = bindings(spark, root).where("binding = 'com.small.BlueBolt2'").agg(F.min("binding_id").alias("target"))
    return references(spark, root).join(wanted, "target").groupBy("target", "type").agg(F.count("*").alias("count"))


@query("win06_nested_sections", "SELECT type, source_artifact_id, count(DISTINCT source_file_id) AS files, min(line) AS first_line, to_json(list(DISTINCT source_file_id ORDER BY source_file_id)) AS ids FROM refs WHERE target % 10 < 10 GROUP BY ALL")
def win06(spark, root):
    by_file = references(spark, root).groupBy("type", "source_artifact_id", "source_file_id").agg(F.min("line").alias("line"))
    out = by_file.groupBy("type", "source_artifact_id").agg(F.count("*").alias("files"), F.min("line").alias("first_line"), F.array_sort(F.collect_list("source_file_id")).alias("ids"))
    return out.withColumn("ids", F.to_json("ids"))


@query("win07_ids_within_file", "SELECT realm, source_file_id, ref_id, target, row_number() OVER (PARTITION BY realm, source_file_id ORDER BY source_artifact_id, ref_id, target, line, type) - 1 AS number FROM refs")
def win07(spark, root):
    w = W.partitionBy("realm", "source_file_id").orderBy("source_artifact_id", "ref_id", "target", "line", "type")
    return references(spark, root).select("realm", "source_file_id", "ref_id", "target", (F.row_number().over(w) - 1).cast("long").alias("number"))


@query("flt11_known_types_only", "SELECT type, count(*) AS count FROM refs WHERE type IN (1, 14, 18) AND NOT duplicate GROUP BY type")
def flt11(spark, root):
    """Unknown type ids drop out in a join with the dimension; duplicates are not counted."""
    known = spark.createDataFrame([(1,), (14,), (18,)], "type int")
    return references(spark, root).where("not duplicate").join(F.broadcast(known), "type").groupBy("type").agg(F.count("*").alias("count"))


@query("snk07_json_by_type", "SELECT target, to_json(map(list(CAST(type AS VARCHAR) ORDER BY type), list(n ORDER BY type))) AS json FROM (SELECT target, type, count(*) AS n FROM refs GROUP BY ALL) GROUP BY target")
def snk07(spark, root):
    by_type = references(spark, root).groupBy("target", "type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("type", "n")))
    keyed = F.map_from_entries(F.transform(entries, lambda x: F.struct(x["type"].cast("string"), x["n"])))
    return by_type.groupBy("target").agg(F.to_json(keyed).alias("json"))


@query("set01_local_and_foreign", "SELECT target, 'local' AS side, count(*) AS count FROM refs WHERE source_artifact_id = 1 GROUP BY target UNION ALL SELECT target, 'foreign', count(*) FROM refs WHERE source_artifact_id <> 1 GROUP BY target")
def set01(spark, root):
    refs = references(spark, root)
    count = lambda f, side: f.groupBy("target").agg(F.count("*").alias("count")).select("target", F.lit(side).alias("side"), "count")
    return count(refs.where("source_artifact_id = 1"), "local").unionByName(count(refs.where("source_artifact_id <> 1"), "foreign"))


@query("agg09_site_statistics", "SELECT (SELECT count(*) FROM artifacts) AS artifacts, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM bindings) AS bindings, (SELECT count(*) FROM bindings WHERE include_in_type_search) AS classes, (SELECT count(*) FROM refs) AS refs, (SELECT CAST(sum(len(regexp_split_to_array(text, ' '))) AS BIGINT) FROM documents) AS lexemes")
def agg09(spark, root):
    from codeweft.sources.tables import table

    one = lambda f, name: f.agg(F.count("*").alias(name))
    out = one(artifacts(spark, root), "artifacts")
    named = bindings(spark, root).agg(F.count("*").alias("bindings"), F.count_if("include_in_type_search").alias("classes"))
    lexemes = table(spark, root, "documents").agg(F.sum(F.size(F.split("text", " "))).alias("lexemes"))
    for f in (one(files(spark, root), "files"), named, one(references(spark, root), "refs"), lexemes):
        out = out.crossJoin(f)  # single rows on both sides
    return out
