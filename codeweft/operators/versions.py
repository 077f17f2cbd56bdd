"""Version order and version-aware lookups.

Order: parts between dots and slashes; at the first difference numeric parts come before others,
larger numbers first, other parts by code point; a prefix comes first. "Newest" is the minimum.
The published comparison is not transitive for mixed parts; this total order is a deliberate choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.tables import placed, table
from codeweft.sources.views import artifacts, bindings


def version_key(version: Column) -> Column:
    """An array that orders versions, newest first."""
    number = lambda p: p.rlike("^[0-9]{1,18}$")
    return F.transform(F.split(version, "[./]"), lambda p: F.struct(F.when(number(p), 0).otherwise(1).alias("kind"), F.when(number(p), -F.try_to_number(p, F.lit("9" * 18)).cast("long")).otherwise(F.lit(0).cast("long")).alias("number"), F.when(number(p), "").otherwise(p).alias("text")))


KEY = "list_transform(regexp_split_to_array(version, '[./]'), lambda p: {'kind': CASE WHEN regexp_full_match(p, '[0-9]{1,18}') THEN 0 ELSE 1 END, 'number': CASE WHEN regexp_full_match(p, '[0-9]{1,18}') THEN -CAST(p AS BIGINT) ELSE 0 END, 'text': CASE WHEN regexp_full_match(p, '[0-9]{1,18}') THEN '' ELSE p END})"
KEYED = f", keyed AS (SELECT *, {KEY} AS k FROM artifacts)"


def keyed(spark, root):
    return artifacts(spark, root).withColumn("k", version_key(F.col("version")))


@query("ver01_newest_first", f"{KEYED} SELECT coordinate, version, row_number() OVER (PARTITION BY coordinate ORDER BY k) AS place FROM keyed")
def ver01(spark, root):
    return keyed(spark, root).select("coordinate", "version", F.row_number().over(W.partitionBy("coordinate").orderBy("k")).alias("place"))


@query("sort05_global_version_order", f"{KEYED} SELECT artifact_id, version, row_number() OVER (ORDER BY k, artifact_id) AS place FROM keyed")
def sort05(spark, root):
    return placed(keyed(spark, root).select("artifact_id", "version", "k"), ["k", "artifact_id"]).select("artifact_id", "version", "place")


@query("agg13_versions_of_coordinate", f"{KEYED} SELECT coordinate, count(*) AS versions, min_by(version, k) AS newest FROM keyed GROUP BY coordinate")
def agg13(spark, root):
    return keyed(spark, root).groupBy("coordinate").agg(F.count("*").alias("versions"), F.min_by("version", "k").alias("newest"))


@query("join17_outdated_versions", f"{KEYED} SELECT a.coordinate, a.version FROM keyed a WHERE NOT EXISTS (SELECT 1 FROM (SELECT coordinate, min_by(version, k) AS newest FROM keyed GROUP BY coordinate) n WHERE n.coordinate = a.coordinate AND n.newest = a.version)")
def join17(spark, root):
    at = keyed(spark, root)
    newest = at.groupBy("coordinate").agg(F.min_by("version", "k").alias("version"))
    return at.join(newest, ["coordinate", "version"], "left_anti").select("coordinate", "version")


WANTED = ", wanted AS (SELECT DISTINCT s_suppkey AS id, lower(r_name) || '/' || lower(n_name) AS coordinate, CAST(s_suppkey % 11 AS VARCHAR) || '.3' AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def nearest_versions(at: DataFrame) -> DataFrame:
    """(id, after, before): of the wanted versions of each artifact's library the next at or after it, and the last before it.

    Versions and wishes stand in one order, where running values carry the nearest version to each wish from either
    side: no pairs of a library's rows are built.
    """
    asked = at.select("coordinate", F.col("artifact_id").alias("id"), F.lit(None).cast("string").alias("version"), version_key(F.concat((F.col("artifact_id") % 11).cast("string"), F.lit(".3"))).alias("k"), F.lit(0).alias("kind"))
    known = at.where("coordinate is not null").select("coordinate", F.lit(None).cast("long").alias("id"), "version", "k", F.lit(1).alias("kind"))
    both = asked.unionByName(known.dropDuplicates(["coordinate", "version"]))
    running = lambda *order: F.last(F.col("version"), ignorenulls=True).over(W.partitionBy("coordinate").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    # A version equal to a wish counts as after it: it comes behind the wish ascending, and so before it descending.
    found = both.withColumn("before", running("k", "kind")).withColumn("after", running(F.desc("k"), F.desc("kind")))
    return found.where("kind = 0").select("id", "after", "before")


@query("join11_nearest_version", f"""{KEYED}{WANTED}, asked AS (SELECT *, {KEY} AS k FROM wanted)
SELECT w.id, coalesce((SELECT min_by(a.version, a.k) FROM keyed a WHERE a.coordinate = w.coordinate AND a.k >= w.k),
  (SELECT max_by(a.version, a.k) FROM keyed a WHERE a.coordinate = w.coordinate AND a.k < w.k)) AS version FROM asked w""")
def join11(spark, root):
    """The nearest version at or after the wanted one in newest-first order, else the one before."""
    return nearest_versions(keyed(spark, root)).select("id", F.coalesce("after", "before").alias("version"))


@query("ver02_ceiling_of_version", f"{KEYED}{WANTED}, asked AS (SELECT *, {KEY} AS k FROM wanted) SELECT w.id, (SELECT min_by(a.version, a.k) FROM keyed a WHERE a.coordinate = w.coordinate AND a.k >= w.k) AS version FROM asked w")
def ver02(spark, root):
    return nearest_versions(keyed(spark, root)).select("id", F.col("after").alias("version"))


@query("join12_alias_resolution", """, alias AS (SELECT artifact_id, coordinate || '/' || (artifact_id % 3) AS alias FROM artifacts),
asked AS (SELECT artifact_id AS id, coordinate || '/' || (artifact_id % 6) AS wanted, coordinate FROM artifacts)
SELECT a.id, coalesce((SELECT min(artifact_id) FROM alias WHERE alias = wanted), (SELECT min(artifact_id) FROM alias WHERE regexp_replace(alias, '/[^/]*$', '') = a.coordinate)) AS resolved FROM asked a""")
def join12(spark, root):
    """An exact alias, else one that agrees up to the last slash."""
    at = artifacts(spark, root)
    alias = at.select("artifact_id", F.concat("coordinate", F.lit("/"), (F.col("artifact_id") % 3).cast("string")).alias("alias"))
    exact = alias.groupBy(F.col("alias").alias("wanted")).agg(F.min("artifact_id").alias("exact"))
    near = alias.groupBy(F.regexp_replace("alias", "/[^/]*$", "").alias("coordinate")).agg(F.min("artifact_id").alias("near"))
    asked = at.select(F.col("artifact_id").alias("id"), F.concat("coordinate", F.lit("/"), (F.col("artifact_id") % 6).cast("string")).alias("wanted"), "coordinate")
    return asked.join(exact, "wanted", "left").join(near, "coordinate", "left").select("id", F.coalesce("exact", "near").alias("resolved"))


CLASSPATH = [7, 3, 9, 1]


@query("join13_classpath_priority", ", path AS (SELECT artifact_id, pos FROM (VALUES (7, 0), (3, 1), (9, 2), (1, 3)) t(artifact_id, pos)) SELECT binding, coalesce(min_by(artifact_id, pos), min(CASE WHEN pos IS NULL THEN artifact_id END)) AS artifact_id, count(pos) > 0 AS on_path FROM bindings LEFT JOIN path USING (artifact_id) GROUP BY binding")
def join13(spark, root):
    """The first artifact of the classpath that declares a binding, else the least that does."""
    path = spark.createDataFrame([(a, i) for i, a in enumerate(CLASSPATH)], "artifact_id long, pos int")
    found = bindings(spark, root).join(F.broadcast(path), "artifact_id", "left")
    return found.groupBy("binding").agg(F.coalesce(F.min_by("artifact_id", "pos"), F.min(F.when(F.col("pos").isNull(), F.col("artifact_id")))).alias("artifact_id"), (F.count("pos") > 0).alias("on_path"))


@query("join16_missing_dependencies", ", deps AS (SELECT DISTINCT l_suppkey AS from_artifact, 'region/' || p_brand AS to_artifact FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT to_artifact FROM deps WHERE NOT EXISTS (SELECT 1 FROM artifacts WHERE 'region/Brand#' || (artifact_id % 10) = to_artifact)")
def join16(spark, root):
    lines = table(spark, root, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    deps = lines.join(table(spark, root, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.concat(F.lit("region/"), "p_brand").alias("to_artifact")).distinct()
    known = artifacts(spark, root).select(F.concat(F.lit("region/Brand#"), (F.col("artifact_id") % 10).cast("string")).alias("to_artifact"))
    return deps.join(known, "to_artifact", "left_anti")


@query("agg17_newest_of_equal_names", f"{KEYED} SELECT binding, min_by(artifact_id, k) AS artifact_id FROM bindings JOIN keyed USING (artifact_id) GROUP BY binding")
def agg17(spark, root):
    return bindings(spark, root).join(keyed(spark, root), "artifact_id").groupBy("binding").agg(F.min_by("artifact_id", "k").alias("artifact_id"))


@query("agg18_without_superseded", f"{KEYED}, n AS (SELECT b.binding, b.binding_id, k, min(k) OVER (PARTITION BY b.binding) AS best FROM bindings b JOIN keyed USING (artifact_id)) SELECT binding, binding_id FROM n WHERE k = best")
def agg18(spark, root):
    found = bindings(spark, root).join(keyed(spark, root), "artifact_id").withColumn("best", F.min("k").over(W.partitionBy("binding")))
    return found.where("k = best").select("binding", "binding_id")


@query("win02_collapse_equal_neighbours", "SELECT binding, binding_id FROM (SELECT binding, binding_id, lag(binding) OVER (ORDER BY binding, binding_id) AS before FROM bindings) WHERE before IS DISTINCT FROM binding")
def win02(spark, root):
    """The first of consecutive equal names: the least id of each name, without a global order."""
    return bindings(spark, root).groupBy("binding").agg(F.min("binding_id").alias("binding_id"))


@query("prj05_diff_orientation", f"{KEYED} SELECT a.artifact_id AS left_id, b.artifact_id AS right_id, CASE WHEN a.k <= b.k THEN 'newer' ELSE 'older' END AS side FROM keyed a JOIN keyed b ON a.coordinate = b.coordinate AND a.artifact_id < b.artifact_id")
def prj05(spark, root):
    a, b = (keyed(spark, root).select(F.col("artifact_id").alias(f"{s}_id"), F.col("k").alias(f"{s}_k"), "coordinate") for s in ("left", "right"))
    return a.join(b, "coordinate").where("left_id < right_id").select("left_id", "right_id", F.when(F.col("left_k") <= F.col("right_k"), "newer").otherwise("older").alias("side"))


@query("agg11_duplicate_coordinates", "SELECT coordinate, count(*) AS count FROM artifacts GROUP BY coordinate HAVING count(*) > 1")
def agg11(spark, root):
    return artifacts(spark, root).groupBy("coordinate").agg(F.count("*").alias("count")).where("count > 1")


@query("flt15_stale_artifacts", "SELECT artifact_id FROM artifacts WHERE artifact_id NOT IN (SELECT o_custkey % 120 FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 5 DAY)")
def flt15(spark, root):
    """Artifacts that no compilation of the last five days brought up to date: an anti join with those that are."""
    compiled = table(spark, root, "orders").select((F.col("o_custkey") % 120).alias("artifact_id"), "o_orderdate")
    last = compiled.agg(F.max("o_orderdate").alias("last"))
    current = compiled.join(F.broadcast(last)).where(F.col("o_orderdate") >= F.col("last") - F.expr("interval 5 days"))  # one row on the right
    return artifacts(spark, root).select("artifact_id").join(current, "artifact_id", "left_anti")
