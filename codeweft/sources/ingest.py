"""Ingest: extracted files are shredded into row kinds and written; stale artifacts are found and replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.porter import tokenize
from codeweft.plans.register import query
from codeweft.sources.store import Store
from codeweft.sources.tables import reachable, shared_folder, table, unfolded
from codeweft.sources.views import artifacts, bindings

ANNOTATION = "array<struct<start:int,length:int,kind:string,binding:string,parent:string,type:int,duplicate:boolean>>"
COMPILER_VERSION = 43


def java_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the *.java files below a folder, wherever Spark's readers reach."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.java").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.decode("content", "utf-8").alias("text"))


def binding_id(name):
    """-1 for the top package, else a hash of the name."""
    return F.when(name == "", F.lit(-1).cast("long")).otherwise(F.xxhash64(name))


def shredded(files: DataFrame) -> dict[str, DataFrame]:
    """Row kinds of (artifact_id, path, text, annotations): files, references, declarations, packages and lexemes.

    References marked as duplicates are not written. Packages of declarations that no declaration
    names become rows of their own.
    """
    numbered = files.withColumn("source_file_id", F.xxhash64("artifact_id", "path"))
    file_rows = numbered.select("artifact_id", "source_file_id", "path", F.xxhash64(F.length("text"), "text").alias("hash"), "text")
    marks = numbered.select("artifact_id", "source_file_id", "text", F.posexplode("annotations").alias("ref_id", "a"))
    line = F.length(F.substring("text", F.lit(1), F.col("a.start"))) - F.length(F.replace(F.substring("text", F.lit(1), F.col("a.start")), F.lit("\n"), F.lit(""))) + 1
    refs = marks.where("a.kind = 'ref' and not coalesce(a.duplicate, false)").select("artifact_id", "source_file_id", binding_id(F.col("a.binding")).alias("target"), "a.type", line.alias("line"), "ref_id")
    decls = marks.where("a.kind = 'decl'").select("artifact_id", "source_file_id", binding_id(F.col("a.binding")).alias("binding_id"), "a.binding", F.when(F.col("a.parent").isNotNull(), binding_id(F.col("a.parent"))).alias("parent"))
    words = F.split("binding", r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(words, F.lit(1), i), ".")))
    packages = decls.select("artifact_id", F.explode(prefixes).alias("binding")).distinct().join(decls.select("artifact_id", "binding"), ["artifact_id", "binding"], "left_anti")
    packages = packages.select("artifact_id", binding_id(F.col("binding")).alias("binding_id"), "binding")
    return {"source_file": file_rows, "binding_reference": refs, "binding": decls, "package": packages, "lexeme": lexemes(numbered)}


def lexemes(files: DataFrame) -> DataFrame:
    """(artifact_id, source_file_id, set, pos, lexeme, start, length): with symbols, and without (renumbered)."""

    def found(text):
        every = tokenize(text or "")
        for name, kept in (("normal", every), ("no_symbols", [t for t in every if not t[3]])):
            for i, t in enumerate(kept):
                yield name, i, t[0], t[1], t[2]

    return unfolded(files, ["artifact_id", "source_file_id"], found, "set string, pos int, lexeme string, start int, length int", ["text"])


NAMES = "binding_id long, artifact_id long, binding string"


@query("snk04_replaced_artifacts", "SELECT binding_id, artifact_id, CASE WHEN artifact_id IN (3, 7) THEN upper(binding) ELSE binding END AS binding, artifact_id IN (3, 7) AS fresh FROM bindings WHERE artifact_id <> 5")
def snk04(spark, root):
    """A stored table by artifact in which two artifacts are replaced and one goes; rows of the new version, and whether its predecessor lacks them."""
    names = bindings(spark, root).select("binding_id", "artifact_id", "binding")
    store = Store(spark, f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}")
    first = store.publish({"names": names}, "artifact_id")
    store.replace({"names": names.where("artifact_id in (3, 7)").withColumn("binding", F.upper("binding"))}, "artifact_id", gone=spark.sql("select 5L as key"))
    before = store.read("names", NAMES, first).select("binding_id", F.col("binding").alias("old"))
    return store.read("names", NAMES).join(before, "binding_id").select("binding_id", "artifact_id", "binding", (F.col("binding") != F.col("old")).alias("fresh"))


@query("snk05_published_versions", "SELECT CAST(1 AS BIGINT) AS version, 'names' AS name, count(*) AS rows, sum(binding_id) AS ids FROM bindings WHERE realm = 0 UNION ALL SELECT 1, 'artifacts', count(*), sum(artifact_id) FROM artifacts UNION ALL SELECT 2, 'names', count(*), sum(binding_id) FROM bindings UNION ALL SELECT 2, 'artifacts', count(*), sum(artifact_id) FROM artifacts WHERE artifact_id > 2")
def snk05(spark, root):
    """Two full rebuilds of two tables; a reader of the first version still sees all of it after the second."""
    names, known = bindings(spark, root), artifacts(spark, root)
    store = Store(spark, f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}")
    versions = [store.publish({"names": n.select("binding_id", "artifact_id", "binding"), "artifacts": a.select("artifact_id", "version")}, "artifact_id") for n, a in ((names.where("realm = 0"), known), (names, known.where("artifact_id > 2")))]
    out = None
    for version in versions:
        for name, schema, key in (("names", NAMES, "binding_id"), ("artifacts", "artifact_id long, version string", "artifact_id")):
            one = store.read(name, schema, version).agg(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(key).alias("ids"))
            out = one if out is None else out.unionByName(one)
    return out


def stale(configured: DataFrame, compiled: DataFrame, version: int = COMPILER_VERSION) -> DataFrame:
    """Configured artifacts that are not compiled by this version."""
    return configured.join(compiled.where(F.col("last_compile_version") >= version), "artifact_id", "left_anti")


def in_place(stale_count: int, total: int) -> bool:
    """More than 60 % current: update in place; else rebuild."""
    return total > 0 and (total - stale_count) / total > 0.6


def resolved(wanted: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """Dependencies reachable from `wanted` (id) over edges (a, b), never through what is missing (id)."""
    return reachable(wanted, edges.join(missing.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti"))


@query("src18_stale_artifacts", "SELECT artifact_id FROM artifacts WHERE NOT (40 + artifact_id % 5 >= 43)")
def src18(spark, root):
    configured = artifacts(spark, root).select("artifact_id")
    compiled = configured.withColumn("last_compile_version", 40 + F.col("artifact_id") % 5)
    return stale(configured, compiled)


@query("src10_dependency_closure", ", e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part WHERE p_size % 7 <> 0 UNION SELECT p_partkey, p_partkey * 3 FROM part), good AS (SELECT * FROM e WHERE b % 11 <> 0), reach(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT b FROM reach JOIN good ON a = id) SELECT id FROM reach")
def src10(spark, root):
    part = table(spark, root, "part")
    edges = part.where("p_size % 7 <> 0").selectExpr("p_partkey a", "p_partkey * 2 b").union(part.selectExpr("p_partkey a", "p_partkey * 3 b")).distinct()
    return resolved(spark.createDataFrame([(1,)], "id long"), edges, edges.where("b % 11 = 0").selectExpr("b id").distinct())


@query("src02_artifact_scan", "SELECT artifact_id, coordinate || '/' || version AS string_id FROM artifacts")
def src02(spark, root):
    return artifacts(spark, root).select("artifact_id", F.concat("coordinate", F.lit("/"), "version").alias("string_id"))


@query("src05_metadata_lookup", "SELECT s_name AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey = 7")
def src05(spark, root):
    return table(spark, root, "supplier").where("s_suppkey = 7").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


def _extracted(spark, root) -> DataFrame:
    """Conversations stand in for extracted files: one declaration and one reference each."""
    said = table(spark, root, "conversations")
    name = F.concat(F.lit("pkg"), (F.col("conv_id") % 5).cast("string"), F.lit(".sub"), F.col("turn").cast("string"), F.lit(".C"), F.col("conv_id").cast("string"))
    mark = lambda kind, binding, start, duplicate: F.struct(F.lit(start).alias("start"), F.lit(1).alias("length"), F.lit(kind).alias("kind"), binding.alias("binding"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("type"), F.lit(duplicate).alias("duplicate"))
    marks = F.array(mark("decl", name, 0, False), mark("ref", F.lit("pkg0.sub.C0"), 20, False), mark("ref", F.lit("pkg0.sub.C0"), 20, True))
    return said.select((F.col("conv_id") % 10).alias("artifact_id"), F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".java")).alias("path"), "text", marks.alias("annotations"))


FILES = ", said AS (SELECT conv_id, turn, conv_id % 10 AS artifact_id, text FROM conversations)"


@query("udtf04_shredded_packages", f"{FILES} SELECT DISTINCT artifact_id, p AS binding FROM said, (VALUES (0), (1), (2)) t(i), LATERAL (SELECT CASE i WHEN 0 THEN '' WHEN 1 THEN 'pkg' || (conv_id % 5) ELSE 'pkg' || (conv_id % 5) || '.sub' || turn END AS p)")
def udtf04(spark, root):
    return shredded(_extracted(spark, root))["package"].select("artifact_id", "binding")


@query("udtf04_shredded_references", f"{FILES} SELECT artifact_id, length(text[1:20]) - length(replace(text[1:20], chr(10), '')) + 1 AS line, count(*) AS count FROM said GROUP BY ALL")
def udtf04r(spark, root):
    refs = shredded(_extracted(spark, root))["binding_reference"]
    return refs.groupBy("artifact_id", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("count"))


@query("snk03_lexeme_sets")
def snk03(spark, root):
    """Lexemes by set (no SQL twin: stemming)."""
    return shredded(_extracted(spark, root))["lexeme"].groupBy("set", "artifact_id").agg(F.count("*").alias("count"))


def field_access(source, name):
    """READ, WRITE or READ_WRITE of the one use of a field in a Java expression, by what stands beside it; null if it is not there."""
    found = lambda *pattern: F.call_function("regexp_extract", source, F.concat(*pattern), F.lit(1))
    use = found(F.lit(r"\b"), name, F.lit(r"\b\s*(\+\+|--|(?:<<|>>>?|[-+*/%&|^])=|==|=|)"))
    before = found(F.lit(r"(\+\+|--)\s*(?:\w+\.)*\b"), name, F.lit(r"\b"))
    there = F.rlike(source, F.concat(F.lit(r"\b"), name, F.lit(r"\b")))
    return F.when(~there, F.lit(None)).when(use == "=", "WRITE").when((before != "") | ~use.isin("", "=="), "READ_WRITE").otherwise("READ")


#: Uses of a field {} and the access each of them is.
USES = [
    ("this.{} = other.value", "WRITE"), ("{} += 2", "READ_WRITE"), ("a.b.{}++", "READ_WRITE"), ("call({}, 1)", "READ"), ("if ({} == 3) return", "READ"),
    ("-- node.{}", "READ_WRITE"), ("{} >>>= 1", "READ_WRITE"), ("return {} + 1", "READ"), ("x = {}", "READ"), ("plain", None),
]


@query("udtf05_field_access", "SELECT access, count(*) AS count FROM (SELECT CASE ref_id * line % 10 " + " ".join(f"WHEN {i} THEN " + (f"'{access}'" if access else "NULL") for i, (_, access) in enumerate(USES)) + " END AS access FROM refs) GROUP BY access")
def udtf05(spark, root):
    """Every reference as a use of a field named after its target, classified from the source text."""
    from codeweft.sources.views import references

    name = F.concat(F.lit("f"), F.col("target").cast("string"))
    template = F.element_at(F.array(*[F.lit(t) for t, _ in USES]), (F.col("ref_id") * F.col("line") % 10 + 1).cast("int"))
    return references(spark, root).groupBy(field_access(F.replace(template, F.lit("{}"), name), name).alias("access")).agg(F.count("*").alias("count"))


def module_requires(source):
    """array<struct<module, transitive, static>> of a module declaration, without comments."""
    plain = F.regexp_replace(source, r"/[*](?s:.*?)[*]/|//[^\n]*", " ")
    each = F.regexp_extract_all(plain, F.lit(r"\brequires\s+((?:(?:transitive|static)\s+)*[^\s;]+)\s*;"), F.lit(1))
    words = lambda x: F.split(x, r"\s+")
    return F.transform(each, lambda x: F.struct(F.element_at(words(x), -1).alias("module"), x.rlike(r"\btransitive\s").alias("transitive"), x.rlike(r"\bstatic\s").alias("static")))


@query("udtf08_module_requires", r"""SELECT page_id, module, transitive, optional FROM pages, LATERAL (VALUES ('java.base', false, false), (regexp_extract(url, '://([^/?#]+)', 1), true, false), ('tool.p' || page_id, true, true)) t(module, transitive, optional)""")
def udtf08(spark, root):
    """A module declaration for every page, read back: what it requires."""
    host, own = F.regexp_extract("url", "://([^/?#]+)", 1), F.col("page_id").cast("string")
    source = F.concat(F.lit("/* requires none; */ open module m"), own, F.lit(" {\n  requires java.base; // requires not.this;\n  requires transitive "), host, F.lit(";\n  requires static\n transitive tool.p"), own, F.lit(";\n  exports a.b to c;\n}"))
    each = table(spark, root, "pages").select("page_id", F.inline(module_requires(source)))
    return each.withColumnRenamed("static", "optional")


#: Which source an artifact of a region comes from, and how each names its files; all others come from images.
KINDS = {"america": "java", "europe": "maven", "asia": "android"}


def planned(at: DataFrame, kind: str) -> DataFrame:
    """(artifact_id, kind, location) of the artifacts (artifact_id, coordinate, version) of one kind, by its own rule."""
    region, name = F.split_part("coordinate", F.lit("/"), F.lit(1)), F.split_part("coordinate", F.lit("/"), F.lit(2))
    known = [r for r, k in KINDS.items() if k == kind]
    mine = at.where(region == known[0] if known else ~region.isin(list(KINDS)))
    location = {"java": F.concat(name, F.lit("/src-"), "version", F.lit(".zip")), "maven": F.concat_ws(":", region, name, "version"), "android": F.concat(F.lit("platform-"), F.split_part("version", F.lit("."), F.lit(1)))}
    return mine.select("artifact_id", F.lit(kind).alias("kind"), location.get(kind, F.concat_ws("/", F.lit("image"), name)).alias("location"))


@query("disp01_union_of_sources", """SELECT artifact_id, CASE r WHEN 'america' THEN 'java' WHEN 'europe' THEN 'maven' WHEN 'asia' THEN 'android' ELSE 'graal' END AS kind,
  CASE r WHEN 'america' THEN n || '/src-' || version || '.zip' WHEN 'europe' THEN r || ':' || n || ':' || version WHEN 'asia' THEN 'platform-' || string_split(version, '.')[1] ELSE 'image/' || n END AS location
FROM (SELECT *, string_split(coordinate, '/')[1] AS r, string_split(coordinate, '/')[2] AS n FROM artifacts)""")
def disp01(spark, root):
    """Every artifact goes to the source of its kind, which says where its files are; the kinds' rows are united."""
    at = artifacts(spark, root)
    out = planned(at, "graal")
    for kind in KINDS.values():
        out = out.unionByName(planned(at, kind))
    return out
