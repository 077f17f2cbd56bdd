"""Directories, prefixes, and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft.plans.register import query
from codeweft.sources.tables import table
from codeweft.sources.views import artifacts, bindings, files


def common_prefix(least: Column, most: Column) -> Column:
    """The longest common prefix of a set is that of its least and greatest member."""
    same = F.filter(F.sequence(F.lit(1), F.least(F.length(least), F.length(most))), lambda i: F.substring(least, F.lit(1), i) == F.substring(most, F.lit(1), i))
    return F.when(F.least(F.length(least), F.length(most)) == 0, "").otherwise(F.substring(least, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))))


PREFIX = "(SELECT coalesce(max(i), 0) FROM range(1, least(length(lo), length(hi)) + 1) t(i) WHERE lo[1:i] = hi[1:i])"


@query("agg05_common_prefix", f"SELECT artifact_id, lo[1:{PREFIX}] AS prefix FROM (SELECT artifact_id, min(path) AS lo, max(path) AS hi FROM files GROUP BY artifact_id)")
def agg05(spark, root):
    ends = files(spark, root).groupBy("artifact_id").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    return ends.select("artifact_id", common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


@query("agg06_xor_hash", "SELECT artifact_id, realm, bit_xor(hash) AS hash FROM files GROUP BY ALL")
def agg06(spark, root):
    return files(spark, root).groupBy("artifact_id", "realm").agg(F.bit_xor("hash").alias("hash"))


ENTRIES = f"""listed AS (SELECT artifact_id, CASE WHEN strpos(path, '/') > 0 THEN split_part(path, '/', 1) ELSE path END AS segment, min(path) AS lo, max(path) AS hi,
  bit_xor(hash) AS hash, count(*) AS n FROM files GROUP BY ALL)"""


def listing(spark, root):
    """Entries of each artifact's top directory: common prefix, size and combined hash of what is below."""
    segment = F.substring_index("path", "/", 1)
    found = files(spark, root).groupBy("artifact_id", segment.alias("segment")).agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.bit_xor("hash").alias("hash"), F.count("*").alias("n"))
    return found.withColumn("name", common_prefix(F.col("lo"), F.col("hi"))).withColumn("is_dir", F.col("lo") != F.col("name"))


@query("agg07_directory_rollup", f", {ENTRIES} SELECT artifact_id, segment, lo[1:{PREFIX}] AS name, lo <> lo[1:{PREFIX}] AS is_dir, hash, n FROM listed")
def agg07(spark, root):
    return listing(spark, root).select("artifact_id", "segment", "name", "is_dir", "hash", "n")


@query("sort03_directories_first", f", {ENTRIES} SELECT artifact_id, segment, row_number() OVER (PARTITION BY artifact_id ORDER BY n = 1, segment) AS place FROM listed")
def sort03(spark, root):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("artifact_id").orderBy(F.col("n") == 1, "segment"))
    return listing(spark, root).select("artifact_id", "segment", place.alias("place"))


DIRDIFF = f""", {ENTRIES}, a AS (SELECT segment, hash FROM listed WHERE artifact_id = 1), b AS (SELECT segment, hash FROM listed WHERE artifact_id = 2)
SELECT coalesce(a.segment, b.segment) AS segment, CASE WHEN a.segment IS NULL THEN 'INSERTION' WHEN b.segment IS NULL THEN 'DELETION'
  WHEN a.hash = b.hash THEN 'UNCHANGED' ELSE 'CHANGED_INTERNALLY' END AS status FROM a FULL JOIN b ON a.segment = b.segment"""


@query("diff03_directory_diff", DIRDIFF)
def diff03(spark, root):
    """Two artifacts' directories, merged by name; combined hashes stand for contents."""
    entries = listing(spark, root)
    old = entries.where("artifact_id = 1").select("segment", F.col("hash").alias("old"))
    new = entries.where("artifact_id = 2").select("segment", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "INSERTION").when(F.col("new").isNull(), "DELETION").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("CHANGED_INTERNALLY")
    return old.join(new, "segment", "full").select("segment", status.alias("status"))


@query("join18_outer_merge", "SELECT coalesce(a.p, b.p) AS path, a.hash AS old_hash, b.hash AS new_hash FROM (SELECT path AS p, min(hash) AS hash FROM files WHERE realm = 0 GROUP BY path) a FULL JOIN (SELECT path AS p, min(hash) AS hash FROM files WHERE realm = 1 GROUP BY path) b ON a.p = b.p")
def join18(spark, root):
    side = lambda realm, name: files(spark, root).where(f"realm = {realm}").groupBy("path").agg(F.min("hash").alias(name))
    return side(0, "old_hash").join(side(1, "new_hash"), "path", "full")


@query("agg10_artifacts_by_prefix", "SELECT DISTINCT artifact_id FROM files WHERE starts_with(path, 'blog.')")
def agg10(spark, root):
    return files(spark, root).where(F.col("path").startswith("blog.")).select("artifact_id").distinct()


@query("flt05_prefix", "SELECT source_file_id, path FROM files WHERE starts_with(path, 'www.')")
def flt05(spark, root):
    return files(spark, root).where(F.col("path").startswith("www.")).select("source_file_id", "path")


@query("flt06_suffix", "SELECT source_file_id, path FROM files WHERE ends_with(path, '.html')")
def flt06(spark, root):
    return files(spark, root).where(F.col("path").endswith(".html")).select("source_file_id", "path")


@query("flt08_escaped_like", r"SELECT source_file_id, regexp_replace(path, '([\\%_])', '\\\1', 'g') AS escaped FROM files")
def flt08(spark, root):
    return files(spark, root).select("source_file_id", F.regexp_replace("path", r"([\\%_])", r"\\$1").alias("escaped"))


@query("prj03_locations", "SELECT source_file_id, '/' || artifact_id || '/' || path || '#' || source_file_id AS location, url_encode(path) AS hash FROM files")
def prj03(spark, root):
    location = F.concat(F.lit("/"), F.col("artifact_id").cast("string"), F.lit("/"), "path", F.lit("#"), F.col("source_file_id").cast("string"))
    return files(spark, root).select("source_file_id", location.alias("location"), F.regexp_replace(F.url_encode("path"), r"\+", "%20").alias("hash"))


@query("prj04_realm_of_extension", "SELECT source_file_id, CASE WHEN ends_with(path, '.html') THEN 0 WHEN ends_with(path, '.class') THEN 1 END AS realm_of FROM files")
def prj04(spark, root):
    realm = F.when(F.col("path").endswith(".html"), 0).when(F.col("path").endswith(".class"), 1)
    return files(spark, root).select("source_file_id", realm.alias("realm_of"))


@query("fn06_path_segments", "SELECT source_file_id, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, string_split(path, '/')[-1] AS last, path[1:strpos(path, '/')] AS first FROM files")
def fn06(spark, root):
    parts = F.split("path", "(?<=/)")
    first = F.when(F.instr("path", "/") > 0, parts[0]).otherwise("")
    return files(spark, root).select("source_file_id", F.size(F.split("path", "/")).cast("long").alias("depth"), F.substring_index("path", "/", -1).alias("last"), first.alias("first"))


@query("fn07_trimmed_path", "SELECT artifact_id, trim('/' || coordinate || '/', '/') AS path, string_split(coordinate, '/')[1] AS top FROM artifacts")
def fn07(spark, root):
    return artifacts(spark, root).select("artifact_id", F.regexp_replace(F.concat(F.lit("/"), "coordinate", F.lit("/")), "^/+|/+$", "").alias("path"), F.split("coordinate", "/")[0].alias("top"))


@query("fn01_substring_from_zero", "SELECT source_file_id, substr(path, 1, greatest(0, 5 - 1)) AS head FROM files")
def fn01(spark, root):
    """A start of 0 with n characters means n-1 characters from 1; written 1-based on purpose."""
    return files(spark, root).select("source_file_id", F.substring("path", 1, 4).alias("head"))


@query("fn02_position_functions", "SELECT source_file_id, strpos(path, '/') AS slash, nullif(artifact_id, 3) AS not_three, coalesce(nullif(artifact_id, 3), -1) AS filled, least(artifact_id, 4) AS low, greatest(artifact_id, 4) AS high, length(path) AS n FROM files")
def fn02(spark, root):
    a = F.col("artifact_id")
    return files(spark, root).select("source_file_id", F.instr("path", "/").cast("long").alias("slash"), F.nullif(a, F.lit(3)).alias("not_three"), F.coalesce(F.nullif(a, F.lit(3)), F.lit(-1)).alias("filled"), F.least(a, F.lit(4)).alias("low"), F.greatest(a, F.lit(4)).alias("high"), F.length("path").cast("long").alias("n"))


@query("agg16_implicit_packages", """, parts AS (SELECT binding_id, string_split(binding, '.') AS w FROM bindings),
prefixes AS (SELECT DISTINCT array_to_string(w[1:i], '.') AS package FROM parts, range(1, 3) t(i) WHERE i < len(w))
SELECT package FROM prefixes WHERE package NOT IN (SELECT binding FROM bindings)""")
def agg16(spark, root):
    """All package prefixes of bindings, less those declared: explode, distinct, anti join."""
    words = F.split("binding", r"\.")
    upto = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), "."))
    names = bindings(spark, root)
    prefixes = names.select(F.explode(upto).alias("package")).distinct()
    return prefixes.join(names.select(F.col("binding").alias("package")), "package", "left_anti")


@query("join14_longest_prefix", """, asked AS (SELECT l_partkey AS id, lower(r_name) || '/' || lower(n_name) || '/x/' || CAST(l_linenumber AS VARCHAR) AS dependency
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
known AS (SELECT DISTINCT coordinate AS prefix FROM artifacts UNION SELECT DISTINCT string_split(coordinate, '/')[1] FROM artifacts)
SELECT DISTINCT dependency, (SELECT prefix FROM known WHERE dependency = prefix OR starts_with(dependency, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM asked""")
def join14(spark, root):
    """Every prefix of a dependency is an equi-join key; the longest that exists wins."""
    at = artifacts(spark, root)
    known = at.select(F.col("coordinate").alias("prefix")).union(at.select(F.split("coordinate", "/")[0])).distinct()
    lines = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("artifact_id"), "l_linenumber")
    asked = lines.join(at, "artifact_id").select(F.concat("coordinate", F.lit("/x/"), F.col("l_linenumber").cast("string")).alias("dependency")).distinct()
    parts = F.split("dependency", "/")
    keys = asked.select("dependency", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("prefix"))
    found = keys.join(known, "prefix").groupBy("dependency").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return asked.join(found, "dependency", "left")


@query("join15_suffix_equi", "SELECT a.source_file_id AS old_id, b.source_file_id AS new_id FROM files a JOIN files b ON a.artifact_id < 5 AND b.artifact_id >= 5 AND ends_with(b.path, substr(a.path, strpos(a.path, '/'))) AND substr(a.path, strpos(a.path, '/')) = substr(b.path, strpos(b.path, '/'))")
def join15(spark, root):
    """Paths that agree after the first segment: the rest is derived and joined by equality."""
    rest = F.substring(F.col("path"), F.instr("path", "/"), F.length("path"))
    old = files(spark, root).where("artifact_id < 5").select(F.col("source_file_id").alias("old_id"), rest.alias("rest"))
    new = files(spark, root).where("artifact_id >= 5").select(F.col("source_file_id").alias("new_id"), rest.alias("rest"))
    return old.join(new, "rest").select("old_id", "new_id")


@query("src04_file_by_path", "SELECT source_file_id, hash FROM files WHERE realm = 1 AND artifact_id = 5 AND path LIKE 'tion%'")
def src04(spark, root):
    return files(spark, root).where((F.col("realm") == 1) & (F.col("artifact_id") == 5) & F.col("path").startswith("tion")).select("source_file_id", "hash")


@query("diff06_path_segments", "SELECT a.source_file_id, a.path AS old, b.path AS new, CAST(len(string_split(b.path, '/')) - len(string_split(a.path, '/')) AS BIGINT) AS net FROM files a JOIN files b ON b.source_file_id = a.source_file_id + 1")
def diff06(spark, root):
    """Segments kept, inserted and deleted between neighbouring paths; both paths read back from them, and the net count."""
    from codeweft.operators.intervals import line_diff

    old = files(spark, root).select(F.col("source_file_id").alias("key"), F.replace("path", F.lit("/"), F.lit("\n")).alias("old"))
    new = files(spark, root).select((F.col("source_file_id") - 1).alias("key"), F.replace("path", F.lit("/"), F.lit("\n")).alias("new"))
    side = lambda skip: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != skip, F.struct("line", "text")))), lambda x: x["text"]), "/")
    edits = line_diff(old.join(new, "key")).groupBy(F.col("key").alias("source_file_id"))
    return edits.agg(side("INSERTION").alias("old"), side("DELETION").alias("new"), (F.count_if(F.col("status") == "INSERTION") - F.count_if(F.col("status") == "DELETION")).alias("net"))


@query("set02_set_difference", "SELECT artifact_id FROM files WHERE realm = 0 EXCEPT SELECT artifact_id FROM files WHERE path LIKE 'blog%'")
def set02(spark, root):
    return files(spark, root).where("realm = 0").select("artifact_id").subtract(files(spark, root).where(F.col("path").startswith("blog")).select("artifact_id"))


@query("lim01_limit_when_exceeded", "SELECT source_file_id, path FROM files ORDER BY path, source_file_id LIMIT 200")
def lim01(spark, root, limit: int | None = 200):
    """No limit where none is given; the order is total, so the cut is the same each time."""
    listed = files(spark, root).select("source_file_id", "path").orderBy("path", "source_file_id")
    return listed if limit is None else listed.limit(limit)


@query("lim05_longest_first", "SELECT artifact_id, max_by(path, {'n': length(path), 'p': path}) AS path FROM files GROUP BY artifact_id")
def lim05(spark, root):
    return files(spark, root).groupBy("artifact_id").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"))
