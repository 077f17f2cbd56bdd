"""Trees: recursion over parents, budgeted expansion, chains, order by dependency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.operators.versions import KEYED, keyed
from codeweft.plans.register import query
from codeweft.sources.tables import closure, placed, reachable, settled, table
from codeweft.sources.views import artifacts, bindings


def descend(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) for every node (unique id, parent) at or below a root (parent null), however deep.

    Each node points upward and takes over the pointer of the node it points to, so ways double every
    round. Nodes that lead into a cycle or to a missing parent have no root: when a round finishes no
    node, none of those left will be.
    """
    at_root = F.col("parent").isNull()
    own = settled(nodes.select("id", F.coalesce("parent", "id").alias("root"), (~at_root).cast("int").alias("depth"), at_root.alias("done")))
    done = own.where("done").count()
    while True:
        upper = own.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        moved = own.where("not done").join(upper, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done"))
        own = settled(own.where("done").unionByName(moved))
        before, done = done, own.where("done").count()
        if done == before:
            return own.where("done").select("id", "root", "depth")


def _nodes(spark, root):
    return bindings(spark, root).select(F.col("binding_id").alias("id"), "parent", "binding", "modifiers", "source_file_id")


WALK = ", walk(id, root, depth) AS (SELECT binding_id, binding_id, 0 FROM bindings WHERE parent IS NULL UNION ALL SELECT n.binding_id, w.root, w.depth + 1 FROM bindings n JOIN walk w ON n.parent = w.id)"


@query("join10_tree_levels", f"{WALK} SELECT id, root, depth FROM walk")
def join10(spark, root):
    return descend(_nodes(spark, root))


@query("join21_transitive_closure", f"{WALK}, up(id, ancestor) AS (SELECT binding_id, parent FROM bindings WHERE parent IS NOT NULL UNION ALL SELECT u.id, b.parent FROM up u JOIN bindings b ON b.binding_id = u.ancestor WHERE b.parent IS NOT NULL) SELECT ancestor, count(*) AS below FROM up GROUP BY ancestor")
def join21(spark, root):
    """How many nodes lie below each: all (node, ancestor) pairs by doubling ways."""
    pairs = closure(_nodes(spark, root).select(F.col("id").alias("a"), F.col("parent").alias("b")))
    return pairs.groupBy(F.col("b").alias("ancestor")).agg(F.count("*").alias("below"))


@query("tree03_budgeted_levels", f"{WALK}, sizes AS (SELECT root, depth, count(*) AS n FROM walk WHERE depth > 0 GROUP BY ALL), upto AS (SELECT *, sum(n) OVER (PARTITION BY root ORDER BY depth) AS total FROM sizes) SELECT root, depth, n FROM upto WHERE depth = 1 OR total <= 100")
def tree03(spark, root, budget: int = 100):
    """Levels below each root that fit a budget of nodes; the first always does, and no level is cut."""
    sizes = descend(_nodes(spark, root)).where("depth > 0").groupBy("root", "depth").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("root").orderBy("depth"))
    return sizes.withColumn("total", total).where((F.col("depth") == 1) | (F.col("total") <= budget)).drop("total")


@query("lim04_overflow_by_one", f"{WALK} SELECT root, count(*) > 100 AS overflows FROM walk WHERE depth > 0 GROUP BY root")
def lim04(spark, root):
    return descend(_nodes(spark, root)).where("depth > 0").groupBy("root").agg((F.count("*") > 100).alias("overflows"))


@query("tree04_children_lists", "SELECT parent, to_json(list(binding_id ORDER BY binding_id)) AS children FROM bindings WHERE parent IS NOT NULL GROUP BY parent")
def tree04(spark, root):
    return _nodes(spark, root).where("parent is not null").groupBy("parent").agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("children"))


EDGES = ", nodes AS (SELECT DISTINCT coordinate || '/' || version AS path, 3 AS n FROM artifacts UNION SELECT DISTINCT coordinate, 2 FROM artifacts UNION SELECT DISTINCT string_split(coordinate, '/')[1], 1 FROM artifacts)"


def trie(spark, root) -> DataFrame:
    """(path, parent, n): every prefix of every artifact path."""
    at = artifacts(spark, root).select(F.split(F.concat("coordinate", F.lit("/"), "version"), "/").alias("p"))
    each = at.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    upto = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    return each.select(upto(F.col("n")).alias("path"), F.when(F.col("n") > 1, upto(F.col("n") - 1)).alias("parent"), "n").distinct()


@query("tree01_artifact_trie", f"{EDGES} SELECT path, n, CASE WHEN n > 1 THEN array_to_string(string_split(path, '/')[1:n-1], '/') END AS parent FROM nodes")
def tree01(spark, root):
    return trie(spark, root).select("path", "n", "parent")


@query("tree01_flattened_children", f"{EDGES}, kids AS (SELECT array_to_string(string_split(path, '/')[1:n-1], '/') AS parent, count(*) AS c FROM nodes WHERE n > 1 GROUP BY ALL) SELECT path FROM nodes LEFT JOIN kids ON kids.parent = path WHERE coalesce(c, 0) <> 1")
def tree01f(spark, root):
    """Nodes left when chains of single children are collapsed."""
    nodes = trie(spark, root)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("c"))
    return nodes.join(kids, "path", "left").where(F.coalesce("c", F.lit(0)) != 1).select("path")


@query("tree02_path_split", """, asked AS (SELECT coordinate || '/' || version || '/src/Main.java' AS path, coordinate || '/' || version AS artifact FROM artifacts) SELECT path, artifact, substr(path, length(artifact) + 2) AS rest FROM asked""")
def tree02(spark, root):
    """An artifact prefix and what remains: the longest prefix that is a leaf."""
    at = artifacts(spark, root)
    asked = at.select(F.concat("coordinate", F.lit("/"), "version", F.lit("/src/Main.java")).alias("path"))
    known = at.select(F.concat("coordinate", F.lit("/"), "version").alias("artifact"))
    parts = F.split("path", "/")
    keys = asked.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("artifact"))
    found = keys.join(known, "artifact").groupBy("path").agg(F.max_by("artifact", F.length("artifact")).alias("artifact"))
    return found.withColumn("rest", F.expr("substring(path, length(artifact) + 2)"))


@query("tree05_leaf_view", f"""{KEYED}, uses AS (SELECT DISTINCT l_suppkey AS artifact_id, p_partkey % 10 AS used FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount = 0 AND l_suppkey <> p_partkey % 10)
SELECT a.artifact_id, (SELECT count(*) FROM bindings b WHERE b.artifact_id = a.artifact_id AND source_file_id IS NULL) AS packages, (SELECT count(*) FROM bindings b WHERE b.artifact_id = a.artifact_id) AS bindings,
  (SELECT count(*) FROM files f WHERE f.artifact_id = a.artifact_id AND realm = 0) AS files_0, (SELECT count(*) FROM files f WHERE f.artifact_id = a.artifact_id AND realm = 1) AS files_1,
  coalesce((SELECT string_agg(CAST(used AS VARCHAR), ',' ORDER BY used) FROM uses u WHERE u.artifact_id = a.artifact_id), '') AS dependencies,
  coalesce((SELECT string_agg(version, ',' ORDER BY k, o.artifact_id) FROM keyed o WHERE o.coordinate = a.coordinate AND o.artifact_id <> a.artifact_id), '') AS alternatives
FROM artifacts a""")
def tree05(spark, root):
    """What a leaf's page shows: packages and names, files of both realms, what the artifact uses, and its other versions, newest first."""
    from codeweft.sources.views import files

    by = bindings(spark, root).groupBy("artifact_id").agg(F.count_if(F.col("source_file_id").isNull()).alias("packages"), F.count("*").alias("bindings"))
    held = files(spark, root).groupBy("artifact_id").agg(*[F.count_if(F.col("realm") == r).alias(f"files_{r}") for r in (0, 1)])
    lines = table(spark, root, "lineitem").where("l_discount = 0").select(F.col("l_suppkey").alias("artifact_id"), F.col("l_partkey").alias("p_partkey"))
    uses = lines.join(table(spark, root, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("used")), "p_partkey").where("artifact_id <> used").select("artifact_id", "used").distinct()
    uses = uses.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("used")), lambda x: x.cast("string")), ",").alias("dependencies"))
    at = keyed(spark, root)
    kin = at.groupBy("coordinate").agg(F.array_sort(F.collect_list(F.struct("k", "artifact_id", "version"))).alias("kin"))  # the versions of one library
    others = F.filter("kin", lambda x: x["artifact_id"] != F.col("artifact_id"))
    out = at.join(kin, "coordinate").select("artifact_id", F.array_join(F.transform(others, lambda x: x["version"]), ",").alias("alternatives"))
    return out.join(by, "artifact_id", "left").join(held, "artifact_id", "left").join(uses, "artifact_id", "left").na.fill(0).na.fill("", ["dependencies"])


#: Pairs of versions that a task makes.
PAIRS = 1 << 22


@query("tree06_alternatives", "SELECT a.artifact_id, b.version FROM artifacts a JOIN artifacts b ON a.coordinate = b.coordinate AND a.artifact_id <> b.artifact_id")
def tree06(spark, root):
    """All pairs within a library; a large library is dealt over as many tasks as its pairs need, some PAIRS each."""
    at = artifacts(spark, root)
    most, pairs = at.where("coordinate is not null").groupBy("coordinate").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()
    lots = max(1, -(-most * most // PAIRS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * pairs // PAIRS))
    own = at.withColumn("lot", F.pmod(F.xxhash64("artifact_id"), F.lit(lots)).cast("int")).repartition(tasks, "coordinate", "lot")
    other = at.select("coordinate", F.col("artifact_id").alias("other"), F.col("version").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    return own.join(other, ["coordinate", "lot"]).where("artifact_id <> other").select("artifact_id", F.col("v").alias("version"))


_VERSIONS = f"{KEYED}, held AS (SELECT string_split(coordinate, '/')[1] AS line, artifact_id, version, k, regexp_replace(path, '[0-9]+', '', 'g') AS path FROM files JOIN keyed USING (artifact_id) GROUP BY ALL)"


@query("tree06_file_alternatives", f"{_VERSIONS} SELECT line, path, artifact_id, version, CAST(row_number() OVER (PARTITION BY line, path ORDER BY k, artifact_id) AS INT) AS place, count(*) OVER (PARTITION BY line, path) AS alternatives FROM held")
def tree06_files(spark, root):
    """The versions that hold a file, newest first: each row's alternatives are the others of its line and path."""
    from codeweft.sources.views import files

    line = F.substring_index("coordinate", "/", 1)
    path = F.regexp_replace("path", "[0-9]+", "")
    held = files(spark, root).select("artifact_id", path.alias("path")).distinct().join(keyed(spark, root), "artifact_id").select(line.alias("line"), "path", "artifact_id", "version", "k")
    kin = W.partitionBy("line", "path")
    return held.select("line", "path", "artifact_id", "version", F.row_number().over(kin.orderBy("k", "artifact_id")).alias("place"), F.count("*").over(kin).alias("alternatives"))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank) of nodes (id) with edges (a, b), a before b: the longest way to a node from one without a way in.

    Each round takes away the nodes that no edge leads to any more, and their edges, so a node goes once all that
    lead to it are gone; as many rounds as the longest way. Nodes on a cycle or behind one never go: their rank is null.
    An edge to or from what is no node, or from a node to itself, is none, or a cycle.
    """
    every = settled(nodes.select("id").distinct())
    known = lambda c: every.select(F.col("id").alias(c))
    edges = settled(edges.select("a", "b").distinct().join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").select("a", "b"))
    left, ranked, rank = every, [], 0
    while True:
        free = settled(left.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        ranked.append(free.withColumn("rank", F.lit(rank)))  # the rounds stay tables of their own
        gone = free.select(F.col("id").alias("a"))
        left, edges, rank = settled(left.join(free, "id", "left_anti")), settled(edges.join(gone, "a", "left_anti")), rank + 1
    return reduce(DataFrame.unionByName, ranked, left.withColumn("rank", F.lit(None).cast("int")))


_DAG = "SELECT p_partkey AS a, p_partkey * 2 AS b FROM part UNION SELECT p_partkey, p_partkey * 3 FROM part UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 100 = 34 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 100 = 34"


@query("sort09_topological_order", f""", pairs AS (SELECT * FROM ({_DAG}) WHERE b IN (SELECT p_partkey FROM part) AND a IN (SELECT p_partkey FROM part)),
knotted(id) AS (SELECT a FROM pairs WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.a = pairs.b AND q.b = pairs.a) UNION SELECT b FROM knotted JOIN pairs ON a = id),
ways(id, n) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT b FROM pairs) UNION SELECT b, n + 1 FROM ways JOIN pairs ON a = id WHERE b NOT IN (SELECT id FROM knotted))
SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT id FROM knotted) THEN NULL ELSE (SELECT max(n) FROM ways WHERE id = p_partkey) END AS rank FROM part""")
def sort09(spark, root):
    """Parts behind their halves and thirds; some stand in cycles of two."""
    part = table(spark, root, "part").select(F.col("p_partkey").alias("id"))
    few = part.where("id % 100 = 34")
    edges = part.selectExpr("id a", "id * 2 b").union(part.selectExpr("id a", "id * 3 b")).union(few.selectExpr("id + 1 a", "id b")).union(few.selectExpr("id a", "id + 1 b"))
    return topological(part, edges)


@query("sort04_display_order", "SELECT binding_id, row_number() OVER (PARTITION BY realm ORDER BY artifact_id, CASE WHEN source_file_id IS NULL THEN binding END NULLS LAST, source_file_id, binding_id) AS place FROM bindings")
def sort04(spark, root):
    """Numbered by ranges over all realms, then from each realm's first."""
    order = ["realm", "artifact_id", F.when(F.col("source_file_id").isNull(), F.col("binding")).asc_nulls_last(), "source_file_id", "binding_id"]
    rows = settled(placed(bindings(spark, root).select("binding_id", "realm", "artifact_id", "binding", "source_file_id"), order))
    first = rows.groupBy("realm").agg(F.min("place").alias("first"))  # a row a realm
    return rows.join(first, "realm").select("binding_id", (F.col("place") - F.col("first") + 1).cast("long").alias("place"))


OLDNEW = ", o AS (SELECT binding_id % 1000 AS k, min(modifiers) % 4 AS m, min(string_split(binding, '.')[2]) AS d, min(parent % 1000) AS p FROM bindings WHERE realm = 0 GROUP BY 1), n AS (SELECT binding_id // 2 % 1000 AS k, min(modifiers) % 4 AS m, min(string_split(binding, '.')[2]) AS d, min(parent % 1000) AS p FROM bindings WHERE realm = 1 GROUP BY 1), own AS (SELECT coalesce(o.k, n.k) AS k, coalesce(n.p, o.p) AS p, CASE WHEN o.k IS NULL THEN 'INSERTION' WHEN n.k IS NULL THEN 'DELETION' WHEN o.m IS NOT DISTINCT FROM n.m AND o.d IS NOT DISTINCT FROM n.d THEN 'UNCHANGED' ELSE 'CHANGED' END AS s FROM o FULL JOIN n ON o.k = n.k)"


@query("diff04_declaration_diff", f"{OLDNEW}, above(k) AS (SELECT p FROM own WHERE s <> 'UNCHANGED' UNION SELECT o.p FROM above a JOIN own o ON o.k = a.k WHERE o.s = 'UNCHANGED') SELECT k, CASE WHEN s = 'UNCHANGED' AND k IN (SELECT k FROM above WHERE k IS NOT NULL) THEN 'CHANGED_INTERNALLY' ELSE s END AS status FROM own")
def diff04(spark, root):
    """Two versions of declarations, equal in binding, modifiers and description; what is unchanged above a change, at any distance, changed internally."""
    b = bindings(spark, root)
    side = lambda f, k, x: f.groupBy(k.alias("k")).agg((F.min("modifiers") % 4).alias(f"m{x}"), F.min(F.split("binding", r"\.")[1]).alias(f"d{x}"), F.min(F.col("parent") % 1000).alias(f"p{x}"))
    old = side(b.where("realm = 0"), F.col("binding_id") % 1000, 0).withColumn("in0", F.lit(True))
    new = side(b.where("realm = 1"), F.floor(F.col("binding_id") / 2) % 1000, 1).withColumn("in1", F.lit(True))
    status = F.when(F.col("in0").isNull(), "INSERTION").when(F.col("in1").isNull(), "DELETION").when(F.col("m0").eqNullSafe(F.col("m1")) & F.col("d0").eqNullSafe(F.col("d1")), "UNCHANGED").otherwise("CHANGED")
    own = old.join(new, "k", "full").select("k", F.coalesce("p1", "p0").alias("p"), status.alias("s"))
    return changed_inside(own)


def changed_inside(own: DataFrame) -> DataFrame:
    """(k, status) of nodes (k, parent p, own status s): changes rise through unchanged parents to the fix-point."""
    own = settled(own)
    parents = own.where("s = 'UNCHANGED'").select(F.col("k").alias("b"))
    changed = own.where("s <> 'UNCHANGED'").select(F.col("k").alias("id"))
    above = reachable(changed, own.select(F.col("k").alias("a"), F.col("p").alias("b")).join(parents, "b", "left_semi"))
    marked = above.select(F.col("id").alias("k"), F.lit(True).alias("below"))
    return own.join(marked, "k", "left").select("k", F.when((F.col("s") == "UNCHANGED") & F.col("below"), "CHANGED_INTERNALLY").otherwise(F.col("s")).alias("status"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, depth, names, status) of two trees (id, parent, name), roots without parent.

    Level by level: children are matched below matched parents only, by their names without regard to case and, of
    equal ones, by their order (name, then id); all below a node without a partner is inserted or deleted. A matched
    node is CHANGED_INTERNALLY if something below it is not the same. `names` is the way from the root: its order,
    then the ids', is the order of display. As many rounds as levels; a node below a missing parent or in a cycle
    is not in the tree.
    """
    kin = W.partitionBy("parent", F.lower("name")).orderBy("name", "id")
    sides = [settled(side.select("id", "parent", "name").withColumn("nth", F.row_number().over(kin))) for side in (old, new)]
    key = ["above", "low", "nth"]
    of = lambda side, name, above: side.select(F.col("id").alias(f"{name}_id"), F.lower("name").alias("low"), "nth", above)
    tops = [of(side.where("parent is null"), name, F.lit(0).cast("long").alias("above")) for side, name in zip(sides, ("old", "new"), strict=True)]
    levels, depth, names = [], 0, F.array("low")
    level = tops[0].join(tops[1], key, "full").withColumn("way", names)
    while True:
        level = settled(level.select(F.monotonically_increasing_id().alias("node"), F.col("above"), "old_id", "new_id", "way"))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
        below = []
        for side, name in zip(sides, ("old", "new"), strict=True):
            parents = level.where(f"{name}_id is not null").select(F.col(f"{name}_id").alias("parent"), F.col("node").alias("above"))
            below.append(of(side.join(parents, "parent"), name, F.col("above")))
        ways = level.select(F.col("node").alias("above"), F.col("way").alias("upper"))
        level = below[0].join(below[1], key, "full").join(ways, "above").withColumn("way", F.concat("upper", names))
        depth += 1
    status = F.when(F.col("old_id").isNull(), "INSERTION").when(F.col("new_id").isNull(), "DELETION").otherwise("UNCHANGED")
    # From the lowest level up: what changed, or holds a change, marks its parent.
    out, marked = [], None
    for level in reversed(levels):
        now = level.withColumn("status", status)
        if marked is not None:
            now = now.join(marked.select(F.col("above").alias("node"), F.lit(True).alias("inside")), "node", "left")
            now = now.withColumn("status", F.when((F.col("status") == "UNCHANGED") & F.col("inside"), "CHANGED_INTERNALLY").otherwise(F.col("status"))).drop("inside")
        now = settled(now)
        marked = now.where("status <> 'UNCHANGED'").select("above").distinct()
        out.append(now.select("old_id", "new_id", "depth", F.col("way").alias("names"), "status"))
    if not out:
        return old.sparkSession.createDataFrame([], f"old_id {old.schema['id'].dataType.simpleString()}, new_id {new.schema['id'].dataType.simpleString()}, depth int, names array<string>, status string")
    return reduce(DataFrame.unionByName, out)


def _packages(spark, root, realm: int) -> DataFrame:
    """The tree of a realm's page addresses: host labels from the right, then path segments; names in mixed case."""
    pages = table(spark, root, "pages").where(F.col("page_id") % 2 == realm)
    parts = F.concat(F.reverse(F.split(F.regexp_extract("url", "://([^/]+)", 1), r"\.")), F.filter(F.split(F.regexp_extract("url", "://[^/]+/(.*)", 1), "[/?#=&]"), lambda x: x != ""))
    each = pages.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    upto = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    name = F.element_at("p", F.col("n"))
    return each.select(upto(F.col("n")).alias("id"), F.when(F.col("n") > 1, upto(F.col("n") - 1)).alias("parent"), (F.upper(name) if realm else name).alias("name")).distinct()


_PACKAGES = r"""(SELECT DISTINCT array_to_string(p[1:n], '/') AS id, CASE WHEN n > 1 THEN array_to_string(p[1:n - 1], '/') END AS parent, lower(p[n]) AS name FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM (
  SELECT list_concat(list_reverse(string_split(regexp_extract(url, '://([^/]+)', 1), '.')), list_filter(regexp_split_to_array(regexp_extract(url, '://[^/]+/(.*)', 1), '[/?#=&]'), lambda x: x <> '')) AS p FROM pages WHERE page_id % 2 = {})))"""


@query("diff02_ordered_package_diff", f""", o AS {_PACKAGES.format(0)}, n AS {_PACKAGES.format(1)},
walk(old_id, new_id, depth, names) AS (
  SELECT o.id, n.id, 0, [coalesce(o.name, n.name)] FROM (SELECT * FROM o WHERE parent IS NULL) o FULL JOIN (SELECT * FROM n WHERE parent IS NULL) n ON o.name = n.name
  UNION ALL
  SELECT c.old_id, c.new_id, w.depth + 1, list_append(w.names, c.name) FROM walk w JOIN (
    SELECT o.id AS old_id, n.id AS new_id, coalesce(o.name, n.name) AS name, o.parent AS old_parent, n.parent AS new_parent FROM (SELECT * FROM o WHERE parent IS NOT NULL) o FULL JOIN (SELECT * FROM n WHERE parent IS NOT NULL) n ON o.parent = n.parent AND o.name = n.name) c
  ON CASE WHEN c.old_id IS NOT NULL THEN c.old_parent = w.old_id ELSE c.new_parent = w.new_id END),
own AS (SELECT *, array_to_string(names, '/') AS way, CASE WHEN old_id IS NULL THEN 'INSERTION' WHEN new_id IS NULL THEN 'DELETION' ELSE 'UNCHANGED' END AS s FROM walk),
above AS (SELECT DISTINCT array_to_string(names[1:k], '/') AS way FROM (SELECT names, unnest(range(1, len(names))) AS k FROM own WHERE s <> 'UNCHANGED'))
SELECT CAST(depth AS INT) AS depth, own.way, CASE WHEN s = 'UNCHANGED' AND above.way IS NOT NULL THEN 'CHANGED_INTERNALLY' ELSE s END AS status FROM own LEFT JOIN above USING (way)""")
def diff02(spark, root):
    """Two realms' address trees, of seven levels and more."""
    return tree_diff(_packages(spark, root, 0), _packages(spark, root, 1)).select("depth", F.array_join("names", "/").alias("way"), "status")


@query("join19_correspondence", ", b0 AS (SELECT binding, min(binding_id) AS source_id FROM bindings WHERE realm = 0 GROUP BY binding), b1 AS (SELECT binding, min(binding_id) AS bytecode_id FROM bindings WHERE realm = 1 GROUP BY binding) SELECT binding, source_id, bytecode_id FROM b0 JOIN b1 USING (binding)")
def join19(spark, root):
    side = lambda r, x: bindings(spark, root).where(f"realm = {r}").groupBy("binding").agg(F.min("binding_id").alias(x))
    return side(0, "source_id").join(side(1, "bytecode_id"), "binding")
