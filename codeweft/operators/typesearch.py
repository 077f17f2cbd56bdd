"""Search for type names over a written table of their component suffixes.

A name is cut into components; the table has one row for each component of each name: where it starts,
and the rest of the name from there. A query's letters are consumed by runs: a run starts at a component
and follows the name's letters, also into the next components, for free; each later run is a paid jump
ahead to a component. `jumps` is the least number of jumps that consumes the query.

A search reads the suffixes once, from the buckets of the query's letters. A suffix that the open letters do not all
follow in is left out; of others the moves (letters consumed before, start, letters consumed at most) are shuffled once, by name, over
tasks whose number grows with the scan. They meet in one array a name, no longer than its components times the
query's letters, and its frontier (letters consumed, place) goes on by one jump a round, of which five are allowed at most.

Depth 0 is a match of the simple name without jumps, depth d one of the full name with d - 1 jumps.
Null names have no components and match nothing; an empty query matches nothing.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeweft.operators.search import components
from codeweft.operators.versions import KEYED, version_key
from codeweft.plans.register import query
from codeweft.sources.store import Store
from codeweft.sources.tables import dealt, once, reachable, shared_folder, table
from codeweft.sources.views import artifacts, bindings

BUCKETS, DEPTH = 32, 5
SUFFIXES = "name long, start int, own boolean, rest string, bucket int"


def bucket(letter: Column) -> Column:
    return F.pmod(F.ascii(letter), F.lit(BUCKETS))


def suffixes(names: DataFrame, key: str, name: str) -> DataFrame:
    """(name, start, own, rest, bucket): one row a component; `own` says that it is of the simple name."""
    parts = components(F.col(name))
    simple = F.length(F.array_join(components(F.substring_index(name, ".", -1)), ""))
    rows = names.select(F.col(key).cast("long").alias("name"), parts.alias("c"), simple.alias("simple")).where("size(c) > 0")
    rows = rows.withColumn("length", F.length(F.array_join("c", ""))).select("name", "simple", "length", F.explode(F.transform("c", lambda x, i: F.array_join(F.slice("c", i + 1, F.size("c")), ""))).alias("rest"))
    start = F.col("length") - F.length("rest")
    return rows.select("name", start.alias("start"), (start >= F.col("length") - F.col("simple")).alias("own"), "rest", bucket(F.col("rest")).cast("int").alias("bucket"))


def written(names: DataFrame, key: str, name: str, path: str) -> DataFrame:
    """The suffixes as a table in buckets of their first letter, sorted by what follows."""
    suffixes(names, key, name).repartitionByRange("bucket", "rest", "name").sortWithinPartitions("bucket", "rest", "name").write.partitionBy("bucket").parquet(path)
    return names.sparkSession.read.schema(SUFFIXES).parquet(path)


def names_of(spark: SparkSession, root: str) -> DataFrame:
    """The suffix table of all bindings, written when it is first asked for."""
    return once(spark, (root, "names"), lambda path: written(bindings(spark, root), "binding_id", "binding", path))


def consumed(rest: Column, wanted: str) -> Column:
    """How many letters of `wanted` the rest starts with."""
    return sum((F.when(rest.startswith(wanted[:n]), 1).otherwise(0) for n in range(1, len(wanted) + 1)), F.lit(0))


def jumps(table_: DataFrame, wanted: str, depth: int = DEPTH) -> DataFrame:
    """(name, jumps, own): names that match with fewer than `depth` jumps; own: the simple name without any."""
    low, n = wanted.lower(), len(wanted)
    if not n:
        return table_.limit(0).select("name", F.lit(0).alias("jumps"), "own")
    heads = table_.where(F.col("bucket").isin(sorted({ord(c) % BUCKETS for c in low})))
    # From letter i on a run can only lead to the end where all letters from there on follow in the name, in order.
    follows = lambda i: F.col("rest").rlike("(?s)^" + ".*".join(re.escape(c) for c in low[i:]))
    moves = F.array_compact(F.array(*[F.when(follows(i), F.struct(F.lit(i).alias("at"), F.col("start"), consumed(F.col("rest"), low[i:]).alias("reach"))) for i in range(n)]))
    moves = heads.select("name", "own", F.explode(moves).alias("move"))
    simple = F.max(F.col("own") & (F.col("move.at") == 0) & (F.col("move.reach") == n))
    met = dealt(moves, "name").groupBy("name").agg(F.collect_list("move").alias("moves"), simple.alias("own"))

    state = lambda front, rounds: F.struct(front.alias("front"), rounds.alias("rounds"))
    place = lambda at, place: F.struct(at.alias("at"), place.alias("place"))
    done = lambda x: F.exists(x["front"], lambda f: f["at"] == n)

    def ahead(x: Column) -> Column:
        """Where the runs end that start at a place of the front or after it."""
        open_ = F.filter("moves", lambda m: F.exists(x["front"], lambda f: (f["at"] == m["at"]) & (f["place"] <= m["start"])))
        ends = lambda m: F.transform(F.sequence(F.lit(1), m["reach"]), lambda run: place(m["at"] + run, m["start"] + run))
        return F.flatten(F.transform(open_, ends))

    begin = state(F.array(place(F.lit(0), F.lit(0))), F.lit(0))
    walked = F.aggregate(F.array(*map(F.lit, range(depth))), begin, lambda x, _: F.when(done(x), x).otherwise(state(ahead(x), x["rounds"] + 1)))
    found = met.select("name", walked.alias("walked"), "own").where(done(F.col("walked")))
    return found.select("name", (F.col("walked.rounds") - 1).alias("jumps"), "own")


def highlight(parts: list[str], wanted: str, jumps: int) -> list[int] | None:
    """Matched prefix length of each component with at most `jumps` paid jumps; later components are preferred."""
    best: dict[tuple, list[int] | None] = {}

    def go(i: int, at: int, left: int, joined: bool) -> list[int] | None:
        """From component i on, with wanted[at:] open; joined: the component before was matched to its end."""
        if at == len(wanted):
            return [0] * (len(parts) - i)
        if i == len(parts):
            return None
        key = (i, at, left, joined)
        if key not in best:
            best[key] = None
            skipped = None if joined and at else go(i + 1, at, left, False)
            price = 0 if joined or not at else 1
            if joined and at:
                skipped = go(i + 1, at, left, False)
            if skipped is not None:
                best[key] = [0, *skipped]
            elif left >= price:
                same = 0
                while same < len(parts[i]) and at + same < len(wanted) and parts[i][same] == wanted[at + same]:
                    same += 1
                for n in range(1, same + 1):
                    rest = go(i + 1, at + n, left - price, n == len(parts[i]))
                    if rest is not None:
                        best[key] = [n, *rest]
                        break
        return best[key]

    return go(0, 0, jumps, False)



def shown(parts: Column, wanted: str, paid: Column) -> Column:
    """The matched prefix length of each component, comma-joined; only of names that were found."""
    low = wanted.lower()

    @F.pandas_udf(StringType())
    def lengths(cs: pd.Series, js: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, highlight(list(c), low, int(j)) or [])) for c, j in zip(cs, js, strict=True)], dtype=object)

    return lengths(parts, paid)


def type_search(names: DataFrame, table_: DataFrame, wanted: str, key: str = "binding_id", name: str = "binding", depth: int = DEPTH) -> DataFrame:
    """`names` that match, with jumps and depth."""
    found = jumps(table_, wanted, depth).withColumnRenamed("name", "__name")
    out = names.join(found, F.col(key) == F.col("__name"))
    return out.withColumn("depth", F.when(F.col("own"), 0).otherwise(F.col("jumps") + 1)).drop("__name", "own")


def ranked() -> list:
    return ["depth", F.length(F.substring_index("binding", ".", -1)), F.length("binding"), "binding", "binding_id"]


def _searched(wanted: str, names: str) -> str:
    """Every way through the components, one at a time; least jumps, then the list that skips longest."""
    low, n = wanted.lower(), len(wanted)
    return rf"""
, cut AS (SELECT binding_id, binding, list_filter(string_split(lower(regexp_replace(binding, '(\.)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])', '\1\2\4' || chr(1) || '\3\5', 'g')), chr(1)), lambda x: x <> '') AS c,
  len(list_filter(string_split(lower(regexp_replace(string_split(binding, '.')[-1], '(\.)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])', '\1\2\4' || chr(1) || '\3\5', 'g')), chr(1)), lambda x: x <> '')) AS own FROM {names}),
walk(id, i, done, paid, joined, lengths) AS (
  SELECT binding_id, 1, 0, 0, false, CAST([] AS INT[]) FROM cut
  UNION ALL
  SELECT id, i + 1, done + r.n, paid + CASE WHEN r.n = 0 OR joined OR done = 0 THEN 0 ELSE 1 END, r.n = length(c[i]), list_append(lengths, CAST(r.n AS INT))
  FROM walk JOIN cut ON id = binding_id AND i <= len(c), range(0, {n + 1}) r(n)
  WHERE done + r.n <= {n} AND r.n <= length(c[i]) AND starts_with(c[i], substr('{low}', done + 1, CAST(r.n AS BIGINT))) AND paid + CASE WHEN r.n = 0 OR joined OR done = 0 THEN 0 ELSE 1 END < {DEPTH}),
ended AS (SELECT id, paid, lengths FROM walk JOIN cut ON id = binding_id WHERE i = len(c) + 1 AND done = {n}),
least AS (SELECT id, min(paid) AS jumps FROM ended GROUP BY id),
best AS (SELECT id, jumps, min(lengths) AS lengths FROM ended JOIN least USING (id) WHERE paid = jumps GROUP BY id, jumps),
depths AS (SELECT binding_id, binding, jumps, lengths, CASE WHEN len(list_filter(range(len(c) - own + 1, len(c) + 1), lambda i: starts_with(array_to_string(c[i:], ''), '{low}'))) > 0 THEN 0 ELSE jumps + 1 END AS depth FROM best JOIN cut ON id = binding_id)"""


@query("typ06_type_search", f"""{_searched("reWi", "bindings")} SELECT binding_id, binding, CAST(depth AS INT) AS depth, array_to_string(lengths, ',') AS match FROM depths JOIN bindings USING (binding_id, binding) WHERE include_in_type_search""")
def typ06(spark, root):
    """Names that match `reWi` with up to four jumps, and what of each component is matched."""
    found = type_search(bindings(spark, root).where("include_in_type_search"), names_of(spark, root), "reWi")
    return found.select("binding_id", "binding", "depth", shown(components(F.col("binding")), "reWi", F.col("jumps")).alias("match"))


@query("typ03_jump_counts", f"""{_searched("cob1", "bindings")} SELECT binding_id, CAST(depth AS INT) AS depth, jumps FROM depths""")
def typ03(spark, root):
    """The jumps that `cob1` takes in each name that it matches."""
    return type_search(bindings(spark, root), names_of(spark, root), "cob1").select("binding_id", "depth", "jumps")


ENTRIES = "category long, name long, start int, own boolean, rest string, bucket int"


@query("typ08_replaced_category", f"""{_searched("sring", "(SELECT * REPLACE (CASE WHEN artifact_id = 3 THEN 'new.Spring' || binding ELSE binding END AS binding) FROM bindings)")} SELECT binding_id, jumps FROM depths""")
def typ08(spark, root):
    """Suffixes stored by category; one category's names change and its partition alone is replaced, then the search runs on the store."""
    names = bindings(spark, root).select("binding_id", "artifact_id", "binding")
    entries = lambda rows: suffixes(rows, "binding_id", "binding").join(rows.select(F.col("binding_id").alias("name"), F.col("artifact_id").alias("category")), "name")
    store = Store(spark, f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}")
    store.publish({"entries": entries(names)}, "category")
    renamed = names.where("artifact_id = 3").withColumn("binding", F.concat(F.lit("new.Spring"), "binding"))
    store.replace({"entries": entries(renamed)}, "category")
    return jumps(store.read("entries", ENTRIES), "sring").select(F.col("name").alias("binding_id"), "jumps")


def uses(spark: SparkSession, root: str) -> DataFrame:
    """(a, b): artifact a uses artifact b."""
    key = F.col("s_suppkey")
    return table(spark, root, "supplier").where("s_nationkey % 5 = 0").select((key % 10).alias("a"), ((key * 3 + F.col("s_nationkey")) % 10).alias("b"))


@query("typ09_search_within_dependencies", f"""{KEYED}, reach(artifact_id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (s_suppkey * 3 + s_nationkey) % 10 FROM reach JOIN supplier ON s_suppkey % 10 = artifact_id AND s_nationkey % 5 = 0),
scoped AS (SELECT * FROM bindings SEMI JOIN reach USING (artifact_id)){_searched("smring", "scoped")},
newest AS (SELECT d.*, row_number() OVER (PARTITION BY d.binding ORDER BY k NULLS LAST, d.binding_id) AS place FROM depths d JOIN bindings b USING (binding_id) LEFT JOIN keyed USING (artifact_id))
SELECT CAST(depth AS INT) AS depth, binding, binding_id FROM newest WHERE place = 1 ORDER BY depth, length(string_split(binding, '.')[-1]), length(binding), binding, binding_id LIMIT 100""")
def typ09(spark, root):
    """Limited search in artifact 1 and all it uses; of equal names the newest version's, ranked."""
    scope = reachable(spark.sql("select 1L as id"), uses(spark, root)).withColumnRenamed("id", "artifact_id")
    found = type_search(bindings(spark, root).join(scope, "artifact_id", "left_semi"), names_of(spark, root), "smring")
    versions = artifacts(spark, root).select("artifact_id", version_key(F.col("version")).alias("k"))
    order = F.struct(F.col("k").isNull().alias("none"), "k", "binding_id")
    newest = found.join(versions, "artifact_id", "left").groupBy("binding").agg(F.min(F.struct(order.alias("order"), "depth", "binding_id")).alias("best"))
    newest = newest.select("best.depth", "binding", "best.binding_id")
    return newest.orderBy(*ranked()).limit(100)
