"""Queries over the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.functions import scalars as S
from codeweft.plans.register import query
from codeweft.sources.tables import table
from codeweft.sources.views import bindings, files, references


@query("flt01_equality", "SELECT target, source_file_id, ref_id, line FROM refs WHERE realm = 0 AND source_artifact_id = 4 AND type = 14")
def flt01(spark, root):
    return references(spark, root).where("realm = 0 and source_artifact_id = 4 and type = 14").select("target", "source_file_id", "ref_id", "line")


@query("flt02_membership", "SELECT binding_id, binding FROM bindings WHERE artifact_id IN (1, 3, 5)")
def flt02(spark, root):
    return bindings(spark, root).where(F.col("artifact_id").isin(1, 3, 5)).select("binding_id", "binding")


@query("flt03_negated_membership", "SELECT target, count(*) AS count FROM refs WHERE source_artifact_id NOT IN (1, 2, 3) GROUP BY target")
def flt03(spark, root):
    return references(spark, root).where(~F.col("source_artifact_id").isin(1, 2, 3)).groupBy("target").agg(F.count("*").alias("count"))


@query("flt04_searchable", "SELECT binding_id FROM bindings WHERE include_in_type_search")
def flt04(spark, root):
    return bindings(spark, root).where("include_in_type_search").select("binding_id")


@query("flt07_ilike_live_wildcards", "SELECT binding_id, binding FROM bindings WHERE binding ILIKE '%.red_idget1%'")
def flt07(spark, root):
    return bindings(spark, root).where(F.col("binding").ilike("%.red_idget1%")).select("binding_id", "binding")


@query("lim02_pattern_search", "SELECT binding_id, binding FROM bindings WHERE binding ILIKE '%.%ring%' ORDER BY binding, binding_id LIMIT 20")
def lim02(spark, root):
    return bindings(spark, root).where(F.col("binding").ilike("%.%ring%")).select("binding_id", "binding").orderBy("binding", "binding_id").limit(20)


@query("flt10_optional_predicates", "SELECT source_artifact_id, count(*) AS count FROM refs WHERE type = 18 GROUP BY ALL")
def flt10(spark, root, kind: int | None = 18, artifact: int | None = None):
    refs = references(spark, root)
    refs = refs if kind is None else refs.where(F.col("type") == kind)
    refs = refs if artifact is None else refs.where(F.col("source_artifact_id") == artifact)
    return refs.groupBy("source_artifact_id").agg(F.count("*").alias("count"))


@query("flt12_without_duplicates", "SELECT count(*) AS count FROM refs WHERE NOT duplicate")
def flt12(spark, root):
    return references(spark, root).where("not duplicate").agg(F.count("*").alias("count"))


AGENTS = "CASE event_id % 4 WHEN 0 THEN 'Mozilla Googlebot/2.1' WHEN 1 THEN 'Mozilla' WHEN 2 THEN '' END"


@query("flt14_crawlers", f"SELECT event_id, coalesce(regexp_matches({AGENTS}, '{'|'.join(S.CRAWLERS)}'), false) AS crawler FROM events")
def flt14(spark, root):
    turn = F.col("event_id") % 4
    agent = F.when(turn == 0, "Mozilla Googlebot/2.1").when(turn == 1, "Mozilla").when(turn == 2, "")
    return table(spark, root, "events").select("event_id", S.is_crawler(agent).alias("crawler"))


@query("prj01_search_flag", "SELECT binding_id, modifiers % 3 <> 0 AND (modifiers & 6) = 0 AS included FROM bindings")
def prj01(spark, root):
    m = F.col("modifiers")
    return bindings(spark, root).select("binding_id", ((m % 3 != 0) & (m.bitwiseAND(6) == 0)).alias("included"))


@query("prj02_kind_and_deprecation", "SELECT binding_id, CASE WHEN source_file_id IS NULL THEN 'PACKAGE' WHEN modifiers % 4 = 0 THEN 'METHOD' WHEN modifiers % 4 = 1 THEN 'FIELD' ELSE 'CLASS' END AS kind, (modifiers & 16) <> 0 AS deprecated FROM bindings")
def prj02(spark, root):
    m = F.col("modifiers")
    kind = F.when(F.col("source_file_id").isNull(), "PACKAGE").when(m % 4 == 0, "METHOD").when(m % 4 == 1, "FIELD").otherwise("CLASS")
    return bindings(spark, root).select("binding_id", kind.alias("kind"), (m.bitwiseAND(16) != 0).alias("deprecated"))


@query("prj06_line_of_offset", r"SELECT doc_id, CAST(length(text[1:n_chars // 2]) - length(replace(text[1:n_chars // 2], chr(10), '')) + 1 AS INT) AS line FROM documents")
def prj06(spark, root):
    return table(spark, root, "documents").select("doc_id", S.line_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).cast("int").alias("line"))


@query("fn03_regexp_replace", "SELECT binding_id, regexp_replace(binding, '[aeiou]', '*', 'g') AS masked FROM bindings")
def fn03(spark, root):
    return bindings(spark, root).select("binding_id", F.regexp_replace("binding", "[aeiou]", "*").alias("masked"))


@query("fn04_array_length", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS lines FROM documents")
def fn04(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"))


@query("fn05_html_escape", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def fn05(spark, root):
    return table(spark, root, "pages").select("page_id", F.sha2(S.html_escaped(F.col("html")), 256).alias("escaped"))


@query("fn08_url_round_trip", "SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '~', '%7E'), '%2A', '*') AS escaped, url FROM pages")
def fn08(spark, root):
    """Form escapes, and what they decode to."""
    escaped = F.url_encode("url")
    return table(spark, root, "pages").select("page_id", escaped.alias("escaped"), F.url_decode(escaped).alias("url"))


@query("fn09_hashes", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def fn09(spark, root):
    return table(spark, root, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("fn10_simple_name", "SELECT binding_id, lower(binding) AS low, string_split(binding, '.')[-1] AS simple, length(regexp_extract(binding, '^[^A-Z]*')) AS first_upper FROM bindings")
def fn10(spark, root):
    return bindings(spark, root).select("binding_id", F.lower("binding").alias("low"), F.substring_index("binding", ".", -1).alias("simple"), F.length(F.regexp_extract("binding", "^[^A-Z]*", 0)).cast("long").alias("first_upper"))


@query("fn11_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def fn11(spark, root):
    return table(spark, root, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


@query("fn12_member_name", r"SELECT binding_id, regexp_replace(binding, '\.([^.]*)$', '#\1') AS member FROM bindings")
def fn12(spark, root):
    return bindings(spark, root).select("binding_id", S.member_name(F.col("binding")).alias("member"))


METHODS = "CASE modifiers % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'java.lang.String' ELSE 'int,java.util.List' END"


@query("fn13_method_pattern_search", rf"SELECT binding_id, regexp_replace(binding, '\.([^.]*)$', '#\1') || '(' || {METHODS} || ')' AS member FROM bindings WHERE regexp_replace(binding, '\.([^.]*)$', '#\1') || '(' || {METHODS} || ')' ILIKE 'com.small#%(int,%.List)'")
def fn13(spark, root):
    m = F.col("modifiers") % 3
    params = F.when(m == 0, "int").when(m == 1, "java.lang.String").otherwise("int,java.util.List")
    members = bindings(spark, root).select("binding_id", F.concat(S.member_name(F.col("binding")), F.lit("("), params, F.lit(")")).alias("member"))
    pattern = spark.range(1).select(S.method_pattern(F.lit("com.small.%(int, List)")).alias("pattern"))
    return members.crossJoin(pattern).where(F.expr("member ilike pattern")).drop("pattern")  # one row on the right


def _flag_names(bits: str, target: str) -> str:
    parts = [f"CASE WHEN ({bits} & {b}) <> 0 THEN '{n}' END" for b, n in S.FLAGS[target].items()]
    return f"concat_ws(' ', {', '.join(parts)})"


@query("fn14_access_flags", "SELECT binding_id, " + ", ".join(f"{_flag_names('modifiers * 1031 % 65536', t)} AS {t}_flags" for t in S.FLAGS) + f", {_flag_names('modifiers', 'method')} AS flags FROM bindings")
def fn14(spark, root):
    """The same bits as flags of each kind of target."""
    wide = (F.col("modifiers") * 1031 % 65536).cast("int")
    return bindings(spark, root).select("binding_id", *[F.array_join(S.flags(wide, t), " ").alias(f"{t}_flags") for t in S.FLAGS], F.array_join(S.flags(F.col("modifiers")), " ").alias("flags"))


@query("fn15_mnemonics", "SELECT code, [" + ", ".join(f"'{m}'" for m in S.mnemonics()) + "][code + 1] AS mnemonic, count(*) AS count FROM (SELECT CAST((ref_id * 31 + line * 7 + target) % 210 AS INT) AS code FROM refs) GROUP BY ALL")
def fn15_codes(spark, root):
    """References' hashes as instruction codes; codes over the last have no mnemonic."""
    code = ((F.col("ref_id") * 31 + F.col("line") * 7 + F.col("target")) % 210).cast("int")
    return references(spark, root).groupBy(code.alias("code")).agg(F.count("*").alias("count")).select("code", S.mnemonic(F.col("code")).alias("mnemonic"), "count")


@query("fn15_type_names", "SELECT type, CASE type WHEN 1 THEN 'SUPER_TYPE' WHEN 14 THEN 'FIELD_READ' WHEN 18 THEN 'METHOD_CALL' ELSE 'UNCLASSIFIED' END AS name, count(*) AS count FROM refs GROUP BY ALL")
def fn15(spark, root):
    names = F.create_map(F.lit(1), F.lit("SUPER_TYPE"), F.lit(14), F.lit("FIELD_READ"), F.lit(18), F.lit("METHOD_CALL"))
    return references(spark, root).groupBy("type").agg(F.count("*").alias("count")).select("type", F.coalesce(names[F.col("type")], F.lit("UNCLASSIFIED")).alias("name"), "count")


#: Method signatures and how they are written out, with {} for the name.
SIGNATURES = [
    ("<V::Ljava/lang/Comparable<TV;>;>([TV;J)Ljava/util/Optional<TV;>;^Lorg/sample/Late;", "<V extends java.lang.Comparable<V>> java.util.Optional<V> {}(V[], long) throws org.sample.Late"),
    ("()[[D", "double[][] {}()"),
    ("(ZBCSJF)Lorg/sample/Outcome;", "org.sample.Outcome {}(boolean, byte, char, short, long, float)"),
    ("<K:Ljava/lang/Number;>(Ljava/util/Map<TK;+Lorg/sample/Unit;>;)TK;", "<K extends java.lang.Number> K {}(java.util.Map<K, ? extends org.sample.Unit>)"),
    ("(Ljava/util/Set<-TX;>;Ljava/lang/Class<*>;)V", "void {}(java.util.Set<? super X>, java.lang.Class<?>)"),
]


@query("fn16_method_signatures", f"SELECT binding_id, CASE modifiers % {len(SIGNATURES)} " + " ".join(f"WHEN {i} THEN replace('{text}', '{{}}', 'm' || binding_id)" for i, (_, text) in enumerate(SIGNATURES)) + " END AS text FROM bindings")
def fn16(spark, root):
    signature = F.element_at(F.array(*[F.lit(s) for s, _ in SIGNATURES]), (F.col("modifiers") % len(SIGNATURES) + 1).cast("int"))
    return bindings(spark, root).select("binding_id", S.pretty_method_udf(signature, F.concat(F.lit("m"), F.col("binding_id").cast("string"))).alias("text"))


# The reserved words and literals of Java, and the words that are reserved in module declarations only.
KEYWORDS = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final
finally float for goto if implements import instanceof int interface long native new package private protected public return
short static strictfp super switch synchronized this throw throws transient try void volatile while _ true false null""".split()
MODULE_KEYWORDS = "open module requires transitive exports opens to uses provides with".split()
#: Comments, strings and characters, in which words are no keywords.
DISABLED = r"""/[*](?s:.*?)[*]/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)'"""


IDENTIFIER = r"[\p{L}\p{M}\p{N}_$]+"


def keyword_count(text, module: bool = False):
    """Keywords of a Java source (or a module declaration) outside comments and literals."""
    words = F.regexp_extract_all(F.regexp_replace(text, DISABLED, " "), F.lit(IDENTIFIER), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(KEYWORDS + MODULE_KEYWORDS * module)))


_LISTED = ", ".join(f"'{w}'" for w in KEYWORDS + MODULE_KEYWORDS)


@query("fn17_keywords", "SELECT doc_id, CAST(len(list_filter(regexp_extract_all(regexp_replace(text, '" + DISABLED.replace("'", "''") + f"', ' ', 'g'), '{IDENTIFIER}'), lambda w: w IN ({_LISTED}))) AS INT) AS keywords FROM documents")
def fn17(spark, root):
    return table(spark, root, "documents").select("doc_id", keyword_count(F.col("text"), module=True).alias("keywords"))


@query("fn19_json_rows", "SELECT binding_id, to_json({'binding': binding, 'modifiers': modifiers}) AS json FROM bindings")
def fn19(spark, root):
    return bindings(spark, root).select("binding_id", F.to_json(F.struct("binding", "modifiers")).alias("json"))


@query("agg08_ordered_arrays", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS texts, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def agg08(spark, root):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, root, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), 256).alias("texts"), F.count("*").alias("n"))


@query("agg14_best_platform", "SELECT path, min_by(artifact_id, {'rank': CASE artifact_id WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, 'a': artifact_id}) AS artifact_id FROM files GROUP BY path")
def agg14(spark, root):
    rank = F.when(F.col("artifact_id") == 3, 0).when(F.col("artifact_id") == 1, 1).otherwise(2)
    return files(spark, root).groupBy("path").agg(F.min_by("artifact_id", F.struct(rank.alias("rank"), "artifact_id")).alias("artifact_id"))


@query("set03_distinct_dependencies", "SELECT l_suppkey AS from_artifact, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def set03(spark, root):
    lines = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("from_artifact"), F.col("l_partkey").alias("p_partkey"))
    return lines.join(table(spark, root, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("from_artifact").agg(F.countDistinct("p_brand").alias("brands"))


@query("lim03_first_hundred", "SELECT binding_id, binding, rank FROM (SELECT *, row_number() OVER (ORDER BY length(string_split(binding, '.')[-1]), length(binding), binding, binding_id) AS rank FROM bindings) WHERE rank <= 100")
def lim03(spark, root):
    order = [F.length(F.substring_index("binding", ".", -1)), F.length("binding"), "binding", "binding_id"]
    top = bindings(spark, root).orderBy(*order).limit(100)
    return top.select("binding_id", "binding", F.row_number().over(W.orderBy(*order)).alias("rank"))
