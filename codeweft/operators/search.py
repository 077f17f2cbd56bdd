"""Words of texts and components of type names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.functions.porter import tokenize
from codeweft.plans.register import query
from codeweft.sources.tables import placed, table, unfolded
from codeweft.sources.views import bindings


def index(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, lexeme, pos): lower-cased words between blanks, from 0. Materialise it for many queries."""
    words = frame.select(F.col(key).alias("doc"), F.split(F.lower(text), " ").alias("words"))
    return words.select("doc", F.posexplode("words").alias("pos", "lexeme"))


INDEX = ", idx AS (SELECT doc_id AS doc, unnest(w) AS lexeme, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents))"


def _documents(spark, root):
    return index(table(spark, root, "documents"), "doc_id", "text")


@query("win04_adjacent_lexemes", f"{INDEX} SELECT doc, count(*) AS n FROM (SELECT doc, lexeme, lead(lexeme) OVER (PARTITION BY doc ORDER BY pos) AS following FROM idx) WHERE lexeme = 'of' AND following = 'the' GROUP BY doc")
def win04(spark, root):
    following = F.lead("lexeme").over(W.partitionBy("doc").orderBy("pos"))
    return _documents(spark, root).withColumn("following", following).where("lexeme = 'of' and following = 'the'").groupBy("doc").agg(F.count("*").alias("n"))


LINES = ", lines AS (SELECT doc_id AS doc, unnest(w) AS body, unnest(range(0, len(w))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))"


@query("win03_context_lines", f"{LINES} SELECT doc, line FROM (SELECT doc, line, max(CASE WHEN contains(body, ' of the ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines) WHERE near = 1")
def win03(spark, root):
    """Lines with a hit and two lines on either side."""
    lines = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    near = F.max(F.col("body").contains(" of the ").cast("int")).over(W.partitionBy("doc").orderBy("line").rowsBetween(-2, 2))
    return lines.withColumn("near", near).where("near = 1").select("doc", F.col("line").cast("long").alias("line"))


@query("fts11_regions", f"{LINES}, near AS (SELECT doc, line FROM (SELECT doc, line, max(CASE WHEN contains(body, ' of the ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines) WHERE near = 1) SELECT doc, min(line) AS start, max(line) + 1 AS stop FROM (SELECT doc, line, line - row_number() OVER (PARTITION BY doc ORDER BY line) AS island FROM near) GROUP BY doc, island")
def fts11(spark, root):
    """Context lines merged into half-open regions."""
    near = win03(spark, root).withColumn("island", F.col("line") - F.row_number().over(W.partitionBy("doc").orderBy("line")))
    return near.groupBy("doc", "island").agg(F.min("line").alias("start"), (F.max("line") + 1).alias("stop")).drop("island")


def tokens(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, text, start, length, symbol) of source files, by the source tokenizer."""
    named = frame.select(F.col(key).alias("key"), F.col(text).alias("source"))
    found = lambda source: ((i, *t) for i, t in enumerate(tokenize(source or "")))
    return unfolded(named, ["key"], found, "pos int, text string, start int, length int, symbol boolean", ["source"])


@query("fts01_source_tokens")
def fts01(spark, root):
    """Tokens of conversation texts taken as sources, without symbols (no SQL twin: stemming)."""
    found = tokens(table(spark, root, "conversations"), "conv_id", "text").where("not symbol")
    return found.groupBy("text").agg(F.count("*").alias("count"))


def components(name: Column) -> Column:
    """Lower-case parts of a qualified camel-case name; separators stay on the left part."""
    marked = F.regexp_replace(name, r"(\.)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])", "$1$2$4\u0001$3$5")
    return F.filter(F.split(F.lower(marked), "\u0001"), lambda x: x != "")


PARTS = r", named AS (SELECT binding_id, binding, list_filter(string_split(lower(regexp_replace(binding, '(\.)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])', '\1\2\4' || chr(1) || '\3\5', 'g')), chr(1)), lambda x: x <> '') AS c FROM bindings)"


@query("typ01_name_components", f"{PARTS} SELECT binding_id, array_to_string(c, '|') AS components FROM named")
def typ01(spark, root):
    return bindings(spark, root).select("binding_id", F.array_join(components(F.col("binding")), "|").alias("components"))


@query("typ02_bytecode_components", r"SELECT binding_id, array_to_string(list_filter(string_split(lower(regexp_replace('L' || replace(binding, '.', '/') || ';', '(/|^L)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])', '\1\2\4' || chr(1) || '\3\5', 'g')), chr(1)), lambda x: x <> ''), '|') AS components FROM bindings")
def typ02(spark, root):
    name = F.concat(F.lit("L"), F.replace("binding", F.lit("."), F.lit("/")), F.lit(";"))
    marked = F.regexp_replace(name, r"(/|^L)|([a-z0-9])([A-Z])|([a-zA-Z])([0-9])", "$1$2$4\u0001$3$5")
    return bindings(spark, root).select("binding_id", F.array_join(F.filter(F.split(F.lower(marked), "\u0001"), lambda x: x != ""), "|").alias("components"))


@query("typ05_no_jump_match", f"{PARTS} SELECT binding_id, binding FROM named WHERE len(list_filter(range(1, len(c) + 1), lambda i: starts_with(array_to_string(c[i:], ''), 'ring1'))) > 0")
def typ05(spark, root):
    named = bindings(spark, root).withColumn("c", components(F.col("binding")))
    starts = F.exists(F.sequence(F.lit(1), F.size("c")), lambda i: F.array_join(F.slice("c", i, F.size("c")), "").startswith("ring1"))
    return named.where(starts).select("binding_id", "binding")


@query("prj07_component_lengths", f"{PARTS} SELECT binding_id, array_to_string(list_transform(c, lambda x: length(x)), ',') AS lengths FROM named")
def prj07(spark, root):
    return bindings(spark, root).select("binding_id", F.array_join(F.transform(components(F.col("binding")), lambda x: F.length(x).cast("string")), ",").alias("lengths"))


@query("sort06_rank_of_names", "SELECT binding_id, row_number() OVER (PARTITION BY artifact_id ORDER BY length(string_split(binding, '.')[-1]), length(binding), binding, binding_id) AS place FROM bindings")
def sort06(spark, root):
    order = [F.length(F.substring_index("binding", ".", -1)), F.length("binding"), "binding", "binding_id"]
    return bindings(spark, root).select("binding_id", F.row_number().over(W.partitionBy("artifact_id").orderBy(*order)).alias("place"))


@query("flt13_without_symbols", r"SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS INT) AS words FROM documents")
def flt13(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w.rlike("[A-Za-z0-9]"))).alias("words"))


@query("join06_lexemes_left_files", f"{INDEX} SELECT idx.doc, min(f.path) AS path, count(*) AS n FROM idx LEFT JOIN files f ON f.source_file_id = idx.doc GROUP BY idx.doc")
def join06(spark, root):
    """Lexemes are counted before the join: one row a document meets its file."""
    from codeweft.sources.views import files

    counted = _documents(spark, root).groupBy("doc").agg(F.count("*").alias("n"))
    named = files(spark, root).select(F.col("source_file_id").alias("doc"), "path")
    return counted.join(named, "doc", "left").select("doc", "path", "n")


@query("sort07_merged_categories", "SELECT binding_id, artifact_id, row_number() OVER (ORDER BY length(binding), binding, artifact_id, binding_id) AS place FROM bindings WHERE include_in_type_search")
def sort07(spark, root):
    """All categories in one order, without a task that holds them all."""
    order = [F.length("binding"), "binding", "artifact_id", "binding_id"]
    names = bindings(spark, root).where("include_in_type_search").select("binding_id", "artifact_id", "binding")
    return placed(names, order).select("binding_id", "artifact_id", "place")


def vector_text(entries: list[tuple[str, list[int]]]) -> str:
    """Lexemes with positions (from 1) in the text form of search vectors."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"
    return " ".join(f"{quote(w)}:{','.join(map(str, sorted(p)))}" for w, p in sorted(entries))


def parse_vector(text: str) -> list[tuple[str, list[int]]]:
    import re

    found = re.findall(r"'((?:[^'\\]|''|\\.)*)'(?::([0-9A-D,]+))?", text)
    plain = lambda s: re.sub(r"\\(.)|''", lambda m: m[1] or "'", s)
    return [(plain(w), [int(re.sub("[A-D]", "", x)) for x in p.split(",")] if p else []) for w, p in found]
