"""Extraction: archives, project files, Java sources and class files become rows.

All readers go through Spark's file sources, so paths may lie in any store. Extraction of sources is
lexical (no compiler is at hand): declarations of packages, types and methods, imports, super types
and calls by name, and the styles of tokens.
"""

from __future__ import annotations

import ast
import io
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.porter import TOKEN
from codeweft.plans.register import query
from codeweft.sources.tables import closure, table

#: Keywords of the language.
KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())


def entries(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip or (compressed) tar archive."""
    if name.endswith((".zip", ".jar")):
        with zipfile.ZipFile(io.BytesIO(content)) as held:
            yield from ((i.filename, held.read(i)) for i in held.infolist() if not i.is_dir())
        return
    if name.endswith(".zst"):
        import zstandard

        content = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)).read()
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as held:
        for member in held:
            if member.isfile():
                yield member.name, held.extractfile(member).read()


def archives(spark: SparkSession, path: str, suffix: str = ".java") -> DataFrame:
    """(archive, path, content) of the files in all archives below a folder; an archive a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                rows = [(name, p, c) for p, c in entries(name, content) if p.endswith(suffix)]
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def pom(text: str) -> dict:
    """Coordinates, metadata and dependencies of a project file; test and provided scopes are left out."""
    root = ElementTree.fromstring(text)
    bare = lambda e: e.tag.rpartition("}")[2]
    child = lambda e, name: next((c for c in e if bare(c) == name), None) if e is not None else None
    value = lambda e, name: (c.text or "").strip() if (c := child(e, name)) is not None else None
    parent = child(root, "parent")
    own = {k: value(root, k) or value(parent, k) for k in ("groupId", "artifactId", "version")}
    listed = child(root, "dependencies")
    wanted = [d for d in (listed if listed is not None else ()) if value(d, "scope") not in ("test", "provided")]
    return own | {"url": value(root, "url"), "description": value(root, "description"), "dependencies": sorted({f"{value(d, 'groupId')}/{value(d, 'artifactId')}/{value(d, 'version')}" for d in wanted})}


def suite(text: str) -> list[tuple[str, str]]:
    """(project, dependency) edges of a suite file: a Python literal assigned to `suite`."""
    literal = next(ast.literal_eval(n.value) for n in ast.parse(text).body if isinstance(n, ast.Assign) and n.targets[0].id == "suite")
    return sorted((name, d) for name, p in literal.get("projects", {}).items() for d in p.get("dependencies", ()))


def source_roots(files: DataFrame) -> DataFrame:
    """Folders from which package paths start, of (path, package)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    package = F.replace("package", F.lit("."), F.lit("/"))
    return files.where(folder.endswith(package)).select(F.expr("rtrim('/', substring(regexp_replace(path, '/[^/]*$', ''), 1, length(regexp_replace(path, '/[^/]*$', '')) - length(package)))").alias("root")).distinct()


def styles(text: str) -> list[tuple[int, int, str]]:
    """(start, length, class) of comments, strings, numbers and keywords."""
    found = []
    for m in TOKEN.finditer(text):
        piece = m[0]
        kind = "comment" if piece.startswith(("/*", "//")) else "string" if piece[0] in "\"'" else "number" if piece[0].isdigit() else "keyword" if piece in KEYWORDS else None
        if kind:
            found.append((m.start(), len(piece), kind))
    return found


TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w., ]+?))?(?:\s+implements\s+([\w., ]+?))?\s*[{(]")
METHOD = re.compile(r"(?:^|[\s>\]])(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\{")
CALL = re.compile(r"\b(\w+)\s*\(")


def java(text: str) -> list[dict]:
    """Annotations of a source file: package, imports, types with super types, methods, calls."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", blank, text, flags=re.DOTALL)
    package = m[1] if (m := re.search(r"\bpackage\s+([\w.]+)\s*;", code)) else ""
    prefix = f"{package}." if package else ""
    found = []
    put = lambda m, g, kind, binding, parent=None, type_=0: found.append({"start": m.start(g), "length": len(m[g]), "kind": kind, "binding": binding, "parent": parent, "type": type_, "duplicate": False})
    for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code):
        put(m, 1, "ref", m[1].removesuffix(".*"), type_=21)
    types = []
    for m in TYPE.finditer(code):
        put(m, 2, "decl", prefix + m[2], package)
        types.append((m.start(), prefix + m[2]))
        for base in re.split(r"\s*,\s*", ", ".join(filter(None, (m[3], m[4])))):
            if base:
                found.append({"start": m.start(), "length": len(base), "kind": "ref", "binding": base, "parent": None, "type": 1, "duplicate": False})
    declared = set()
    for m in METHOD.finditer(code):
        if m[1] in KEYWORDS:
            continue
        owner = next((name for at, name in reversed(types) if at < m.start()), package)
        params = [" ".join(p.split()[:-1]).replace("final ", "") for p in m[2].split(",") if p.strip()]
        put(m, 1, "decl", f"{owner}#{m[1]}({','.join(re.sub('<.*', '', p) for p in params)})", owner)
        declared.add(m.start(1))
    for m in CALL.finditer(code):
        if m[1] not in KEYWORDS and m.start(1) not in declared:
            put(m, 1, "ref", m[1], type_=14)
    return sorted(found, key=lambda a: (a["start"], a["length"] != 0, -a["length"]))


def class_members(data: bytes) -> list[tuple[str, str, str, int]]:
    """(kind, name, descriptor, access) of the class, fields and methods of a class file."""
    at = 8
    (count,) = struct.unpack_from(">H", data, at)
    at += 2
    pool: dict[int, object] = {}
    width = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
    i = 1
    while i < count:
        tag = data[at]
        if tag == 1:
            (n,) = struct.unpack_from(">H", data, at + 1)
            pool[i] = data[at + 3 : at + 3 + n].decode("utf-8", "replace")
            at += 3 + n
        else:
            if tag == 7:
                pool[i] = struct.unpack_from(">H", data, at + 1)[0]
            at += 1 + width[tag]
        i += 2 if tag in (5, 6) else 1
    access, this, _, interfaces = struct.unpack_from(">HHHH", data, at)
    at += 8 + 2 * interfaces
    found = [("class", pool[pool[this]], "", access)]
    for kind in ("field", "method"):
        (n,) = struct.unpack_from(">H", data, at)
        at += 2
        for _ in range(n):
            flags, name, descriptor, attributes = struct.unpack_from(">HHHH", data, at)
            at += 8
            for _ in range(attributes):
                at += 6 + struct.unpack_from(">I", data, at + 2)[0]
            found.append((kind, pool[name], pool[descriptor], flags))
    return found


ALLOWED = "a b blockquote code dd dl dt em h1 h2 h3 h4 i li ol p pre strong table tbody td th thead tr tt u ul".split()


def javadoc_html(comment: str) -> str:
    """A documentation comment as HTML with only allowed tags; inline tags become code, block tags a list."""
    body = re.sub(r"^\s*/\*\*|\*/\s*$", "", comment)
    body = re.sub(r"^[ \t]*\*[ \t]?", "", body, flags=re.MULTILINE).strip()
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = re.sub(r"\{@(?:code|literal|link|linkplain|value)\s+([^{}]*)\}", lambda m: f"<code>{escape(m[1])}</code>", body)
    body = re.sub(r"</?(\w+)[^>]*>", lambda m: re.sub(r"\s[^>]*", "", m[0]) if m[1].lower() in ALLOWED else "", body)
    main, *blocks = re.split(r"^\s*@(?=\w)", body, flags=re.MULTILINE)
    listed = "".join(f"<dt>{n}</dt><dd>{t.strip()}</dd>" for n, _, t in (b.partition(" ") for b in blocks))
    return main.strip() + (f"<dl>{listed}</dl>" if listed else "")


def extracted(files: DataFrame) -> DataFrame:
    """(artifact_id, path, text, annotations) of Java files: the input of `ingest.shredded`."""
    from codeweft.sources.ingest import ANNOTATION

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["annotations"] = [java(t or "") for t in batch.text]
            yield batch

    kind = files.schema["artifact_id"].dataType.simpleString()
    return files.select("artifact_id", "path", "text").mapInPandas(run, f"artifact_id {kind}, path string, text string, annotations {ANNOTATION}")


def overridden(supers: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, method, base): the nearest super types that declare a type's method; further ones are left out.

    supers: (type, base) edges; methods: (type, method).
    """
    above = closure(supers.select(F.col("type").alias("a"), F.col("base").alias("b"))).select(F.col("a").alias("type"), F.col("b").alias("base"))
    of = methods.withColumnRenamed("type", "base")
    found = methods.join(above, "type").join(of, ["base", "method"])
    nearer = found.select("type", "method", F.col("base").alias("near")).join(above.select(F.col("type").alias("near"), F.col("base")), "near").select("type", "method", "base")
    return found.select("type", "method", "base").join(nearer.distinct(), ["type", "method", "base"], "left_anti")


@query("udtf06_overrides", ", s AS (SELECT p_partkey AS type, p_partkey // 3 AS base FROM part WHERE p_partkey > 0), m AS (SELECT p_partkey AS type, p_size % 4 AS method FROM part), up(type, base) AS (SELECT type, base FROM s UNION SELECT u.type, s.base FROM up u JOIN s ON s.type = u.base), f AS (SELECT m.type, m.method, u.base FROM m JOIN up u ON u.type = m.type JOIN m b ON b.type = u.base AND b.method = m.method) SELECT type, method, base FROM f WHERE NOT EXISTS (SELECT 1 FROM f g JOIN up u ON u.type = g.base WHERE g.type = f.type AND g.method = f.method AND u.base = f.base)")
def udtf06(spark, root):
    part = table(spark, root, "part")
    return overridden(part.where("p_partkey > 0").selectExpr("p_partkey type", "p_partkey div 3 base"), part.selectExpr("p_partkey type", "p_size % 4 method"))


def sources(spark, root) -> DataFrame:
    """A class a conversation: each turn is a method with as many lambdas in each other as the text's length says (0 to 3),
    within a block, and an anonymous body with an initialiser; the text stands in a comment and a string."""
    size = F.length("text") % 4
    quoted = F.regexp_replace("text", r"[\\\"\n*]", " ")
    method = F.concat(
        F.lit("void m"), F.col("turn").cast("string"), F.lit("(int a) throws E { /* { "), quoted, F.lit(" */ if (a > 0) { "), F.repeat(F.lit("run(x -> { "), size.cast("int")), F.lit('say("{'), quoted, F.lit('");'),
        F.repeat(F.lit(" });"), size.cast("int")), F.lit(" } go(new p.T<A>(1) { { b = 2; } int f() { return 1; } }); }\n"),
    )
    bodies = table(spark, root, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", method.alias("m")))), lambda x: x["m"]), "").alias("body"))
    return bodies.select(F.col("conv_id").alias("doc"), F.concat(F.lit("package p; public class C"), F.col("conv_id").cast("string"), F.lit(" { static { a = 1; }\n"), "body", F.lit("}\n")).alias("text"))


SAID = ", said AS (SELECT conv_id AS doc, length(text) % 4 AS n FROM conversations)"


@query("udtf03_styles", f"""{SAID} SELECT style, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT style, m AS n FROM (SELECT DISTINCT doc FROM said), (VALUES ('keyword', 4), ('number', 1)) t(style, m)
  UNION ALL SELECT style, m FROM said, (VALUES ('comment', 1), ('string', 1), ('number', 4), ('keyword', 7)) t(style, m)) GROUP BY style""")
def udtf03(spark, root):
    """Style classes of the sources made of each conversation."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(k,) for t in batch.text for _, _, k in styles(t or "")], columns=["style"])

    return sources(spark, root).select("text").mapInPandas(run, "style string").groupBy("style").agg(F.count("*").alias("count"))


@query("udtf01_extracted_java", f"""{SAID} SELECT doc AS artifact_id, kind, binding, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT DISTINCT doc, 'decl' AS kind, 'p.C' || doc AS binding FROM said
  UNION ALL SELECT conv_id, 'decl', 'p.C' || conv_id || '#m' || turn || '(int)' FROM conversations
  UNION ALL SELECT doc, kind, replace(b, '@', 'p.C' || doc) FROM said, (VALUES ('decl', '@#f()'), ('ref', 'say'), ('ref', 'go')) t(kind, b)
  UNION ALL SELECT doc, 'ref', 'run' FROM said, range(0, 4) r(i) WHERE i < n) GROUP BY ALL""")
def udtf01(spark, root):
    """Declarations and references extracted from the sources: types, methods with their parameters, calls."""
    files = sources(spark, root).select(F.col("doc").alias("artifact_id"), F.lit("p/C.java").alias("path"), "text")
    each = extracted(files).select("artifact_id", F.inline("annotations"))
    return each.groupBy("artifact_id", "kind", "binding").agg(F.count("*").alias("count"))


@query("fn18_javadoc", """, w AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+') AS w FROM conversations)
SELECT conv_id, string_agg('<b>' || w || '</b> <code>' || w || '&amp;&lt;' || turn || '</code>', chr(10) ORDER BY turn) || '<dl>' || string_agg('<dt>param</dt><dd>p' || turn || ' ' || w || '</dd>', '' ORDER BY turn) || '</dl>' AS html FROM w GROUP BY conv_id""")
def fn18(spark, root):
    """A documentation comment of each conversation, a line and a parameter for each turn: attributes and scripts go, inline tags are escaped."""
    render = F.pandas_udf(lambda s: s.map(javadoc_html), "string")
    word, turn = F.regexp_extract("text", "[A-Za-z]+", 0), F.col("turn").cast("string")
    line = F.concat(F.lit(" * <b id=1>"), word, F.lit("</b><script> {@code "), word, F.lit("&<"), turn, F.lit("}"))
    block = F.concat(F.lit(" * @param p"), turn, F.lit(" "), word)
    said = table(spark, root, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), block.alias("block")))).alias("x"))
    part = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "\n")
    return said.select("conv_id", render(F.concat(F.lit("/**\n"), part("line"), F.lit("\n"), part("block"), F.lit("\n */"))).alias("html"))
