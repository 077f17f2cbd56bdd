"""Archives, project files, sources and class files."""

import io
import struct
import tarfile
import zipfile

from codeweft.operators.search import parse_vector, vector_text
from codeweft.sources import extract as X
from codeweft.sources import ingest

SOURCE = """package a.b;
import java.util.List;
/** class Fake { */
public class Box<T> extends Base implements Runnable, java.io.Closeable {
  // int no() {
  int size(final List<T> x, int y) { return count("f(") + x.size(); }
}
"""


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p/A.java", "class A {}")
        z.writestr("p/readme", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("q/B.java")
        info.size = 10
        t.addfile(info, io.BytesIO(b"class B {}"))
    got = X.archives(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content)) for r in got) == [("p/A.java", b"class A {}"), ("q/B.java", b"class B {}")]


def test_java_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.java").write_text("é")
    (tmp_path / "d" / "A.txt").write_text("x")
    assert [r.text for r in ingest.java_files(spark, str(tmp_path)).collect()] == ["é"]


def test_pom():
    text = "<project xmlns='x'><parent><groupId>g</groupId><version>2</version></parent><artifactId>a</artifactId><url> u </url><dependencies><dependency><groupId>d</groupId><artifactId>e</artifactId><version>1</version></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>"
    assert X.pom(text) == {"groupId": "g", "artifactId": "a", "version": "2", "url": "u", "description": None, "dependencies": ["d/e/1"]}


def test_suite():
    assert X.suite("suite = {'projects': {'b': {'dependencies': ['a', 'LIB']}, 'a': {}}}") == [("b", "LIB"), ("b", "a")]


def test_java():
    got = X.java(SOURCE)
    assert [(a["kind"], a["binding"]) for a in got if a["kind"] == "decl"] == [("decl", "a.b.Box"), ("decl", "a.b.Box#size(List,int)")]
    assert sorted(a["binding"] for a in got if a["kind"] == "ref") == ["Base", "Runnable", "count", "java.io.Closeable", "java.util.List", "size"]
    assert all(SOURCE[a["start"] : a["start"] + a["length"]] == a["binding"] for a in got if a["type"] == 14)


def test_styles():
    assert [k for *_, k in X.styles("int x = 1; // y\n\"s\"")] == ["keyword", "number", "comment", "string"]


def test_shredded_from_sources(spark):
    files = spark.createDataFrame([(1, "a/b/Box.java", SOURCE)], "artifact_id long, path string, text string")
    rows = ingest.shredded(X.extracted(files))
    assert {r.binding for r in rows["binding"].collect()} == {"a.b.Box", "a.b.Box#size(List,int)"}
    assert {r.binding for r in rows["package"].collect()} == {"", "a", "a.b"}
    assert rows["binding_reference"].count() == 6


def test_source_roots(spark):
    files = spark.createDataFrame([("src/main/a/b/C.java", "a.b"), ("src/test/a/D.java", "a"), ("x/E.java", "z")], "path string, package string")
    assert sorted(r.root for r in X.source_roots(files).collect()) == ["src/main", "src/test"]


def test_class_members():
    utf = lambda s: b"\x01" + struct.pack(">H", len(s)) + s.encode()
    pool = utf("p/C") + b"\x07" + struct.pack(">H", 1) + utf("f") + utf("I") + b"\x05" + bytes(8) + utf("m") + utf("()V")
    body = struct.pack(">HHHH", 0x21, 2, 0, 0) + struct.pack(">HHHHH", 1, 2, 3, 4, 0) + struct.pack(">HHHHHHI", 1, 1, 7, 8, 1, 3, 2) + b"xx" + struct.pack(">H", 0)
    data = b"\xca\xfe\xba\xbe" + bytes(4) + struct.pack(">H", 9) + pool + body
    assert X.class_members(data) == [("class", "p/C", "", 0x21), ("field", "f", "I", 2), ("method", "m", "()V", 1)]


def test_javadoc():
    assert X.javadoc_html("/** A <b>b</b><script>x {@link C#d}\n * @param p the <i>p</i>\n */") == "A <b>b</b>x <code>C#d</code><dl><dt>param</dt><dd>p the <i>p</i></dd></dl>"


def test_vector_text():
    entries = [("a", [1, 5]), ("do'n\\t", [2]), ("zero", [3])]
    assert parse_vector(vector_text(entries)) == entries
    assert parse_vector("'x':3A,4 'y'") == [("x", [3, 4]), ("y", [])]


def test_overridden(spark):
    supers = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I")], "type string, base string")
    methods = spark.createDataFrame([("C", "m"), ("B", "m"), ("A", "m"), ("I", "n"), ("C", "n")], "type string, method string")
    assert sorted(tuple(r) for r in X.overridden(supers, methods).collect()) == [("B", "m", "A"), ("C", "m", "B"), ("C", "n", "I")]
