"""The written posting index: query trees against a slow evaluator, pruning, ranges and regions."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from codeweft.functions.porter import STOP
from codeweft.operators import postings as P

T, Not, And, Or, Phrase = P.Term, P.Not, P.And, P.Or, P.Phrase


def build(spark, tmp_path_factory, rows, analyser="blanks", key="long"):
    frame = spark.createDataFrame(rows, f"id {key}, text string, doc string, n int")
    return P.build(frame, "id", "text", f"file://{tmp_path_factory.mktemp('index')}/i", analyser)


def slow(tree, tokens):
    """(matches, positions) by the definition: tokens are (lexeme, weight) in order of position."""
    fits = lambda t, x: (x[0].startswith(t.text) if t.prefix else x[0] == t.text) and (not t.weights or x[1] in t.weights)
    if isinstance(tree, T):
        found = {i for i, x in enumerate(tokens) if fits(tree, x)}
        return bool(found), found
    if isinstance(tree, Not):
        return not slow(tree.of, tokens)[0], set()
    if isinstance(tree, Phrase):
        places = P.flat(tree)
        if not places:
            return True, set()
        good = set()
        for base in range(-len(tokens), len(tokens)):
            at = [(p, base + d) for p, d in places]
            if all(0 <= i < len(tokens) and (not fits(p.of, tokens[i]) if isinstance(p, Not) else fits(p, tokens[i])) for p, i in at):
                good |= {i for _, i in at}
        return bool(good), good
    sides = [slow(p, tokens) for p in tree.parts]
    if isinstance(tree, And):
        return all(m for m, _ in sides), set().union(*(p for _, p in sides)) if all(m for m, _ in sides) else set()
    return any(m for m, _ in sides), set().union(*(p for m, p in sides if m))


def tree(rng, depth=3):
    word = lambda: T(rng.choice(["a", "b", "ab", "abc", "c", "zz"]), rng.random() < 0.25, rng.choice(["", "", "A", "D", "BD"]))
    if depth == 0 or rng.random() < 0.2:
        return word()
    kind = rng.choice(["not", "and", "or", "phrase", "phrase"])
    if kind == "not":
        return Not(tree(rng, depth - 1))
    if kind == "phrase":
        parts = [rng.choice([word, word, lambda: Not(word()), lambda: Phrase(tuple(word() for _ in range(2)), rng.choice([1, 2]))])() for _ in range(rng.randint(0, 3))]
        return Phrase(tuple(parts), rng.choice([1, 1, 2, 3]))
    return (And if kind == "and" else Or)(tuple(tree(rng, depth - 1) for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 3))))


@pytest.fixture(scope="module")
def random_index(spark, tmp_path_factory):
    """Documents of few words; the first line weighs A."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "ab", "abc", "c", "q"]) for _ in range(rng.randint(0, 9))).replace(" ", "\n", rng.randint(0, 1)), "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, "a b a b a b c", None, 2)]
    tokens = {}
    for i, text, *_ in rows:
        head = (text or "").find("\n") if "\n" in (text or "") else len(text or "")
        tokens[i] = [(m[0], "A" if m.start() < head else "D") for m in re.finditer(r"\w+", text or "") if m[0] not in STOP]
    return build(spark, tmp_path_factory, rows, "prose"), tokens


@pytest.mark.parametrize("seed", range(30))
def test_random_trees(spark, random_index, seed):
    index, tokens = random_index
    want_tree = tree(random.Random(seed))
    got = {r.doc: list(r.positions) for r in P.search(index, want_tree).collect()}
    assert got == {d: sorted(p) for d, (m, p) in ((d, slow(want_tree, x)) for d, x in tokens.items()) if m}, want_tree


@pytest.mark.parametrize(
    "text, query, want",
    [
        ("red oak blue elm", Phrase((T("oak"), T("blue"))), [1, 2]),
        ("red oak blue elm", And((T("red"), T("elm"))), [0, 3]),
        ("red oak blue elm", And((T("red"), T("fir"))), None),
        ("red oak blue elm", Or((T("fir"), T("red"))), [0]),
        ("red oak blue elm", T("bl", prefix=True), [2]),
        ("red oak blue elm", T("lue", prefix=True), None),
        ("red oak blue elm", Not(T("fir")), []),
        ("red oak blue elm", Not(T("oak")), None),
        ("red oak blue elm", Phrase((T("oak"), Not(T("fir")))), [1, 2]),
        ("red oak blue elm", Phrase((T("oak"), Not(T("blue")))), None),
        ("red oak blue elm", Phrase((T("elm"), Not(T("fir")))), None),
        ("red oak blue elm", Phrase((Not(T("fir")), T("red"))), None),
        ("red oak blue elm", Phrase((T("red"), T("elm")), distance=3), [0, 3]),
        ("red oak blue elm", Phrase((Phrase((T("red"), T("oak"))), T("blue"))), [0, 1, 2]),
        ("red oak blue elm", Phrase(()), []),
        ("red oak red oak", Phrase((T("red"), T("oak"))), [0, 1, 2, 3]),
    ],
)
def test_shapes(spark, tmp_path_factory, text, query, want):
    index = build(spark, tmp_path_factory, [(1, text, "x", 1)])
    assert [list(r.positions) for r in P.search(index, query).collect()] == ([want] if want is not None else [])


def test_phrase_of_trees_is_refused():
    with pytest.raises(ValueError):
        P.flat(Phrase((T("a"), Or((T("b"), T("c"))))))


def test_only_the_buckets_of_the_terms_are_read(spark, random_index):
    index, _ = random_index
    plan = lambda t: P.reading(index.postings, [t], "normal")._jdf.queryExecution().executedPlan().toString()
    for term in (T("abc"), T("ab", prefix=True)):
        filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(term))[1]
        assert "bucket" in filters and "set" in filters and str(P.bucket_of("abc")) in filters
        assert re.search(r"PushedFilters: \[[^\]]*lexeme", plan(term))
    assert "bucket" not in re.search(r"PartitionFilters: \[([^\]]*)\]", plan(T("a", prefix=True)))[1].replace("isnotnull", "")
    folders = {f.split("bucket=")[1].split("/")[0] for r in index.postings.select("_metadata.file_path").distinct().collect() for f in r}
    read = {f.split("bucket=")[1].split("/")[0] for r in P.reading(index.postings, [T("abc")], "normal").select("_metadata.file_path").distinct().collect() for f in r}
    assert read == {str(P.bucket_of("abc"))} < folders


def test_stop_words_leave_no_gap_and_symbols_one_set(spark, tmp_path_factory):
    text = "The fox; and the Hound\nsat"
    index = build(spark, tmp_path_factory, [(1, text, "x", 1)], "prose")
    for which, want in (("normal", ["fox", ";", "hound", "sat"]), ("no_symbols", ["fox", "hound", "sat"])):
        found = P.ranges(index, P.search(index, Or(tuple(T(w) for w in want)), which), which).first()
        assert list(found.positions) == list(range(len(want)))
        assert [text[r.start : r.start + r.length].lower() for r in found.ranges] == want
    assert P.search(index, Phrase((T("fox"), T("hound"))), "no_symbols").count() == 1
    assert P.search(index, Phrase((T("fox"), T("hound"))), "normal").count() == 0


def test_source_analyser_stems_and_splits(spark, tmp_path_factory):
    text = "int hikingTrail() { return longestTrails; }"
    index = build(spark, tmp_path_factory, [(1, text, "x", 1)], "source")
    found = P.ranges(index, P.search(index, Phrase((T("hike"), T("trail"))))).first()
    assert [text[r.start : r.start + r.length] for r in found.ranges] == ["hiking", "Trail"]


def test_rare_terms_reduce_the_others(spark, tmp_path_factory):
    rows = [(i, "common " + ("rare" if i == 7 else "other"), "x", 1) for i in range(40)]
    index = build(spark, tmp_path_factory, rows)
    found = P.search(index, And((T("common"), T("rare"))))
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString() and [r.doc for r in found.collect()] == [7]
    assert "LeftSemi" not in P.search(index, Or((T("common"), T("rare"))))._jdf.queryExecution().optimizedPlan().toString()


def test_scope(spark, random_index):
    index, tokens = random_index
    scope = spark.createDataFrame([(i,) for i in range(0, 110, 3)], "doc long")
    for query in (T("a"), Not(T("a")), Phrase((T("b"), Not(T("b"))))):
        got = {r.doc for r in P.search(index, query, scope=scope).collect()}
        assert got == {d for d, x in tokens.items() if slow(query, x)[0] and d % 3 == 0}


def test_regions_merge(spark, tmp_path_factory):
    lines = [f"line{i} " + ("hit" if i in (3, 4, 9, 30) else "miss") for i in range(40)]
    text = "\n".join(lines)
    rows = [(1, text, "x", 1), (2, "hit", "x", 1)]
    index = build(spark, tmp_path_factory, rows, "prose")
    found = P.ranges(index, P.search(index, T("hit")))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "id long, text string")
    got = sorted(tuple(r) for r in P.regions(found, docs, "id", "text").collect())
    shown = lambda a, b: (text.index(lines[a]), text.index(lines[b - 1]) + len(lines[b - 1]))
    assert got == [(1, 1, 12, *shown(1, 12), 3), (1, 28, 33, *shown(28, 33), 1), (2, 0, 1, 0, 3, 1)]


def test_empty_and_clashing_columns(spark, tmp_path_factory):
    index = build(spark, tmp_path_factory, [])
    assert P.search(index, Not(T("a"))).count() == 0 == P.search(index, T("a")).count()
    assert index.terms.count() == 0
    index = build(spark, tmp_path_factory, [("k", "a b " * 30_000, "mine", 1), (None, "a", "x", 2)], key="string")
    assert sorted((str(r.doc), len(r.positions)) for r in P.search(index, T("a")).collect()) == [("None", 1), ("k", 30_000)]
    assert index.terms.where(F.col("lexeme") == "a").first().docs == 2


def folders(index):
    return {f for f in os.listdir(index.path.removeprefix("file://")) if not f.startswith(".")}


PROSE = [(i, f"Fox {'fox ' * (i % 3)}; word{i}\nfox and Hound {i % 4}", "x", 1) for i in range(50)]


def test_ranges_of_tokens_leave_no_postings_on_disk(spark, tmp_path_factory):
    index = build(spark, tmp_path_factory, PROSE, "prose")
    rows = index.texts.where("set = 'normal'").orderBy("doc").collect()
    assert [PROSE[3][1][s : s + n].lower() for s, n in zip(rows[3].starts, rows[3].lengths, strict=True)] == ["fox", ";", "word3", "fox", "hound", "3"]
    assert len(rows) == 50 and folders(index) == {"texts"} and "entries" not in index.texts.columns


def test_statistics_of_terms_are_made_only_for_trees_that_are_ordered_by_them(spark, tmp_path_factory):
    index = build(spark, tmp_path_factory, PROSE, "prose")
    found = P.search(index, Or((T("fox", weights="A"), T("word1", prefix=True))), "no_symbols")
    assert {r.doc: len(r.positions) for r in found.collect()} == {i: 1 + i % 3 + (str(i)[0] == "1") for i in range(50)}
    assert folders(index) == {"postings"}
    P.search(index, Phrase((T("fox"), T("hound"))))
    assert folders(index) == {"postings", "terms"}


def test_postings_of_a_lexeme_share_rows_and_are_written_unsorted_and_alone(spark, tmp_path_factory, monkeypatch):
    index, used = build(spark, tmp_path_factory, PROSE, "prose"), []
    written = P.Index._written
    monkeypatch.setattr(P.Index, "_written", lambda self, name, rows, *a, **b: used.append(rows) or written(self, name, rows, *a, **b))
    kept = {(r.lexeme, r.weight, r.doc): (r.head, list(r.positions)) for r in index.postings.where("set = 'normal'").collect()}
    want = {}
    for doc, text, *_ in PROSE:
        tokens = [(m[0], "A" if m.start() < text.index("\n") else "D") for m in re.finditer(r"\w+|;", text.lower()) if m[0] not in STOP]
        for place, (word, weight) in enumerate(tokens):
            head = weight == "A" or (word, "A", doc) not in want
            want.setdefault((word, weight, doc), (head, []))[1].append(place)
    assert kept == want and folders(index) == {"postings"}
    assert index.lists.where("set = 'normal' AND lexeme = 'fox'").count() <= 2 * 4 < 50  # a row a weight and task
    plan = used[0]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
