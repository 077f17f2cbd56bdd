"""Scalar functions, stemmer, tokenizer and signatures, by properties over generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.functions import scalars as S
from codeweft.functions.porter import ESCAPE, LETTERS, STOP, english, stem, tokenize, unescaped

#: Closed syllables that end like no suffix the algorithm knows.
ROOTS = st.lists(st.tuples(st.sampled_from("bcdfgkmnprtv"), st.sampled_from("ou"), st.sampled_from("bdkmnp")), min_size=2, max_size=4).map(lambda parts: "".join(map("".join, parts)))


@settings(max_examples=200, deadline=None)
@given(ROOTS)
def test_endings_of_the_published_algorithm(root):
    """Roots of two closed syllables or more (measure > 1): each step's rule on an ending it names."""
    base = stem(root)
    assert stem(root + "s") == base  # step 1a: S goes
    assert stem(root + "sses") == stem(root + "ss")  # step 1a: SSES becomes SS
    assert stem(root + "ies") == root + "i"  # step 1a: IES becomes I
    assert stem(root + "y") == root + "i"  # step 1c: Y becomes I after a vowel
    for ending in ("ness", "ful", "ment", "ance", "able"):  # steps 3 and 4
        assert stem(root + ending) == base
    assert stem(root + "ization") == stem(root + "ize")  # step 2
    assert stem(root + "ing") == stem(root + "ed")  # step 1b


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeiouyst", max_size=2) | st.text(alphabet="éß1_-", min_size=1, max_size=5))
def test_words_the_stemmer_leaves(word):
    assert stem(word) == word


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ROOTS, st.sampled_from([" ", ", ", "\n", "; "])), max_size=12))
def test_prose_points_at_its_words(parts):
    """Stems in order, at the ranges of their words; stop words between them change nothing but places."""
    text = "".join(w + sep for w, sep in parts)
    got = english(text)
    assert [t[0] for t in got] == [stem(w) for w, _ in parts if w not in STOP]
    assert [text[s : s + n] for _, s, n, _ in got] == [w for w, _ in parts if w not in STOP]
    padded = "".join(f"the {w}{sep}of " for w, sep in parts)
    assert [t[0] for t in english(padded)] == [t[0] for t in got]


HUMPS = st.lists(st.sampled_from(["alpha", "Beta", "GAMMA", "42", "Delta"]), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(HUMPS)
def test_identifiers_split_where_a_slow_scan_splits(parts):
    """A cut falls between kinds of characters and before a capital that a small letter follows, unless one stands before it."""
    name = "".join(parts)
    kind = lambda c: "0" if c.isdigit() else "A" if c.isupper() else "a"
    cuts = [0]
    for i in range(1, len(name)):
        before, here, after = kind(name[i - 1]), kind(name[i]), kind(name[i + 1]) if i + 1 < len(name) else ""
        if before != here and (before, here) != ("A", "a") or before == here == "A" and after == "a":
            cuts.append(i)
    # a capital and the small letters after it are one word
    pieces = [name[a:b].lower() for a, b in zip(cuts, [*cuts[1:], len(name)], strict=True)]
    assert [name[s : s + n].lower() for _, s, n, _ in english(name)] == [p for p in pieces if p not in STOP]


PIECES = st.sampled_from("xyz é") .map(lambda c: (c, c)) | st.integers(1, 0x7F).map(lambda v: (f"\\u{v:04x}", chr(v))) | st.integers(1, 0o77).map(lambda v: (f"\\{v:03o}", chr(v))) | st.sampled_from([(f"\\{k}", v) for k, v in LETTERS.items()]) | st.sampled_from(["\\000", "\\u0000"]).map(lambda c: (c, ""))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=10))
def test_escapes_round_trip(pieces):
    """What a generator writes is read back, each character from where it was written; NUL goes."""
    plain, origin = unescaped("".join(raw for raw, _ in pieces))
    assert plain == "".join(c for _, c in pieces)
    at, want = 0, []
    for raw, c in pieces:
        want += [at] * len(c)
        at += len(raw)
    assert origin == [*want, at]
    assert all(ESCAPE.fullmatch(raw) for raw, c in pieces if raw != c)


CODE = st.lists(st.sampled_from(["word", "camelCase", "X1", "42", "{", "}", "(", ";", "->", "==", "/* note */", "// line\n", '"a text"', "'c'", "\n", " "]), max_size=15)


@settings(max_examples=300, deadline=None)
@given(CODE)
def test_tokens_of_random_sources(parts):
    """Tokens come in order, do not overlap, and skip nothing but blanks, stop words and what marks comments and literals."""
    text = " ".join(parts)
    got = tokenize(text)
    ends = 0
    for lexeme, start, length, symbol in got:
        piece = text[start : start + length]
        assert start >= ends and length > 0
        ends = start + length
        assert symbol == (not re.search("[A-Za-z0-9]", piece))
        assert lexeme in (piece, stem(piece.lower()))
    assert sum(t[3] for t in got) == sum(p in ("{", "}", "(", ";", "->", "==") for p in parts)
    assert sum(t[0] == "42" for t in got) == parts.count("42")


PRIMITIVE = st.sampled_from(sorted((k, v) for k, v in S.LETTERS.items() if k != "V"))
VARIABLE = st.sampled_from("KQX").map(lambda v: (f"T{v};", v))


def a_class(inner):
    argument = st.just(("*", "?")) | inner.filter(lambda t: t[0][0] in "LT[").flatmap(lambda t: st.sampled_from([t, ("+" + t[0], "? extends " + t[1]), ("-" + t[0], "? super " + t[1])]))
    return st.tuples(st.lists(st.sampled_from(["org", "sample", "Unit"]), min_size=1, max_size=3), st.lists(argument, max_size=2)).map(
        lambda x: ("L" + "/".join(x[0]) + (f"<{''.join(a for a, _ in x[1])}>" if x[1] else "") + ";", ".".join(x[0]) + (f"<{', '.join(b for _, b in x[1])}>" if x[1] else ""))
    )


TYPES = st.recursive(PRIMITIVE | VARIABLE, lambda inner: a_class(inner) | inner.map(lambda t: ("[" + t[0], t[1] + "[]")), max_leaves=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(TYPES, max_size=3), TYPES | st.just(("V", "void")), st.lists(st.tuples(st.sampled_from("AB"), st.lists(a_class(VARIABLE), max_size=2)), max_size=2), st.lists(a_class(VARIABLE), max_size=2))
def test_signatures_of_a_grammar(params, result, variables, thrown):
    """What the grammar writes as a signature and as source text agrees."""
    head = "".join(v + (":" + ":".join(b for b, _ in bounds) if bounds else ":Ljava/lang/Object;") for v, bounds in variables)
    signature = (f"<{head}>" if head else "") + "(" + "".join(p for p, _ in params) + ")" + result[0] + "".join("^" + t for t, _ in thrown)
    shown = ", ".join(v + (" extends " + " & ".join(t for _, t in bounds) if bounds else "") for v, bounds in variables)
    text = (f"<{shown}> " if shown else "") + f"{result[1]} go({', '.join(t for _, t in params)})" + (f" throws {', '.join(t for _, t in thrown)}" if thrown else "")
    assert S.pretty_method(signature, "go") == text
    assert S.pretty_method(None, "go") is None


def test_keywords_outside_comments_and_literals(spark):
    from codeweft.operators.scalars import keyword_count

    text = "/* if\nelse */ int n = 1; // while\nString s = \"for\"; char c = 'd'; return interrupt;"
    row = spark.createDataFrame([(text, "open module a { requires b; }")], "t string, m string").select(keyword_count(F.col("t")), keyword_count(F.col("m")), keyword_count(F.col("m"), module=True)).first()
    assert tuple(row) == (3, 0, 3)


def test_columns(spark):
    row = spark.sql("select 'p\"q<&>''' h, 'org.sample.Unit.go' m, 'u\nv\nw' t, 9 f").select(
        S.html_escaped(F.col("h")), S.member_name(F.col("m")), S.line_of(F.col("t"), F.lit(4)), F.array_join(S.flags(F.col("f")), " "), S.is_crawler(F.lit(None).cast("string"))
    ).first()
    assert tuple(row) == ("p&quot;q&lt;&amp;&gt;&#39;", "org.sample.Unit#go", 3, "public static", False)
    got = spark.createDataFrame([("go(long, *)",), ("o.Unit.go(Word,org.sample.Other)",)], "t string").select(S.method_pattern(F.col("t"))).collect()
    assert [r[0] for r in got] == ["%.go(long,%)", "o.Unit#go(%.Word,org.sample.Other)"]


def test_mnemonics_stand_at_their_published_codes(spark):
    names = S.mnemonics()
    assert len(names) == len(set(names)) == 202
    known = {0x00: "nop", 0x02: "iconst_m1", 0x12: "ldc", 0x19: "aload", 0x2A: "aload_0", 0x32: "aaload", 0x3A: "astore", 0x60: "iadd", 0x84: "iinc", 0x94: "lcmp", 0xA7: "goto", 0xB0: "areturn", 0xB6: "invokevirtual", 0xBB: "new", 0xC9: "jsr_w"}
    assert {c: names[c] for c in known} == known
    got = spark.createDataFrame([(0xBA,), (202,), (None,)], "c int").select(S.mnemonic(F.col("c"))).collect()
    assert [r[0] for r in got] == ["invokedynamic", None, None]
